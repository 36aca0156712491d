"""vitrine: product-page extraction as Spark jobs.

Captured pages are shredded once into ordered DOM nodes (the only Python in
the plan); every later step -- structured data, heuristics, normalisation and
precedence merging -- is a Spark Column expression over those nodes, so the
extraction plan is narrow (no exchange) and runs unchanged on a stream.
"""

from vitrine.session import get_session

__all__ = ["get_session"]

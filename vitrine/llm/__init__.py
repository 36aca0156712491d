"""Operators of a training-data pipeline, each by one named method.

Nothing else in the library imports this subpackage; it may import the
library's general helpers.
"""

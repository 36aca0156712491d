"""S1 for raw captures: a folder of saved HTML files with a sidecar JSON each, as a Spark data source.

``spark.read.format("saved_pages").load(folder)`` gives the rows of
``schemas.CAPTURES``. For ``name.html`` the sidecar ``name.json`` has ``page_id``,
``url``, ``strategy`` and, of a failed download, ``error``; a page without HTML is
a sidecar alone. The files are listed once on the driver (names only) and dealt
out in partitions of ``pagesPerPartition``; each task reads its own.

Filters ``url = ..``, ``strategy = ..`` and ``IN`` on both are applied to the sidecar, before
the HTML is opened (Spark applies them again where it wants to, so they can only
spare work); they need spark.sql.python.filterPushdown.enabled.

Defined cases: a sidecar that is missing, unreadable or no object gives a row
with nulls and the reason in ``error``; HTML that is no UTF-8 is read with
replacement characters; other files are ignored; an empty folder gives no rows.
Any folder that pyarrow's file systems open can be named (local or a URI).
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from vitrine import schemas

try:  # ship the worker-side code by value: executors need not have the package
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

PAGES_PER_PARTITION = 1000
_PUSHED = ("url", "strategy")


def _open(folder: str):
    from pyarrow import fs

    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


class Pages(InputPartition):
    """Names (without ending) of the pages of one partition, and whether each has HTML."""

    def __init__(self, names: list[tuple[str, bool]]):
        super().__init__(names)
        self.names = names


class SavedPagesReader(DataSourceReader):
    def __init__(self, folder: str, per_partition: int):
        self.folder, self.per_partition = folder, per_partition
        #: Column -> values that a sidecar must have.
        self.wanted: dict[str, set] = {}

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        files, root = _open(self.folder)
        found: dict[str, bool] = {}
        for info in files.get_file_info(fs.FileSelector(root, recursive=True)):
            name, dot, ending = info.path.rpartition(".")
            if info.type == fs.FileType.File and dot and ending in ("html", "json"):
                found[name] = found.get(name, False) or ending == "html"
        names = sorted(found.items())
        return [Pages(names[i:i + self.per_partition]) for i in range(0, len(names), self.per_partition)] or [Pages([])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        files, _ = _open(self.folder)
        for name, has_html in partition.names:
            yield from _page(files, name, has_html, self.wanted)


class FilteringReader(SavedPagesReader):
    """Spark refuses a reader with ``pushFilters`` unless filters may be pushed."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            yield f  # rows with a broken sidecar pass, so Spark filters as well


def _page(files, name: str, has_html: bool, wanted: dict[str, set]) -> Iterator[tuple]:
    """The row of one page, unless its sidecar says that it isn't wanted."""
    try:
        with files.open_input_stream(f"{name}.json") as f:
            about = json.loads(f.read())
        if not isinstance(about, dict):
            raise ValueError("no object")
        page_id = None if about.get("page_id") is None else int(about["page_id"])
        url, strategy, error = (None if about.get(k) is None else str(about[k]) for k in ("url", "strategy", "error"))
    except (OSError, ValueError, TypeError) as exc:
        yield None, None, None, None, f"sidecar: {type(exc).__name__}: {name.rpartition('/')[2]}.json"
        return
    about = {"url": url, "strategy": strategy}
    if any(about[k] not in values for k, values in wanted.items()):
        return
    html = None
    if has_html:
        try:
            with files.open_input_stream(f"{name}.html") as f:
                html = f.read().decode("utf-8", "replace")
        except OSError as exc:
            error = error or f"html: {type(exc).__name__}"
    yield page_id, url, strategy, html, error


class SavedPages(DataSource):
    """Format ``saved_pages``: options ``path``, ``pagesPerPartition`` and ``filters`` (whether to take pushed ones)."""

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self):
        return schemas.CAPTURES

    def reader(self, schema) -> SavedPagesReader:
        per = int(self.options.get("pagesPerPartition", PAGES_PER_PARTITION))
        if per < 1:
            raise ValueError("pagesPerPartition must be positive")
        kind = FilteringReader if self.options.get("filters") == "true" else SavedPagesReader
        return kind(self.options["path"], per)


def read_saved_pages(spark: SparkSession, folder: str, pages_per_partition: int = PAGES_PER_PARTITION) -> DataFrame:
    """The captures of a folder of saved pages."""
    spark.dataSource.register(SavedPages)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("saved_pages").option("pagesPerPartition", pages_per_partition).option("filters", pushed).load(folder)

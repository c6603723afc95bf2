"""Pages of an interface that land as files, as a data source of Spark: ``spark.read.format("paged").load(folder)`` after ``register(spark)``.

Each page is a partition of its own. A page is one JSON object with a list of records in ``field``; a page whose field is no list has no records, and one that
isn't JSON gives a single row with a problem. As a stream, pages are offsets: a batch has the pages that came since the one before, up to
the first page that is missing or, with ``limit``, that has fewer records than a full one: that one may still grow, so it waits until another follows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "page int, record string, problem string"
#: Names of pages: their number stands before the ending.
NAME = re.compile(r"(\d+)\.json$")


class Page(InputPartition):
    def __init__(self, number: int, path: str) -> None:
        self.number, self.path = number, path


def pages(folder: str) -> dict[int, str]:
    """The paths of a folder's pages by their number; a folder may be a URI of any file system that Arrow knows."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    found = system.get_file_info(fs.FileSelector(root))
    return {int(m[1]): x.path for x in found if x.is_file and (m := NAME.search(x.base_name))}


def text_of(folder: str, path: str) -> bytes:
    from pyarrow import fs

    system = fs.FileSystem.from_uri(folder)[0] if "://" in folder else fs.LocalFileSystem()
    with system.open_input_stream(path) as f:
        return f.read()


def rows(number: int, raw: bytes, field: str) -> Iterator[tuple[int, str | None, str | None]]:
    try:
        whole = json.loads(raw)
    except ValueError as e:
        yield number, None, f"no JSON: {e}"[:200]
        return
    listed = whole.get(field) if isinstance(whole, dict) else None
    for record in listed if isinstance(listed, list) else ():
        yield number, json.dumps(record, ensure_ascii=False), None


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.field = options["path"], options.get("field", "data")

    def partitions(self) -> list[Page]:
        return [Page(n, path) for n, path in sorted(pages(self.folder).items())]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from rows(partition.number, text_of(self.folder, partition.path), self.field)


class StreamReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.field, self.limit = options["path"], options.get("field", "data"), int(options.get("limit", "0"))

    def initialOffset(self) -> dict:
        return {"page": 1}

    def _between(self, start: int, end: int | None) -> tuple[list[tuple], int]:
        held, out, n = pages(self.folder), [], start
        while n in held and (end is None or n < end):
            found = list(rows(n, text_of(self.folder, held[n]), self.field))
            if end is None and len(found) < self.limit and n + 1 not in held:
                break
            out += found
            n += 1
        return out, n

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        out, n = self._between(start["page"], None)
        return iter(out), {"page": n}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._between(start["page"], end["page"])[0])


class Paged(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:  # noqa: ANN001 - Spark's own type
        return Reader(self.options)

    def simpleStreamReader(self, schema) -> StreamReader:  # noqa: ANN001, N802
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Paged)

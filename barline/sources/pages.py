"""A data source over saved replies: numbered pages of a list, or candles by the start of their window.

Layout: ``<path>/key=<number>/<files>``, where the number is that of a page or
the start of a window in milliseconds, and every line of a file is the body of
a reply, a JSON array of objects or of arrays (whose values stand for the
columns in order). ``key`` is a column of the result where the schema has it.

Batch: a partition for each ``span`` of numbers (1: a page each; 500: runs of
pages, for long lists; three days in milliseconds: a window each). With ``until_empty`` the first page that holds
nothing ends the list. Stream: the offset is the highest number read, so that a
restart from its checkpoint reads nothing twice; numbers below it that come
later are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME = "barline_pages"
#: Rows of one batch that a reader passes on; three days, the span of a window of candles.
ROWS, THREE_DAYS = 10_000, 3 * 86_400_000
#: Bytes below which a reply may hold nothing; only such are opened by the planner.
TINY = 64


@dataclass
class Span(InputPartition):
    """The numbers of one partition, in order."""

    keys: list[int]

    def __init__(self, keys: list[int]):
        self.keys = keys


class Replies:
    """What the readers share: where the replies are, and how their bodies become rows."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.schema = options["path"], schema
        self.span, self.until_empty = int(options.get("span", 1)), options.get("until_empty", "false").lower() == "true"

    def folder(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def numbers(self, above: int | None = None) -> list[int]:
        """Numbers of the replies that are there, in order; up to the first empty one if it ends the list."""
        from pyarrow import fs

        store, root = self.folder()
        number = lambda name: int(name[4:]) if name.startswith("key=") and name[4:].lstrip("-").isdigit() else None
        sizes: dict[int, int] = {}
        for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=self.until_empty)):  # sizes by one listing, not one for each number
            if f.type == fs.FileType.Directory and f.path.rsplit("/", 2)[-2] == root.rstrip("/").rsplit("/", 1)[-1] and (k := number(f.base_name)) is not None:
                sizes.setdefault(k, 0)
            elif f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and (k := number(f.path.rsplit("/", 2)[-2])) is not None:
                sizes[k] = sizes.get(k, 0) + f.size
        keys = sorted(k for k in sizes if above is None or k > above)
        if self.until_empty:
            for i, k in enumerate(keys):
                if sizes[k] < TINY and not any(True for _ in self.items(k)):
                    return keys[:i]
        return keys

    def files(self, key: int) -> list:
        from pyarrow import fs

        store, root = self.folder()
        found = store.get_file_info(fs.FileSelector(f"{root}/key={key}"))
        return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)

    def items(self, key: int) -> Iterator:
        """The elements of a number's bodies; one that isn't a JSON array has none."""
        store, _ = self.folder()
        for f in self.files(key):
            with store.open_input_stream(f.path, compression="detect") as body:
                text = body.read().decode()
            for line in text.splitlines():
                try:
                    value = json.loads(line)
                except ValueError:
                    continue
                yield from value if isinstance(value, list) else ()

    def batches(self, keys: list[int]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        names = [n for n in arrow.names if n != "key"]
        rows: list[dict] = []
        for k in keys:
            for x in self.items(k):
                row = x if isinstance(x, dict) else dict(zip(names, x, strict=False)) if isinstance(x, list) else {}
                rows.append({**{n: _typed(row.get(n), arrow.field(n).type) for n in names}, "key": k})
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def spans(self, keys: list[int]) -> list[Span]:
        groups: dict[int, list[int]] = {}
        for k in keys:
            groups.setdefault(k // self.span, []).append(k)
        return [Span(g) for _, g in sorted(groups.items())] or [Span([])]


def _typed(x, kind: pa.DataType):
    """A JSON value as the column's type, NULL where it isn't one; numbers may stand in strings."""
    if x is None:
        return None
    try:
        if pa.types.is_floating(kind):
            return float(x)
        if pa.types.is_integer(kind):
            return int(x) if not isinstance(x, float) or x.is_integer() else None
        if pa.types.is_boolean(kind):
            return x if isinstance(x, bool) else None
        if pa.types.is_string(kind) or pa.types.is_large_string(kind):
            return x if isinstance(x, str) else json.dumps(x)
    except (TypeError, ValueError):
        return None
    return x


class BatchReader(DataSourceReader):
    def __init__(self, replies: Replies):
        self.replies = replies

    def partitions(self) -> list[InputPartition]:
        return self.replies.spans(self.replies.numbers())

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from self.replies.batches(partition.keys)


class StreamReader(DataSourceStreamReader):
    """Offsets are {"read": the highest number read so far}; before anything is read, None."""

    def __init__(self, replies: Replies):
        self.replies = replies

    def initialOffset(self) -> dict:  # noqa: N802
        return {"read": None}

    def latestOffset(self) -> dict:  # noqa: N802
        keys = self.replies.numbers()
        return {"read": keys[-1] if keys else None}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["read"] is None:
            return []
        return self.replies.spans([k for k in self.replies.numbers(start["read"]) if k <= end["read"]])

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from self.replies.batches(partition.keys)

    def commit(self, end: dict) -> None:
        pass


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("the schema of a reply's elements has to be given")

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(Replies(dict(self.options), schema))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return StreamReader(Replies(dict(self.options), schema))


def read_pages(spark: SparkSession, path: str, schema: str, span: int = 1, until_empty: bool = False, stream: bool = False) -> DataFrame:
    """Saved replies as a table, or as a stream of those not read yet."""
    spark.dataSource.register(Pages)
    reader = spark.readStream if stream else spark.read
    return reader.format(NAME).schema(schema).option("span", span).option("until_empty", str(until_empty).lower()).load(path)


def save_pages(bodies: DataFrame, path: str, mode: str = "append") -> None:
    """(key, value): bodies into the layout of the source; what is read later must have higher numbers than what has been.

    Tasks put their files in place themselves: there is one for each number,
    and moving them one by one would be the driver's work.
    """
    w = bodies.select("key", "value").repartition("key").write.mode(mode).partitionBy("key")
    w.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)

"""What the operators share: tables, the shared folder, batches and words.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, which is
what ``bytes.split()`` yields; ``bytes.lower()`` lower-cases A-Z alone.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: bounds a Python worker's memory where documents are long.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
WORD = r"[^\x20\x09-\x0D]+"


def _folding(apart: Callable[[int], bool]) -> bytes:
    return bytes(0x20 if apart(c) else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


#: Byte tables that lower-case A-Z and blank all ASCII but letters, or letters and digits; characters beyond ASCII stay.
LETTERS = _folding(lambda c: c < 0x80 and not chr(c).isalpha())
TERMS = _folding(lambda c: c < 0x80 and not chr(c).isalnum())


def folded(text: bytes, table: bytes) -> list[bytes]:
    """Words of a UTF-8 text by one of the tables above."""
    return text.translate(table).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> SparkSession:
    """Keeps Arrow batches small; both settings are about memory, not results."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (tests) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not context.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster's driver and executors need a folder that they share")
        found = context.get().rsplit("/", 1)[0] if context.isDefined() else f"file://{tempfile.mkdtemp(prefix='barline-')}"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder within the shared one, deleted when the session's JVM ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a compressed table in the shared folder: a checkpoint for many narrow rows, which take a fraction of the space there."""
    path = f"{new_folder(df.sparkSession, name)}/table"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder, so a lost executor costs no recomputation of what came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_cleared(df: DataFrame, *names: str) -> DataFrame:
    """Without input columns that clash (in any case) with those an operator adds."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def doc_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of an id as text; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0))


def map_arrow(df: DataFrame, schema: str, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None]) -> DataFrame:
    """mapInArrow by batch; f yields or returns batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = f(b)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return df.mapInArrow(run, schema)


class SharedFiles:
    """Files in the shared folder, whatever store it is in.

    A local (or mounted) folder is used directly, so that files can be memory
    mapped; another store goes through pyarrow's file systems, and a file to be
    mapped is first fetched to the worker's temporary folder and deleted when
    the worker ends.
    """

    def __init__(self, base: str):
        self.base = base
        scheme = urlparse(base).scheme
        self.root = urlparse(base).path if scheme in ("", "file") else None

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.base)

    def put(self, name: str, data: bytes | list[bytes]) -> None:
        """Writes under another name first: a repeated or lost task leaves no half a file."""
        parts = [data] if isinstance(data, bytes | memoryview) else data
        if self.root is not None:
            os.makedirs(self.root, exist_ok=True)
            half = f"{self.root}/.{name}.{uuid.uuid4().hex}"
            with open(half, "wb") as out:
                out.writelines(parts)
            os.replace(half, f"{self.root}/{name}")
        else:
            store, root = self._fs()
            store.create_dir(root, recursive=True)
            half = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(half) as out:
                for p in parts:
                    out.write(p)
            store.move(half, f"{root}/{name}")

    def local(self, name: str) -> str:
        if self.root is not None:
            return f"{self.root}/{name}"
        import atexit

        from pyarrow import fs

        store, root = self._fs()
        fd, path = tempfile.mkstemp(prefix="barline-")
        os.close(fd)
        atexit.register(lambda: os.path.exists(path) and os.remove(path))
        fs.copy_files(f"{root}/{name}", path, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
        return path

"""SparkSession factory."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "barline", cores: int | str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that every plan here relies on.

    UTC, ANSI arithmetic and adaptive execution are what the operators assume;
    the shuffle width is for a single machine and is to be set by the cluster.
    """
    cores = cores or os.environ.get("BENCH_CPUS") or "*"
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; in local mode a temporary one where that is unset. It goes with the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster's driver and executors need a folder that they share")
        base = f"file://{tempfile.mkdtemp(prefix='barline-')}"
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return folder


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a table in the shared folder: for what several jobs read and a longer plan makes."""
    path = f"{shared_folder(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

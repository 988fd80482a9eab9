from __future__ import annotations

from barline.sources import read_csv, read_files, read_table, write_table
from barline.streaming import event_stream, run_available, upsert_batch
from tests.compare import DATA

BASE = f"{DATA}/sf0.001"


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    write_table(df, f"{tmp_path}/p", by=["k"])
    write_table(df, f"{tmp_path}/p", "append", by=["k"])
    assert spark.read.parquet(f"{tmp_path}/p").count() == 4
    write_table(df, f"{tmp_path}/c", form="csv")
    assert sorted(map(tuple, read_csv(spark, f"{tmp_path}/c", "k int, v string").collect())) == [(1, "a"), (2, None)]
    assert read_csv(spark, f"{tmp_path}/c").dtypes == [("k", "int"), ("v", "string")]


def test_broken_files_and_missing_keys(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, None)], "k int, v string").write.parquet(f"{tmp_path}/good.parquet")
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 not really")
    got = read_files(spark, [f"{tmp_path}/good.parquet", f"{tmp_path}/bad.parquet"], ["v"])
    assert got.count() == 1


def test_column_list_reaches_the_scan(spark):
    plan = read_table(spark, BASE, "lineitem", ["l_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan


def test_stream_upserts_into_a_table(spark, tmp_path):
    ticks = event_stream(spark, BASE)
    for _ in range(2):
        put = upsert_batch(f"{tmp_path}/t", ["event_id"])
        q = ticks.writeStream.foreachBatch(put).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c{_}").start()
        q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1000
    assert run_available(ticks).count() == 1000

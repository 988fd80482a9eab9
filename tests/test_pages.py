"""Saved replies as a data source: order, empty pages, odd bodies, windows, restarts."""

from __future__ import annotations

from barline.sources.pages import read_pages, save_pages

SCHEMA = "key long, id string, x double, n int"


def put(spark, path, bodies):
    save_pages(spark.createDataFrame(bodies, "key long, value string"), f"file://{path}")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pages_until_the_first_empty_one(spark, tmp_path):
    put(spark, tmp_path / "p", [(1, '[{"id": "a", "x": 1.5, "n": 1}, {"id": "b"}]'), (10, '[{"id": "ten"}]'), (2, '[["c", "2.5", 3]]'), (11, "[]"), (12, '[{"id": "stale"}]')])
    df = read_pages(spark, f"file://{tmp_path}/p", SCHEMA, until_empty=True)
    assert rows(df) == sorted([(1, "a", 1.5, 1), (1, "b", None, None), (2, "c", 2.5, 3), (10, "ten", None, None)], key=str)
    assert df.rdd.getNumPartitions() == 3
    assert len(rows(read_pages(spark, f"{tmp_path}/p", SCHEMA))) == 5


def test_odd_bodies(spark, tmp_path):
    put(spark, tmp_path / "p", [(1, "not JSON"), (2, '{"id": "an object"}'), (3, '[{"id": 7, "x": "many", "n": 1.5}, 5, null]'), (4, '[{"id": "d", "n": 2.0, "more": [1]}]')])
    assert rows(read_pages(spark, f"{tmp_path}/p", SCHEMA)) == rows(spark.createDataFrame([(3, "7", None, None), (3, None, None, None), (3, None, None, None), (4, "d", None, 2)], SCHEMA))
    assert rows(read_pages(spark, f"{tmp_path}/p", SCHEMA, until_empty=True)) == []  # the first page holds nothing


def test_windows_are_partitions(spark, tmp_path):
    put(spark, tmp_path / "p", [(k, f'[["w{k}", {k}, 0]]') for k in (0, 5, 9, 10, 25)])
    df = read_pages(spark, f"{tmp_path}/p", SCHEMA, span=10)
    assert df.rdd.getNumPartitions() == 3 and df.count() == 5


def test_nothing_saved(spark, tmp_path):
    assert read_pages(spark, f"{tmp_path}/none", SCHEMA).count() == 0


def test_restart_reads_nothing_twice(spark, tmp_path):
    def run():
        q = read_pages(spark, f"file://{tmp_path}/p", SCHEMA, stream=True).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check")
        q.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out")

    put(spark, tmp_path / "p", [(1, '[["a", 1, 1]]'), (2, '[["b", 2, 2]]')])
    assert run().count() == 2
    assert run().count() == 2
    put(spark, tmp_path / "p", [(3, '[["c", 3, 3], ["d", 4, 4]]'), (40, '[["e", 5, 5]]')])
    assert sorted(r.id for r in run().collect()) == ["a", "b", "c", "d", "e"]

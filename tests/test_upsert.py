"""Keyed tables by batches: updates and new rows, batches that break off and run again, buckets that are not touched."""

import pytest
from pyspark.sql import functions as F

from momentspark.streaming import upsert as up

COLS = "k string, v int, at int"


def rows(spark, path):
    return {r["k"]: (r["v"], r["at"], r["id"]) for r in spark.read.parquet(path).collect()}


def test_updates_new_rows_and_repeats(spark, tmp_path):
    path, write = f"{tmp_path}/t", up.upsert(f"{tmp_path}/t", "k", "at", 8)
    first = spark.createDataFrame([(f"k{n}", n, 1) for n in range(100)] + [(None, 1, 1)], COLS)
    write(first, 0)
    one = rows(spark, path)
    assert len(one) == 100 and len({x[2] for x in one.values()}) == 100 and all(one[f"k{n}"][:2] == (n, 1) for n in range(100))
    change = spark.createDataFrame([("k3", 33, 2), ("k4", 44, 0), ("k5", 55, 2), ("k5", 56, 3), ("new", 7, 1)], COLS)
    for _ in range(2):  # a batch that is run again
        write(change, 1)
        two = rows(spark, path)
        assert len(two) == 101 and two["k3"][:2] == (33, 2) and two["k4"][:2] == (4, 1) and two["k5"][:2] == (56, 3) and two["new"][:2] == (7, 1)
        assert all(two[k][2] == one[k][2] for k in one) and len({x[2] for x in two.values()}) == 101
    write(change.limit(0), 2)
    assert rows(spark, path) == two


def test_a_batch_that_breaks_off_leaves_one_copy(spark, tmp_path, monkeypatch):
    path, write = f"{tmp_path}/t", up.upsert(f"{tmp_path}/t", "k", "at", 4)
    write(spark.createDataFrame([(f"k{n}", n, 1) for n in range(40)], COLS), 0)
    before = rows(spark, path)
    batch = spark.createDataFrame([(f"k{n}", -n, 2) for n in range(30, 50)], COLS)
    whole, calls = type(batch.write).parquet, []

    def breaks(self, to, **kw):
        calls.append(to)
        if to == path:
            raise RuntimeError("killed")
        return whole(self, to, **kw)

    monkeypatch.setattr(type(batch.write), "parquet", breaks)
    with pytest.raises(RuntimeError):
        write(batch, 1)
    monkeypatch.setattr(type(batch.write), "parquet", whole)
    assert rows(spark, path) == before
    write(batch, 1)
    after = rows(spark, path)
    assert len(after) == 50 and spark.read.parquet(path).count() == 50 and all(after[f"k{n}"][:2] == ((n, 1) if n < 30 else (-n, 2)) for n in range(50))


def test_only_touched_buckets_are_read(spark, tmp_path):
    path = f"{tmp_path}/t"
    up.upsert(path, "k", "at", 16)(spark.createDataFrame([(f"k{n}", n, 1) for n in range(200)], COLS), 0)
    some = up.touched(spark.read.parquet(path), [3, 5])
    assert "PartitionFilters: [isnotnull(bucket" in some._jdf.queryExecution().toString() or "PartitionFilters: [bucket" in some._jdf.queryExecution().toString()
    assert {r[0].split("bucket=")[1].split("/")[0] for r in some.select(F.input_file_name()).distinct().collect()} <= {"3", "5"}


def test_a_stream_that_is_run_again_goes_on(spark, tmp_path):
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], COLS).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    run = lambda: up.ingest_upserts(spark.readStream.schema(COLS).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/t", "k", "at", f"{tmp_path}/c", 4).awaitTermination(120)
    run()
    run()
    spark.createDataFrame([("a", 2, 2), ("c", 1, 1)], COLS).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    run()
    assert {k: v[0] for k, v in rows(spark, f"{tmp_path}/t").items()} == {"a": 2, "b": 1, "c": 1}

"""Appends and upserts that read and rewrite only the partitions they touch."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.runtime import scratch
from tidemark.sources.store import Store

ROWS = "symbol string, session int, close double"


@pytest.fixture
def store(spark):
    return Store(scratch(spark, "store"), ("symbol", "session"), {"year": F.floor(F.col("session") / 100).cast("int"), "bucket": F.pmod(F.crc32(F.col("symbol").cast("binary")), F.lit(4)).cast("int")})


def state(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def held(spark, store):
    return {(r["symbol"], r["session"]): r["close"] for r in store.read(spark).collect()}


def test_append_keeps_stored_rows_and_ignores_repeats(spark, store):
    assert store.read(spark) is None
    first = spark.createDataFrame([("a", 101, 1.0), ("a", 101, 1.0), ("b", 205, 2.0), ("c", 300, None)], ROWS)
    store.append(first)
    want = {("a", 101): 1.0, ("b", 205): 2.0, ("c", 300): None}
    assert held(spark, store) == want and store.read(spark).count() == 3
    store.append(first)
    assert held(spark, store) == want and store.read(spark).count() == 3
    store.append(spark.createDataFrame([("a", 101, 9.0), ("a", 102, 3.0)], ROWS))
    assert held(spark, store) == want | {("a", 102): 3.0}
    store.append(first.limit(0))
    assert store.read(spark).count() == 4


def test_upsert_replaces_and_leaves_other_partitions_alone(spark, store):
    rows = [(s, y * 100 + k, float(k)) for s in "abcdefgh" for y in range(5) for k in range(10)]
    store.append(spark.createDataFrame(rows, ROWS))
    before = state(store.path)
    store.upsert(spark.createDataFrame([("a", 203, 7.0), ("a", 203, 8.0), ("a", 299, 5.0)], ROWS))
    after = state(store.path)
    same = [f for f in before if after.get(f) == before[f]]
    gone = {f.rsplit("/", 1)[0] for f in before if f not in after}
    assert len(gone) == 1 and len(same) == len(before) - len([f for f in before if f.rsplit("/", 1)[0] in gone])
    want = {(s, d): c for s, d, c in rows} | {("a", 203): 8.0, ("a", 299): 5.0}
    assert held(spark, store) == want and store.read(spark).count() == len(want)


def test_a_batch_reads_only_its_partitions(spark, store):
    rows = [(s, y * 100, 1.0) for s in "abcdefgh" for y in range(6)]
    store.append(spark.createDataFrame(rows, ROWS))
    old = store.read(spark)
    touched = old.select("year", "bucket").where("year = 3").distinct().limit(1).collect()
    pruned = old.where(store._within(touched))
    assert len(pruned.inputFiles()) <= len(old.inputFiles())
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan

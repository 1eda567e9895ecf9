"""Bar tables laid out by symbol, so that a study plans no exchange of its bars.

``save_bars`` deals bars once into buckets by the hash of the symbol, sorted inside a
bucket by symbol and session, and registers the table.  Every window, aggregation
and join on ``symbol`` that reads it finds the distribution it needs; a study over
many rules or many days of work then starts from sorted files instead of moving all
bars over the network first.

The number of buckets is stored with the table, hence chosen once, by the size of the
bars (``bucket_count``).  A bucket is one task's share: a hot symbol costs its
bucket at most one bar a calendar day more (``operators/series.py``).

Defined cases: an empty table keeps its columns; a NULL symbol has its bucket; saving
again replaces the table; a table whose name exists is replaced only with ``replace``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "symbol"
ORDER = ("symbol", "session")
BARS_A_BUCKET = 4_000_000  # about 200 MB of eight columns


def bucket_count(bars: int, least: int = 1) -> int:
    """A power of two, so that tables of other sizes stay co-located after coalescing."""
    wanted, buckets = max(least, -(-bars // BARS_A_BUCKET)), 1
    while buckets < wanted:
        buckets *= 2
    return buckets


def save_bars(bars: DataFrame, table: str, buckets: int | None = None, path: str | None = None, replace: bool = False) -> DataFrame:
    """Write bars as a bucketed, sorted table and read it back.

    One exchange, by the same hash the buckets use, so every bucket is one file.
    """
    spark = bars.sparkSession
    if not replace and spark.catalog.tableExists(table):
        raise ValueError(f"table {table} exists")
    if buckets is None:
        buckets = bucket_count(bars.count())
    writer = bars.repartition(buckets, F.col(KEY)).write.mode("overwrite").format("parquet")
    writer = writer.bucketBy(buckets, KEY).sortBy(*ORDER)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return open_bars(spark, table)


def open_bars(spark: SparkSession, table: str) -> DataFrame:
    """The table with its layout; fails if it has none."""
    described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    if KEY not in described.get("Bucket Columns", ""):
        raise ValueError(f"{table} is not laid out by {KEY}")
    return spark.table(table)


def exchanges_of_bars(df: DataFrame) -> int:
    """Hash exchanges on the symbol in the plan of ``df``; none for a study of a table laid out by it."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(line.count("Exchange hashpartitioning(symbol#") for line in plan.splitlines())

"""Reference tables: memberships, listings, special-treatment intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.identity import SYMBOL, padded_symbol

MEMBERSHIP = "symbol string, active_from string, active_to string, source string"
# Listing states in reading order, and the marker inside names.
LISTING_STATES = ("L", "D", "P", "G")
ST_MARKER = "ST"
OPEN_START = "19700101"


def as_day(text: Column) -> Column:
    """yyyymmdd or yyyy-mm-dd to a date; anything else is NULL."""
    t = F.trim(text)
    return F.when(t.rlike("^[0-9]{8}$"), F.try_to_date(t, "yyyyMMdd")).when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(t, "yyyy-MM-dd"))


def read_memberships(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of intervals; a bad line fails the job with its content."""
    rows = spark.read.schema(MEMBERSHIP).option("mode", "FAILFAST").json(path)
    start, end = as_day(F.col("active_from")), as_day(F.col("active_to"))
    bad = (
        ~F.coalesce(padded_symbol(F.col("symbol")).rlike(SYMBOL), F.lit(False)) | start.isNull() | F.col("source").isNull()
        | ((F.coalesce(F.col("active_to"), F.lit("")) != "") & end.isNull()) | F.coalesce(end < start, F.lit(False))
    )
    line = F.to_json(F.struct(*rows.columns))
    symbol = F.when(bad, F.raise_error(F.concat(F.lit("invalid membership line: "), line)).cast("string")).otherwise(padded_symbol(F.col("symbol")))
    return rows.select(symbol.alias("symbol"), start.alias("active_from"), end.alias("active_to"), "source")


def normalize_listing(basics: DataFrame, order: str = "row_number") -> DataFrame:
    """One row per symbol: the first delisted record, else the last read.

    States are read in LISTING_STATES order and rows by ``order`` inside one;
    rows without a usable date or with a code of more than six characters are dropped.  An aggregate picks the winner.
    """
    symbol = padded_symbol(F.coalesce(F.col("symbol").cast("string"), F.lit("")))
    rows = basics.withColumns({"symbol": symbol, "active_from": as_day(F.col("list_date"))})
    rows = rows.where((F.length("symbol") == 6) & F.col("active_from").isNotNull() & F.col("list_status").isin(*LISTING_STATES))
    gone = F.col("list_status") == "D"
    rows = rows.withColumn("active_to", F.when(gone, as_day(F.col("delist_date"))))
    place = F.array_position(F.array(*[F.lit(s) for s in LISTING_STATES]), F.col("list_status"))
    rank = F.struct(gone.cast("int"), F.when(gone, -F.col(order)).otherwise(place), F.when(gone, F.lit(0)).otherwise(F.col(order)))
    keep = [c for c in ("ts_code", "name", "exchange", "market", "list_status", "active_from", "active_to") if c in rows.columns]
    return rows.groupBy("symbol").agg(F.max_by(F.struct(*keep), rank).alias("r")).select("symbol", "r.*")


def st_intervals(names: DataFrame) -> DataFrame:
    """Intervals during which the name carried the marker."""
    return names.where(F.col("name").contains(ST_MARKER)).select(
        padded_symbol(F.col("symbol")).alias("symbol"),
        as_day(F.coalesce(F.col("start_date"), F.lit(OPEN_START))).alias("active_from"),
        as_day(F.col("end_date")).alias("active_to"),
        "name",
    )

"""Reading, cleaning, composing and updating bar tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.identity import strict_symbol
from tidemark.functions.numeric import finite
from tidemark.operators.intervals import active
from tidemark.operators.series import checked_session, number_bars

PRICES = ("open", "high", "low", "close")
# Fixed value: the local-language name of the turnover column in older files.
AMOUNT_FALLBACK = "成交额"


def read_bars(spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None, day: str = "session") -> DataFrame:
    """All bar files under ``path``, one symbol per file, or a symbol-partitioned table.

    The symbol is the six digits of the file name unless the table already has
    the column.  The date range is a plain filter and reaches the Parquet scan.
    """
    df = spark.read.parquet(path)
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.regexp_extract(F.col("_metadata.file_name"), r"([0-9]{6})\.parquet$", 1)).where(F.col("symbol") != "")
    df = df.withColumn("symbol", strict_symbol(F.col("symbol")))
    if start is not None:
        df = df.where(F.col(day) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(day) <= F.lit(end))
    return df


def _number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    col = F.col(name)
    return finite(col if isinstance(kind, T.NumericType) else F.expr(f"try_cast(`{name}` AS double)"))


def repeated_sessions(rows: DataFrame) -> DataFrame:
    """(symbol, session) pairs that occur more than once, with their count."""
    return rows.groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def normalize_bars(raw: DataFrame, start: dt.date | None = None, end: dt.date | None = None, day: str | None = None) -> DataFrame:
    """Typed, filtered and numbered bars; a repeated session fails the job, as does
    a malformed symbol, an unparsable date or one outside the calendar.

    Order of steps: repeated sessions are looked for among all rows, then the
    range, then the price checks; ``prev_close`` is the close of the previous
    bar that survived both.  Finding repeats is part of the aggregation that
    brings each (symbol, session) together, so it needs no pass of its own.
    """
    day = day or ("session" if "session" in raw.columns else "date")
    missing = [p for p in PRICES if p not in raw.columns]
    if missing or day not in raw.columns:
        raise ValueError(f"bars lack columns: {missing or [day]}")
    amount = "amount" if "amount" in raw.columns else AMOUNT_FALLBACK if AMOUNT_FALLBACK in raw.columns else None
    null = F.lit(None).cast("double")
    parsed = F.to_date(F.col(day)) if not isinstance(raw.schema[day].dataType, T.StringType) else F.expr(f"try_to_date(`{day}`)")
    columns = {
        "symbol": strict_symbol(F.col("symbol")),
        "session": checked_session(parsed, F.col(day)),
        **{p: _number(raw, p) for p in PRICES},
        "volume": _number(raw, "volume") if "volume" in raw.columns else null,
        "amount": _number(raw, amount) if amount else null,
        "is_st": F.coalesce(F.col("is_st").cast("boolean"), F.lit(False)) if "is_st" in raw.columns else F.lit(False),
    }
    typed = raw.select(*[c.alias(n) for n, c in columns.items()])
    rest = [c for c in columns if c not in ("symbol", "session")]
    once = typed.groupBy("symbol", "session").agg(*[F.any_value(c).alias(c) for c in rest], F.count(F.lit(1)).alias("__n"))
    checked = once.withColumn(
        "close",
        F.when(F.col("__n") == 1, F.col("close")).otherwise(
            F.raise_error(F.concat(F.lit("repeated session "), F.col("symbol"), F.lit(" "), F.col("session").cast("string"))).cast("double")
        ),
    ).drop("__n")
    if start is not None:
        checked = checked.where(F.col("session") >= F.lit(start))
    if end is not None:
        checked = checked.where(F.col("session") <= F.lit(end))
    good = F.lit(True)
    for p in PRICES:
        good = good & F.col(p).isNotNull() & (F.col(p) > 0)
    good = good & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close"))
    bars = checked.where(good).withColumn("available_at", F.col("session").cast("timestamp") + F.expr("INTERVAL 15 HOURS"))
    return number_bars(bars)


def _latest(rows: DataFrame, rank: Column, key: tuple[str, ...] = ("symbol", "session")) -> DataFrame:
    """One row per key, the one with the highest rank.

    An aggregate, so a key holding most of the rows is folded in the map tasks.
    """
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("r")).select(*key, "r.*")


def compose_sources(bases: list[DataFrame], overlay: DataFrame | None = None) -> DataFrame:
    """First base that has a symbol supplies it; overlay rows replace equal sessions."""
    stacked = None
    for i, base in enumerate(bases):
        part = base.withColumn("__priority", F.lit(i))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    owner = stacked.groupBy("symbol").agg(F.min("__priority").alias("__owner"))
    chosen = stacked.join(owner, "symbol").where(F.col("__priority") == F.col("__owner")).drop("__owner").withColumn("__layer", F.lit(0))
    if overlay is not None:
        top = overlay.withColumns({"__priority": F.lit(-1), "__layer": F.lit(1)})
        chosen = _latest(chosen.unionByName(top, allowMissingColumns=True), F.col("__layer"))
    return chosen.drop("__priority", "__layer")


def adjust_prices(rows: DataFrame) -> DataFrame:
    """Prices = raw price x factor / last known factor of the symbol.

    Only for symbols with a positive last factor; the factor comes from an
    aggregate per symbol, not from a window over the series.
    """
    scale = rows.where(F.col("adj_factor").isNotNull()).groupBy("symbol").agg(F.max_by("adj_factor", "session").alias("__scale"))
    joined = rows.join(scale, "symbol", "left")
    usable = F.col("__scale") > 0
    return joined.withColumns(
        {p: F.when(usable, F.col(f"raw_{p}") * F.col("adj_factor") / F.col("__scale")).otherwise(F.col(p)) for p in PRICES}
    ).drop("__scale")


def overlay_rows(batch: DataFrame, factors: DataFrame, listing: DataFrame, st_intervals: DataFrame | None = None) -> DataFrame:
    """A day's vendor rows as overlay rows: amount in units, factor required."""
    rows = (
        batch.join(factors.select("ts_code", "trade_date", "adj_factor"), ["ts_code", "trade_date"])
        .where(F.col("adj_factor").isNotNull())
        .join(listing.select("ts_code", "symbol", "name"), "ts_code")
        .select(
            "symbol", F.to_date("trade_date", "yyyyMMdd").alias("session"), "name",
            *[F.col(p).cast("double").alias(f"raw_{p}") for p in PRICES], *[F.col(p).cast("double").alias(p) for p in PRICES],
            F.col("pre_close").cast("double").alias("raw_prev_close"), F.col("vol").cast("double").alias("volume"),
            F.col("amount").alias("amount_thousand"), (F.coalesce(F.col("amount"), F.lit(0.0)) * 1000).alias("amount"),
            F.col("adj_factor").cast("double").alias("adj_factor"),
        )
    )
    return rows.withColumn("is_st", F.lit(False)) if st_intervals is None else active(rows, st_intervals, flag="is_st")


def upsert_bars(existing: DataFrame, batch: DataFrame, order: str = "batch_no") -> DataFrame:
    """Overlay after a batch: the last write of a session wins."""
    old = existing.withColumn(order, F.lit(-1).cast("long"))
    new = batch if order in batch.columns else batch.withColumn(order, F.lit(0).cast("long"))
    return _latest(old.unionByName(new, allowMissingColumns=True), F.col(order)).drop(order)

"""Tables derived from the driver's parquet files, in Spark and as SQL.

The given tables hold no market bars; both sides derive them by the same rule:
suppliers fold into twenty symbols, a line item is a tick of its ship date.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import series
from tidemark.runtime import stage

OOS = dt.date(1999, 1, 1)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query, with its SQL where SQL can say it."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def symbol_of(idx: Column) -> Column:
    base = F.when(idx < 12, 600000).when(idx < 16, 300000).otherwise(688000)
    return (base + idx).cast("string")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", F.to_date("l_shipdate").alias("session")
    )
    step = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) % 1000
    li = li.withColumns({"idx": (F.col("l_suppkey") % 20).cast("int"), "step": step})
    return li.select(
        symbol_of(F.col("idx")).alias("symbol"),
        "session",
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000 + F.col("step")).alias("seq"),
        (50 + 8 * F.col("step").cast("double") / 1000).alias("price"),
        F.col("l_quantity").alias("volume"),
        F.col("l_extendedprice").alias("amount"),
        "idx",
    )


def raw_bars(spark: SparkSession, sf: str) -> DataFrame:
    b = series.build_bars(ticks(spark, sf))
    idx = F.substring("symbol", 4, 3).cast("int")
    st = (idx % 10 == 3) & F.year("session").isin(1997, 1998)
    return b.withColumns({"is_st": st, "available_at": F.col("session").cast("timestamp") + F.expr("INTERVAL 15 HOURS")})


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return series.number_bars(raw_bars(spark, sf))


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """One row per session, staged: a study reads it three times, and deriving it
    takes a scan of all ticks."""
    return stage(series.equal_weight_benchmark(series.build_bars(ticks(spark, sf))), "benchmark")


def memberships(spark: SparkSession, sf: str) -> DataFrame:
    """Index 0-14 open-ended from 1995, 15-19 from 1996 to mid 2000."""
    idx = F.col("s_suppkey") % 20
    s = table(spark, sf, "supplier").select(idx.cast("int").alias("idx")).distinct()
    early = F.col("idx") <= 14
    return s.select(
        symbol_of(F.col("idx")).alias("symbol"),
        F.when(early, F.lit(dt.date(1995, 1, 1))).otherwise(F.lit(dt.date(1996, 1, 1))).alias("active_from"),
        F.when(~early, F.lit(dt.date(2000, 6, 30))).alias("active_to"),
        F.lit("derived").alias("source"),
    )


def publish(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, dates as text: the form both engines agree on.

    ``rint`` on the scaled value is the same IEEE operation in both engines, so
    equal doubles stay equal also at a rounding boundary.
    """
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.rint(c * 10.0**digits) / 10.0**digits + 0.0
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, ",")
        out.append(c.alias(f.name))
    return df.select(*out)


# ---- SQL side ---------------------------------------------------------------
_SYMBOL = "CAST((CASE WHEN {i} < 12 THEN 600000 WHEN {i} < 16 THEN 300000 ELSE 688000 END) + {i} AS VARCHAR)"

BARS_SQL = f"""
t0 AS (SELECT CAST(l_suppkey % 20 AS INTEGER) AS idx, CAST(l_shipdate AS DATE) AS session, l_orderkey, l_linenumber, l_quantity, l_extendedprice,
         CAST(floor(l_extendedprice / l_quantity * 100) AS BIGINT) % 1000 AS step FROM lineitem),
ticks AS (SELECT {_SYMBOL.format(i='idx')} AS symbol, idx, session, (l_orderkey * 10 + l_linenumber) * 1000 + step AS seq,
         50 + 8 * CAST(step AS DOUBLE) / 1000 AS price, l_quantity AS volume, l_extendedprice AS amount FROM t0),
rawbars AS (SELECT symbol, session, any_value(idx) AS idx, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close,
         sum(volume) AS volume, sum(amount) AS amount,
         (any_value(idx) % 10 = 3 AND year(session) IN (1997, 1998)) AS is_st,
         CAST(session AS TIMESTAMP) + INTERVAL 15 HOUR AS available_at
         FROM ticks GROUP BY symbol, session),
bars AS (SELECT *, row_number() OVER w - 1 AS bar_ix, count(*) OVER (PARTITION BY symbol) AS n_bars, lag(close) OVER w AS prev_close
         FROM rawbars WINDOW w AS (PARTITION BY symbol ORDER BY session))"""

BENCH_SQL = "bench AS (SELECT session, avg(open) AS open, avg(close) AS close FROM rawbars GROUP BY session)"
REGIME_SQL = """reg AS (SELECT session, CASE WHEN row_number() OVER (ORDER BY session) < 60 THEN 'unknown'
         WHEN round_even(close * 1e10, 0) / 1e10 >= round_even(avg(close) OVER (ORDER BY session ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) * 1e10, 0) / 1e10
         THEN 'bullish' ELSE 'bearish' END AS regime FROM bench)"""
MEMBERS_SQL = f"""members AS (SELECT DISTINCT {_SYMBOL.format(i='CAST(s_suppkey % 20 AS INTEGER)')} AS symbol,
         CASE WHEN s_suppkey % 20 <= 14 THEN DATE '1995-01-01' ELSE DATE '1996-01-01' END AS active_from,
         CASE WHEN s_suppkey % 20 > 14 THEN DATE '2000-06-30' END AS active_to FROM supplier)"""


def with_bars(*more: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([BARS_SQL, *more])} {select}"


def r(expr: str, name: str, digits: int = 8) -> str:
    """A double rounded as ``publish`` does; adding 0.0 turns -0.0 into 0.0."""
    return f"round_even(({expr}) * 1e{digits}, 0) / 1e{digits} + 0.0 AS {name}"


def settled(expr: str) -> str:
    return f"(round_even(({expr}) * 1e10, 0) / 1e10)"


def p_value_sql(t: str) -> str:
    """2 * (1 - Phi(|t|)) from erf(x) = exp(-x^2) * sum x^(2n+1) / Gamma(n + 3/2)."""
    x = f"(abs({t}) / sqrt(2.0))"
    term = f"exp((2 * n + 1) * ln(greatest({x}, 1e-300)) - lgamma(n + 1.5) - {x} * {x})"
    return f"(CASE WHEN {t} IS NULL THEN NULL WHEN {x} > 6.0 THEN 0.0 ELSE 1.0 - (SELECT sum({term}) FROM range(0, 161) g(n)) END)"


Z95 = "1.959963984540054"

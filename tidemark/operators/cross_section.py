"""Scores against forward returns across symbols, benchmarks, return paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import settle
from tidemark.operators.series import by_symbol
from tidemark.runtime import stage


def in_buckets(counted: DataFrame, group: list[str], value: str, buckets: int) -> DataFrame:
    """Distinct values of each group in ordered buckets, column ``__b``, of about equal numbers.

    The borders are quantiles from a mergeable sketch whose error is a quarter of a
    bucket, so no bucket holds more than one and a half times the mean however the
    values lie.  They only place rows; ranks stay exact.
    """
    shares = [k / buckets for k in range(1, buckets)]
    borders = counted.groupBy(*group).agg(F.percentile_approx(value, shares, F.lit(4 * buckets)).alias("__borders"))
    below = F.size(F.filter("__borders", lambda border: border < F.col(value)))
    return counted.join(borders, group).withColumn("__b", below).drop("__borders")


def average_rank(rows: DataFrame, group: str | list[str], value: str, out: str, buckets: int = 64) -> DataFrame:
    """Average rank of ``value`` inside each group, ties sharing their mean rank.

    A session holds every symbol of the market, so no window may span it.  Equal
    values are counted first (ties collapse in the map tasks), so a heavy value is
    one row; distinct values fall into ordered buckets, the window that adds
    counts runs inside one bucket, and bucket totals supply the offset.
    NULL has no rank; NaN is the largest value.
    """
    group = [group] if isinstance(group, str) else group
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    cut = in_buckets(counted, group, value, buckets)
    totals = cut.groupBy(*group, "__b").agg(F.sum("__n").alias("__t"))
    # at most ``buckets`` rows per group
    earlier = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "__b", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*group, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = cut.join(offsets, [*group, "__b"]).withColumn(
        out, F.col("__off") + F.sum("__n").over(inside) - (F.col("__n") - 1) / 2.0
    )
    return rows.join(ranked.select(*group, value, out), [*group, value], "left")


def daily_ic(rows: DataFrame, score: str = "score", label: str = "label", day: str = "session") -> DataFrame:
    """Correlation and rank correlation of score and label per day.

    The rows are written once and both sides are ranked in one pass, so what
    they are derived from is scanned once.
    """
    both = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    both = stage(both.select("symbol", day, F.col(score).cast("double").alias(score), F.col(label).cast("double").alias(label)), "scored")
    side = lambda k, name: F.struct(F.lit(k).alias("side"), F.col(name).alias("value"))
    sides = both.select("symbol", day, F.explode(F.array(side(0, score), side(1, label))).alias("x")).select("symbol", day, "x.side", "x.value")
    ranks = average_rank(sides, [day, "side"], "value", "rank")
    pick = lambda name, k: F.max(F.when(F.col("side") == k, F.col(name)))
    paired = ranks.groupBy(day, "symbol").agg(
        pick("value", 0).alias("__s"), pick("value", 1).alias("__l"), pick("rank", 0).alias("__rs"), pick("rank", 1).alias("__rl")
    )
    return paired.groupBy(day).agg(
        F.count(F.lit(1)).alias("symbols"),
        _corr("__s", "__l").alias("ic"),
        _corr("__rs", "__rl").alias("rank_ic"),
    )


def _corr(a: str, b: str) -> Column:
    """NULL when a side does not vary; settled, so that zero has no sign."""
    flat = (F.count(F.lit(1)) < 2) | (F.max(a) == F.min(a)) | (F.max(b) == F.min(b))
    return F.when(~flat, settle(F.corr(a, b)))


def ic_by_year(ics: DataFrame, day: str = "session") -> DataFrame:
    """Mean, deviation, information ratio and share of positive days per year."""
    cols = []
    for name in ("ic", "rank_ic"):
        mean, sd = F.avg(name), F.stddev_samp(name)
        cols += [
            mean.alias(f"{name}_mean"), sd.alias(f"{name}_std"), F.when(sd > 0, mean / sd).alias(f"{name}_ir"),
            F.avg((F.col(name) > 0).cast("double")).alias(f"{name}_positive_share"),
        ]
    return ics.groupBy(F.year(day).alias("year")).agg(F.count("ic").alias("days"), *cols)


def equal_weight_returns(cells: DataFrame) -> DataFrame:
    """Mean close-to-close return over symbols with both consecutive closes.

    ``cells`` is the calendar grid with raw closes: a session missing on either
    side drops the symbol for that day; nothing is filled.
    """
    w = by_symbol()
    change = F.try_divide(F.col("close"), F.lag("close").over(w)) - 1.0
    rows = cells.select("session", change.alias("r")).where(F.col("r").isNotNull())
    return rows.groupBy("session").agg(F.avg("r").alias("daily_return"), F.count(F.lit(1)).alias("symbols"))


def path_statistics(returns: DataFrame, benchmark: DataFrame | None = None, value: str = "daily_return", day: str = "session") -> DataFrame:
    """Per year: compounded return, worst drawdown, and excess over a benchmark.

    Drawdown is measured against the running peak of the whole path, starting
    capital included.  One row per day, hence the window without partition.
    """
    order = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    path = returns.withColumn("__wealth", F.exp(F.sum(F.log1p(value)).over(order)))
    path = path.withColumn("__peak", F.greatest(F.lit(1.0), F.max("__wealth").over(order)))
    path = path.withColumn("__drop", F.col("__wealth") / F.col("__peak") - 1.0)
    if benchmark is not None:
        path = path.join(F.broadcast(benchmark.select(day, F.col(value).alias("__b"))), day, "left")
    else:
        path = path.withColumn("__b", F.lit(None).cast("double"))
    out = path.groupBy(F.year(day).alias("year")).agg(
        F.count(F.lit(1)).alias("days"),
        (F.exp(F.sum(F.log1p(value))) - 1.0).alias("compounded"),
        F.min("__drop").alias("max_drawdown"),
        (F.exp(F.sum(F.log1p("__b"))) - 1.0).alias("benchmark_compounded"),
    )
    return out.withColumn("excess", F.col("compounded") - F.col("benchmark_compounded"))

"""Membership intervals: ``[active_from, active_to]``, open when the end is NULL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import FIRST_DAY, LAST_DAY


def _covers(day: Column) -> Column:
    return (day >= F.col("active_from")) & (F.col("active_to").isNull() | (day <= F.col("active_to")))


def _year(day: Column) -> Column:
    """Year of a day; days outside the calendar fall into its first or last year."""
    return F.least(F.greatest(F.year(day), F.lit(FIRST_DAY.year)), F.lit(LAST_DAY.year))


def _by_year(spans: DataFrame, start: str, end: str) -> DataFrame:
    """Each span once for every year it touches, as ``__y``; a reversed or unbegun span has none."""
    last = F.coalesce(_year(F.col(end)), F.lit(LAST_DAY.year))
    right = F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) <= F.col(end)))
    upto = F.when(F.col(end).isNull(), F.lit(LAST_DAY.year)).otherwise(last)
    return spans.where(right).withColumn("__y", F.explode(F.sequence(_year(F.col(start)), upto)))


def members_only(rows: DataFrame, memberships: DataFrame, day: str = "session") -> DataFrame:
    """Rows whose symbol is a member on the row's own date (left semi join).

    Equi join on symbol and year with the range as residual: a bar meets the
    intervals that touch its year, not all of its symbol.  The interval table
    grows with the universe, so no broadcast is forced: Spark picks one under its
    own size limit, and AQE splits a hot symbol of the row side.
    """
    m = _by_year(memberships.select(F.col("symbol").alias("__s"), "active_from", "active_to"), "active_from", "active_to")
    met = (F.col("symbol") == F.col("__s")) & (_year(F.col(day)) == F.col("__y"))
    return rows.join(m, met & _covers(F.col(day)), "left_semi")


def covered(memberships: DataFrame) -> DataFrame:
    """Disjoint spans per symbol: overlapping and adjoining intervals merged.

    Every interval adds one at its start and takes one after its end; the
    changes of a day are summed in the map tasks first, so the running sum sees
    one row per symbol and calendar day however many intervals there are.
    """
    start = F.greatest("active_from", F.lit(FIRST_DAY))
    after = F.date_add(F.least(F.coalesce("active_to", F.lit(LAST_DAY)), F.lit(LAST_DAY)), 1)
    edge = lambda day, step: F.struct(day.alias("day"), F.lit(step).alias("step"))
    steps = (
        memberships.where(start < after)
        .select("symbol", F.explode(F.array(edge(start, 1), edge(after, -1))).alias("e"))
        .groupBy("symbol", "e.day").agg(F.sum("e.step").alias("step")).where("step <> 0")
    )
    order = Window.partitionBy("symbol").orderBy("day")
    depth = steps.withColumn("depth", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    turns = depth.withColumn("before", F.coalesce(F.lag("depth").over(order), F.lit(0))).where("(before = 0) <> (depth = 0)")
    ends = turns.withColumn("after", F.lead("day").over(order)).where("depth > 0")
    return ends.select("symbol", F.col("day").alias("active_from"), F.date_sub("after", 1).alias("active_to"))


def active(rows: DataFrame, memberships: DataFrame, day: str = "session", flag: str = "is_member") -> DataFrame:
    """All rows with a membership flag, each row once.

    A day lies in at most one disjoint span, so the left join repeats nothing; the
    years a span touches are keys beside the symbol.
    """
    spans = covered(memberships).select(F.col("symbol").alias("__s"), F.col("active_from").alias("__from"), F.col("active_to").alias("__to"))
    inside = (F.col("symbol") == F.col("__s")) & (_year(F.col(day)) == F.col("__y")) & F.col(day).between(F.col("__from"), F.col("__to"))
    return rows.join(_by_year(spans, "__from", "__to"), inside, "left").withColumn(flag, F.col("__s").isNotNull()).drop("__s", "__from", "__to", "__y")


def members_on(memberships: DataFrame, day: dt.date) -> DataFrame:
    return memberships.where(_covers(F.lit(day))).select("symbol").distinct()


def missing_prices(memberships: DataFrame, bars: DataFrame, day: dt.date | None = None) -> DataFrame:
    """Members without any bar."""
    universe = memberships.select("symbol").distinct() if day is None else members_on(memberships, day)
    return universe.join(bars.select("symbol").distinct(), "symbol", "left_anti")


def price_coverage(memberships: DataFrame, bars: DataFrame, day: dt.date | None = None) -> DataFrame:
    """Universe size, members without bars and the covered share."""
    universe = memberships.select("symbol").distinct() if day is None else members_on(memberships, day)
    have = bars.select("symbol").distinct().withColumn("__has", F.lit(1))
    joined = universe.join(have, "symbol", "left").agg(
        F.count(F.lit(1)).alias("universe_symbols"), F.count_if(F.col("__has").isNull()).alias("missing_symbols")
    )
    ratio = F.coalesce(F.try_divide((F.col("universe_symbols") - F.col("missing_symbols")).cast("double"), F.col("universe_symbols")), F.lit(0.0))
    return joined.withColumns(
        {"coverage_ratio": ratio, "status": F.when(F.col("missing_symbols") == 0, "complete").otherwise("incomplete_price_history")}
    )


def st_audit(bars: DataFrame, st_intervals: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Per dataset: rows, cached and derived flags, and how often they differ."""
    flagged = active(bars, st_intervals, flag="__expected")
    cached = F.coalesce(F.col("is_st"), F.lit(False))
    return flagged.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(cached).alias("cached_st"),
        F.count_if(F.col("__expected")).alias("expected_st"),
        F.count_if(cached != F.col("__expected")).alias("mismatches"),
        F.count_distinct(F.when(cached != F.col("__expected"), F.col("symbol"))).alias("mismatched_symbols"),
    )

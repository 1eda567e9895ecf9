"""Coverage of members by bars, gaps, and their repair from other sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.selection import select_rank

# Thresholds of the coverage audit.
ADEQUATE_RATIO = 0.99
MAX_INTERNAL_MISSING = 3
MIN_YEAR_ADEQUATE = 0.95
MIN_NONACTIVE_ADEQUATE = 0.90
MAX_ZERO_COVERAGE = 0.005
MIN_OVERLAP = 20
SCALE_TOLERANCE = 1e-6


def profile(bars: DataFrame, active: DataFrame, requested: DataFrame, as_of: dt.date, minimum_bars: int = 60, freshness_days: int = 14) -> DataFrame:
    """One row of totals: loaded, short, stale and fresh symbols, and a status."""
    per = (
        bars.where(F.col("session") <= F.lit(as_of))
        .groupBy("symbol")
        .agg(F.count(F.lit(1)).alias("n"), F.min("session").alias("first"), F.max("session").alias("last"))
    )
    live = active.select("symbol").distinct().withColumn("__active", F.lit(True))
    rows = requested.select("symbol").distinct().join(per, "symbol", "left").join(live, "symbol", "left")
    cutoff = F.date_sub(F.lit(as_of), freshness_days)
    is_active = F.coalesce(F.col("__active"), F.lit(False))
    has = F.col("n").isNotNull()
    out = rows.agg(
        F.count(F.lit(1)).alias("symbols_requested"),
        F.count_if(has).alias("symbols_loaded"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_loaded"),
        F.min("first").alias("earliest"),
        F.max("last").alias("latest"),
        F.count_if(is_active).alias("active_symbols"),
        F.count_if(has & (F.col("n") < minimum_bars)).alias("short_histories"),
        F.count_if(~has).alias("load_failures"),
        F.count_if(is_active & (F.col("last") < cutoff)).alias("stale_active"),
        F.count_if(is_active & (F.col("last") >= cutoff)).alias("fresh_active"),
    )
    ratio = F.when(F.col("active_symbols") > 0, F.col("fresh_active") / F.col("active_symbols")).otherwise(0.0)
    out = out.withColumn("freshness_ratio", ratio)
    return out.withColumn("status", F.when((F.col("load_failures") == 0) & (F.col("freshness_ratio") >= 0.99), "passed").otherwise("failed"))


def feasibility(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per symbol: observed, zero-volume, ST and one-price sessions, and missing ones."""
    one_price = (F.col("open") == F.col("high")) & (F.col("open") == F.col("low")) & (F.col("open") == F.col("close"))
    size = calendar.select("session").distinct().agg(F.count(F.lit(1)).alias("n"))
    return (
        bars.groupBy("symbol")
        .agg(
            F.count(F.lit(1)).alias("observed_sessions"),
            F.count_if(F.col("volume") <= 0).alias("zero_volume"),
            F.count_if("is_st").alias("st_rows"),
            F.count_if(one_price).alias("one_price_boards"),
        )
        .withColumn("calendar_count", size.scalar())
        .withColumn("missing_sessions", F.col("calendar_count") - F.col("observed_sessions"))
    )


def _positions(calendar: DataFrame) -> DataFrame:
    """(day, rank): sessions up to and including each day of the calendar span.

    Interval lengths in sessions become two lookups, with no range join; the
    table has one row per calendar day.
    """
    days = calendar.select("session").distinct().withColumn("rank", F.row_number().over(Window.orderBy("session")))
    nxt = F.lead("session").over(Window.orderBy("session"))
    span = days.select("session", "rank", F.coalesce(nxt, F.date_add("session", 1)).alias("until"))
    return span.select(F.explode(F.sequence("session", F.date_sub("until", 1))).alias("day"), "rank")


def member_years(memberships: DataFrame, bars: DataFrame, calendar: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Expected against observed sessions per member and year.

    Sessions are numbered, so expected counts and edge gaps come from ranks of
    interval ends, and the bars side shrinks to one row per member-year in the
    map tasks before anything is joined to it.
    """
    lo, hi = years
    years_of = F.sequence(
        F.greatest(F.year("active_from"), F.lit(lo)), F.least(F.coalesce(F.year("active_to"), F.lit(hi)), F.lit(hi))
    )
    live = memberships.where((F.year("active_from") <= hi) & F.coalesce(F.year("active_to") >= lo, F.lit(True)))
    m = live.select("symbol", "active_from", "active_to", F.explode(years_of).alias("year"))
    first, last = F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31))
    m = m.withColumns({"start": F.greatest("active_from", first), "stop": F.least(F.coalesce("active_to", last), last)})
    m = m.withColumn("structural", (F.col("start") > first) | (F.col("stop") < last))

    span = calendar.agg(F.min("session").alias("a"), F.max("session").alias("b"))
    pos = F.broadcast(_positions(calendar))
    clamp = lambda d: F.least(d, F.col("__cal.b"))
    m = m.withColumn("__cal", span.select(F.struct("a", "b").alias("x")).scalar())
    m = m.withColumns({"__before": clamp(F.date_sub("start", 1)), "__end": clamp(F.col("stop"))})
    m = m.join(pos.select(F.col("day").alias("__before"), F.col("rank").alias("__r0")), "__before", "left")
    m = m.join(pos.select(F.col("day").alias("__end"), F.col("rank").alias("__r1")), "__end", "left")
    m = m.withColumns({"__r0": F.coalesce("__r0", F.lit(0)), "__r1": F.coalesce("__r1", F.lit(0))})
    m = m.withColumn("expected", (F.col("__r1") - F.col("__r0")).cast("long"))

    ranked = bars.select("symbol", "session", F.year("session").alias("year")).join(pos.select(F.col("day").alias("session"), "rank"), "session")
    seen = (
        ranked.join(m.select("symbol", "active_from", "year", "start", "stop"), ["symbol", "year"])
        .where(F.col("session").between(F.col("start"), F.col("stop")))
        .groupBy("symbol", "active_from", "year")
        .agg(F.count(F.lit(1)).alias("observed"), F.min("rank").alias("__lo"), F.max("rank").alias("__hi"))
    )
    rows = m.join(seen, ["symbol", "active_from", "year"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    none = F.col("observed") == 0
    rows = rows.withColumns(
        {
            "ratio": F.when(F.col("expected") > 0, F.col("observed") / F.col("expected")).otherwise(1.0),
            "first_gap": F.when(none, F.col("expected")).otherwise(F.col("__lo") - F.col("__r0") - 1),
            "last_gap": F.when(none, 0).otherwise(F.col("__r1") - F.col("__hi")),
            "internal_gap": F.when(none, 0).otherwise(F.col("__hi") - F.col("__lo") + 1 - F.col("observed")),
        }
    )
    zero = (F.col("expected") > 0) & none
    category = (
        F.when(zero, "zero_coverage")
        .when(F.col("structural") & (F.col("observed") == F.col("expected")), "structural_partial_due_listing_or_delisting")
        .when(F.col("internal_gap") > 0, "unexplained_internal_gaps")
        .when((F.col("first_gap") > 0) | (F.col("last_gap") > 0), "unexplained_edge_gaps")
        .otherwise("full_year_coverage")
    )
    return rows.select(
        "symbol", "active_from", "active_to", "year", "start", "stop", "expected", "observed", "ratio", "first_gap", "last_gap", "internal_gap", "structural",
        (~zero & (F.col("ratio") >= ADEQUATE_RATIO) & (F.col("internal_gap") <= MAX_INTERNAL_MISSING)).alias("adequate"),
        category.alias("category"),
    )


def year_thresholds(rows: DataFrame) -> DataFrame:
    """Shares per year and whether the year passes all three thresholds."""
    gone = F.col("active_to").isNotNull()
    out = rows.groupBy("year").agg(
        F.count(F.lit(1)).alias("members"),
        F.count_if("adequate").alias("adequate_members"),
        F.count_if(gone).alias("nonactive_members"),
        F.count_if(gone & F.col("adequate")).alias("nonactive_adequate"),
        F.count_if(F.col("category") == "zero_coverage").alias("zero_members"),
    )
    out = out.withColumns(
        {
            "adequate_ratio": F.col("adequate_members") / F.col("members"),
            "nonactive_adequate_ratio": F.when(F.col("nonactive_members") > 0, F.col("nonactive_adequate") / F.col("nonactive_members")).otherwise(1.0),
            "zero_ratio": F.col("zero_members") / F.col("members"),
        }
    )
    ok = (
        (F.col("adequate_ratio") >= MIN_YEAR_ADEQUATE)
        & (F.col("nonactive_adequate_ratio") >= MIN_NONACTIVE_ADEQUATE)
        & (F.col("zero_ratio") <= MAX_ZERO_COVERAGE)
    )
    return out.withColumn("passes", ok)


def price_basis(base: DataFrame, donor: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Whether a donor's prices are the base prices times one constant.

    The scale is the upper median of the close ratios: the element at n/2 of
    the sorted overlap, selected by histograms, so no overlap is ever listed.
    """
    prices = ("open", "high", "low", "close")
    left = base.select(*by, "session", *[F.col(p).alias(f"__b_{p}") for p in prices]) if "source_id" not in by else base
    both = donor.join(left, [c for c in (*by, "session") if c in left.columns])
    scale = F.col("close") / F.col("__b_close")
    spread = F.greatest(*[F.abs((F.col(p) / F.col(f"__b_{p}")) / scale - 1.0) for p in prices])
    out = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("overlap_sessions"), F.max(spread).alias("ohlc_dispersion"), F.min(scale).alias("__lo"), F.max(scale).alias("__hi")
    )
    ranks = out.select(*by, F.expr("overlap_sessions div 2 + 1").alias("rank"))
    median = select_rank(both.select(*by, scale.alias("close_ratio_median")), list(by), "close_ratio_median", ranks)
    out = out.join(median, list(by), "left")
    m = F.col("close_ratio_median")
    worst = F.greatest(F.abs(F.col("__lo") / m - 1.0), F.abs(F.col("__hi") / m - 1.0))
    out = out.select(*by, "overlap_sessions", "ohlc_dispersion", "close_ratio_median", worst.alias("close_dispersion"))
    reason = (
        F.when(F.col("overlap_sessions") < MIN_OVERLAP, "insufficient_overlap")
        .when((F.col("close_dispersion") <= SCALE_TOLERANCE) & (F.col("ohlc_dispersion") <= SCALE_TOLERANCE), "accepted_constant_ohlc_scale")
        .otherwise("incompatible_adjustment_basis")
    )
    return out.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "accepted_constant_ohlc_scale")


def missing_sessions(memberships: DataFrame, bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sessions a member should have and has not."""
    days = calendar.agg(F.array_sort(F.collect_set("session")).alias("d"))
    due = F.filter(
        F.col("__days"), lambda d: (d >= F.col("active_from")) & (F.col("active_to").isNull() | (d <= F.col("active_to")))
    )
    expected = memberships.withColumn("__days", days.scalar()).select("symbol", F.explode(due).alias("session")).distinct()
    return expected.join(bars.select("symbol", "session"), ["symbol", "session"], "left_anti")


def fill_gaps(missing: DataFrame, bars: DataFrame, donors: DataFrame) -> DataFrame:
    """Fill each symbol's gaps from its first compatible donor.

    ``donors``: source_id, priority, symbol, session, prices, volume.  As in the
    audit, one donor serves a whole symbol: the one with the lowest priority
    number whose price basis is accepted.
    """
    prices = ("open", "high", "low", "close")
    own = bars.select("symbol", "session", *[F.col(p).alias(f"__b_{p}") for p in prices])
    verdict = price_basis(own, donors, by=("source_id", "symbol"))
    order = donors.select("source_id", "priority").distinct()
    chosen = (
        verdict.where("accepted").join(order, "source_id").groupBy("symbol").agg(F.min_by("source_id", "priority").alias("source_id"))
    )
    return donors.join(missing, ["symbol", "session"], "left_semi").join(chosen, ["symbol", "source_id"], "left_semi")

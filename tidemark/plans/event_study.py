"""One rule over all bars: signals, gated outcomes, report and statistics."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identity import short_id
from tidemark.functions.metrics import amount_floor
from tidemark.operators import outcomes as oc
from tidemark.operators import stats
from tidemark.operators.indicators import market_regime
from tidemark.operators.quality import check_boundaries
from tidemark.operators.rules import Rule
from tidemark.operators.series import number_bars
from tidemark.operators.signals import explanation, lookback, matches, prepare


def flag_signals(
    bars: DataFrame,
    rule: Rule,
    study: oc.Study,
    min_bars: int | None = None,
    snapshot: str = "",
) -> DataFrame:
    """All numbered bars with ``is_signal`` (condition, warm-up, amount floor).

    Series not longer than look-back + longest horizon yield no signal.
    """
    need = lookback(rule) + max(study.horizons) + 1 if min_bars is None else min_bars
    keep = bars.columns
    df = prepare(bars, [rule])
    hit = matches(rule) & (F.col("n_bars") >= need) & (F.col("bar_ix") < F.col("n_bars") - 1)
    if study.min_signal_amount is not None:
        hit = hit & amount_floor(F.col("amount"), study.min_signal_amount)
    extra = {
        "is_signal": hit,
        "rule_id": F.lit(rule.id),
        "rule_version": F.lit(rule.version),
        "conditions": explanation(rule),
        "observation_id": short_id("obs_", F.col("symbol"), F.col("session"), F.lit(rule.name), F.lit(snapshot)),
    }
    return df.withColumns(extra).select(*keep, *extra)


def run(
    bars: DataFrame,
    rule: Rule,
    benchmark: DataFrame | None = None,
    memberships: DataFrame | None = None,
    study: oc.Study = oc.Study(),
    snapshot: str = "",
) -> DataFrame:
    """Outcomes of one rule, one row per observation and horizon.

    One exchange on symbol carries indicators, signal and forward frames; the
    benchmark and its regime join by exact date from a per-day broadcast.
    """
    flagged = flag_signals(bars, rule, study, snapshot=snapshot)
    rows = oc.outcomes(flagged, benchmark, study, memberships=memberships).withColumnRenamed("amount", "signal_amount")
    return with_regime(rows, benchmark, study)


def with_regime(rows: DataFrame, benchmark: DataFrame | None, study: oc.Study) -> DataFrame:
    """Regime of the signal date; sessions the benchmark lacks are unknown."""
    if benchmark is None:
        return rows.withColumn("regime", F.lit("unknown"))
    regime = market_regime(benchmark, study.regime_window).select("session", "regime")
    return rows.join(F.broadcast(regime), "session", "left").withColumn("regime", F.coalesce("regime", F.lit("unknown")))


def run_within(
    bars: DataFrame, rule: Rule, start: dt.date, oos_start: dt.date, end: dt.date, lockbox: dt.date, **kwargs
) -> DataFrame:
    """``run`` inside explicit dates; the end cuts the bars before any lead."""

    check_boundaries(start, oos_start, end, lockbox)
    inside = bars.where(F.col("session").between(F.lit(start), F.lit(end)))
    base = inside.drop("bar_ix", "n_bars", "prev_close")
    study = kwargs.pop("study", oc.Study())

    return run(number_bars(base), rule, study=replace(study, oos_start=oos_start), **kwargs)


def statistics(rows: DataFrame) -> DataFrame:
    """Out-of-sample groups by horizon and regime with adjusted p values."""
    oos = rows.where(F.col("sample_split") == "out_of_sample")
    return stats.false_discovery(stats.summarize(oos, ["horizon", "regime"]), skip_null=True)

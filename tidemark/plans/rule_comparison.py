"""Compare a few rules: cooled-down events, overlap, dated tests, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import events as ev
from tidemark.operators import outcomes as oc
from tidemark.operators import stats
from tidemark.operators.rules import Rule
from tidemark.operators.signals import each_match, scan
from tidemark.plans.event_study import with_regime
from tidemark.runtime import stage


def rule_outcomes(bars: DataFrame, rules: list[Rule], benchmark: DataFrame, study: oc.Study) -> DataFrame:
    """Gated outcomes of all rules; forward columns once per bar."""
    ahead = oc.look_ahead(oc.gate_flags(scan(bars, rules)), study.horizons, excursions=False).where(F.size("matched") > 0)
    legs = oc.benchmark_return(oc.stack_horizons(ahead, study.horizons, excursions=False), benchmark)
    rows = with_regime(oc.returns(legs, study), benchmark, study)
    names = F.array(*[F.lit(r.id) for r in rules])
    return each_match(rows).withColumn("rule_id", F.element_at(names, F.col("rule") + 1)).drop("rule")


def cooled(rows: DataFrame, bars: int = 20) -> DataFrame:
    """Only the outcomes whose event survives the cooldown.

    An event counts when it has at least one out-of-sample outcome with a known
    excess; its horizons then stand or fall together.
    """
    valid = rows.where((F.col("sample_split") == "out_of_sample") & F.col("net_excess_return").isNotNull())
    kept = ev.cooldown(valid.select("rule_id", "symbol", "bar_ix"), bars)
    return valid.join(kept, ["rule_id", "symbol", "bar_ix"], "left_semi")


def dated_tests(events: DataFrame, study: oc.Study, regime: str = "bearish") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(primary tests with FDR, the same under stress, positive-year shares)."""
    daily = stats.daily_effects(events)
    primary = stats.hac(daily.where(F.col("regime") == regime), max_lag=max(study.horizons))
    primary = stats.false_discovery(primary, alpha=study.alpha)
    return primary, stressed_tests(daily.where(F.col("regime") == regime), study), stats.positive_year_share(daily)


def stressed_tests(daily: DataFrame, study: oc.Study) -> DataFrame:
    """HAC tests with cost multiples taken off every daily effect."""
    legs = F.array(*[F.lit(float(m)) for m in study.stress])
    moved = daily.withColumn("multiple", F.explode(legs)).withColumn("effect", F.col("effect") - (F.col("multiple") - 1.0) * study.round_trip)
    return stats.hac(moved, by=[*stats.SERIES, "multiple"], max_lag=max(study.horizons))


def ranking(bars: DataFrame, rules: list[Rule], benchmark: DataFrame, study: oc.Study, cooldown: int = 20, required_multiple: float = 2.0, families: dict[str, str] | None = None, overlap_threshold: float = 0.6, **gates) -> DataFrame:
    """All of the above; the outcome rows are used five times, so they are staged."""
    rows = cooled(stage(rule_outcomes(bars, rules, benchmark, study), "outcomes"), cooldown)
    primary, stress, years = dated_tests(rows, study)
    overlaps = ev.overlap(rows.select("rule_id", "symbol", "bar_ix").distinct(), [r.id for r in rules])
    others = stats.hac(stats.daily_effects(rows).where(F.col("regime") != "bearish"), max_lag=max(study.horizons))
    ranked = stats.rank_rules(primary, stress.where(F.col("multiple") == required_multiple), years, ev.mean_uniqueness(overlaps), others=others, **gates)
    return stats.drop_redundant(ranked, overlaps, [r.id for r in rules], families, overlap_threshold)

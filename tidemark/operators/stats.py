"""Summaries of outcomes and the tests on them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import finite, two_sided_p, z_critical
from tidemark.operators.outcomes import Study


def valid_outcome(value: str = "net_excess_return") -> Column:
    return (F.coalesce(F.col("horizon") > 0, F.lit(False))) & finite(F.col(value)).isNotNull()


def summarize(outcomes: DataFrame, by: list[str], value: str = "net_excess_return", level: float = 0.95) -> DataFrame:
    """Count, mean, sample deviation, t, p and normal interval per group.

    Rows with a missing or non-finite value or a horizon under 1 do not count.
    One aggregation with map-side partials; what is shuffled is groups.
    """
    rows = outcomes.where(valid_outcome(value))
    groups = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sample_size"), F.avg(value).alias("mean_return"), F.stddev_samp(value).alias("sample_stddev")
    )
    return describe(groups, level)


def describe(groups: DataFrame, level: float = 0.95) -> DataFrame:
    """The derived columns of ``summarize`` from count, mean and deviation."""
    z = z_critical(level)
    enough = F.col("sample_size") >= 2
    out = groups.withColumn("sample_stddev", F.when(enough, F.col("sample_stddev")))
    out = out.withColumn("standard_error", F.col("sample_stddev") / F.sqrt("sample_size"))
    out = out.withColumns(
        {
            # a spread under rounding noise of the mean is a zero spread
            "t_statistic": F.when(
                F.col("standard_error") > F.abs("mean_return") * 1e-14, F.col("mean_return") / F.col("standard_error")
            ),
            "ci_lower": F.col("mean_return") - z * F.col("standard_error"),
            "ci_upper": F.col("mean_return") + z * F.col("standard_error"),
            "evidence_status": F.when(enough, "descriptive_only").otherwise("insufficient_sample"),
        }
    )
    return out.withColumn("raw_p_value", two_sided_p(F.col("t_statistic")))


def exclusions(outcomes: DataFrame, value: str = "net_excess_return") -> DataFrame:
    return outcomes.agg(
        F.count(F.lit(1)).alias("outcomes_received"), F.count_if(~valid_outcome(value)).alias("outcomes_excluded")
    )


def false_discovery(
    tests: DataFrame,
    family: list[str] | None = None,
    p: str = "raw_p_value",
    alpha: float = 0.05,
    adjusted: str = "adjusted_p_value",
    reject: str = "multiple_testing_reject",
    skip_null: bool = False,
) -> DataFrame:
    """Benjamini-Hochberg within each family.

    A NULL p counts as 1 and never rejects; with ``skip_null`` it stays out of
    the family.  A family is rules x horizons x regimes of one run, never data
    rows, so its window group does not grow with the data.
    """
    raw = F.coalesce(F.col(p), F.lit(1.0))
    member = F.col(p).isNotNull() if skip_null else F.lit(True)
    keys = [F.col(c) for c in (family or [])] + [member]
    ordered = Window.partitionBy(*keys).orderBy(raw)
    ranked = tests.withColumns(
        {"__rank": F.row_number().over(ordered), "__m": F.count(F.lit(1)).over(Window.partitionBy(*keys))}
    )
    upward = Window.partitionBy(*keys).orderBy(F.col("__rank")).rowsBetween(0, Window.unboundedFollowing)
    value = F.least(F.lit(1.0), F.min(raw * F.col("__m") / F.col("__rank")).over(upward))
    out = ranked.withColumn(adjusted, F.when(member, value) if skip_null else value)
    hit = F.col(p).isNotNull() & (F.col(adjusted) <= alpha)
    return out.withColumn(reject, F.coalesce(hit, F.lit(False))).drop("__rank", "__m")


def report(outcomes: DataFrame) -> DataFrame:
    """Counts, win rate and means for all outcomes and for each split, per horizon."""
    rows = outcomes.select("sample_split", "horizon", "net_return", "benchmark_return", "net_excess_return", "mfe", "mae")
    sets = rows.groupingSets(
        [["horizon"], ["sample_split", "horizon"]], F.col("sample_split"), F.col("horizon")
    ).agg(
        F.grouping("sample_split").alias("__all"),
        F.count(F.lit(1)).alias("outcomes"),
        F.avg((F.col("net_return") > 0).cast("double")).alias("win_rate"),
        F.avg("net_return").alias("mean_net"),
        F.avg("benchmark_return").alias("mean_benchmark"),
        F.avg("net_excess_return").alias("mean_net_excess"),
        F.avg("mfe").alias("mean_mfe"),
        F.avg("mae").alias("mean_mae"),
    )
    section = F.when(F.col("__all") == 1, "all").otherwise(F.col("sample_split"))
    return sets.select(section.alias("section"), *[c for c in sets.columns if c not in ("sample_split", "__all")])


def regime_means(outcomes: DataFrame, horizon: int = 3) -> DataFrame:
    """Out-of-sample mean net excess of one horizon by market regime."""
    rows = outcomes.where((F.col("sample_split") == "out_of_sample") & (F.col("horizon") == horizon) & F.col("net_excess_return").isNotNull())
    return rows.groupBy("regime").agg(F.count(F.lit(1)).alias("outcomes"), F.avg("net_excess_return").alias("mean_net_excess"))


# ---- dated series -----------------------------------------------------------
SERIES = ["rule_id", "horizon", "regime"]


def daily_effects(outcomes: DataFrame, by: list[str] = SERIES, value: str = "net_excess_return", day: str = "session") -> DataFrame:
    """Mean effect of all events of one signal date: cross-section first."""
    return (
        outcomes.where(F.col(value).isNotNull())
        .groupBy(*by, day)
        .agg(F.avg(value).alias("effect"), F.count(F.lit(1)).alias("events"))
    )


def hac(
    effects: DataFrame,
    by: list[str] = SERIES,
    lag: Column | None = None,
    max_lag: int = 20,
    day: str = "session",
    value: str = "effect",
    level: float = 0.95,
) -> DataFrame:
    """Bartlett-weighted mean test over a dated series.

    ``lag`` is per row (default: the horizon).  ``max_lag`` is how far the sum is
    written out; a longer lag fails the job, never shortens the sum.  A series
    has one row per date, so each window group is bounded by the calendar.
    """
    lag = F.col("horizon") if lag is None else lag
    too_long = F.concat(F.lit(f"lag over max_lag = {max_lag}: "), lag.cast("string"))
    lag = F.when(lag > max_lag, F.raise_error(too_long).cast("int")).otherwise(lag)
    order = Window.partitionBy(*by).orderBy(day)
    every = Window.partitionBy(*by)
    rows = effects.where(finite(F.col(value)).isNotNull()).withColumns(
        {"__c": F.col(value) - F.avg(value).over(every), "__lag": lag}
    )
    weighted = F.col("__c") * F.col("__c")
    for k in range(1, max_lag + 1):
        share = F.lit(2.0) * (1.0 - F.lit(float(k)) / (F.col("__lag") + 1))
        product = F.coalesce(F.col("__c") * F.lag("__c", k).over(order), F.lit(0.0))
        weighted = weighted + F.when(F.col("__lag") >= k, share * product).otherwise(0.0)
    rows = rows.withColumn("__w", weighted)
    groups = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_dates"), F.avg(value).alias("effect"), F.sum("__w").alias("__lrv"), F.max("__lag").alias("lag")
    )
    se = F.sqrt(F.greatest(F.lit(0.0), F.col("__lrv") / F.col("n_dates")) / F.col("n_dates"))
    z = z_critical(level)
    out = groups.withColumn("standard_error", F.when(se > F.abs("effect") * 1e-14, se).otherwise(0.0))
    p = F.when(F.col("standard_error") > 0, two_sided_p(F.col("effect") / F.col("standard_error"))).otherwise(
        F.when(F.col("effect") != 0, 0.0).otherwise(1.0)
    )
    return out.withColumns(
        {
            "ci_lower": F.col("effect") - z * F.col("standard_error"),
            "ci_upper": F.col("effect") + z * F.col("standard_error"),
            "evidence_status": F.when(F.col("n_dates") <= F.col("lag"), "insufficient_dates").otherwise("descriptive_hac"),
            "raw_p_value": p,
        }
    ).drop("__lrv")


def yearly(effects: DataFrame, by: list[str] = SERIES, day: str = "session", value: str = "effect") -> DataFrame:
    """Mean effect per calendar year."""
    return effects.groupBy(*by, F.year(day).alias("year")).agg(F.avg(value).alias("year_effect"))


def positive_year_share(effects: DataFrame, by: list[str] = SERIES, day: str = "session", value: str = "effect") -> DataFrame:
    return yearly(effects, by, day, value).groupBy(*by).agg(
        F.avg((F.col("year_effect") > 0).cast("double")).alias("positive_year_fraction"), F.count(F.lit(1)).alias("years")
    )


# ---- gates on statistics ----------------------------------------------------
def stressed(groups: DataFrame, study: Study, multiples: tuple[float, ...] | None = None, level: float = 0.95) -> DataFrame:
    """The same groups under multiplied costs.

    A constant extra cost moves the mean and leaves the spread, so nothing is
    aggregated again.
    """
    legs = F.array(*[F.lit(float(m)) for m in (multiples or study.stress)])
    base = groups.select("rule_id", "horizon", "regime", "sample_size", "mean_return", "sample_stddev")
    moved = base.withColumn("multiple", F.explode(legs)).withColumn(
        "mean_return", F.col("mean_return") - (F.col("multiple") - 1.0) * study.round_trip
    )
    return describe(moved, level)


def _passes(study: Study) -> Column:
    return F.coalesce(
        (F.col("sample_size") >= study.min_observations) & (F.col("mean_return") > 0) & (F.col("ci_lower") > 0) & F.col("multiple_testing_reject"),
        F.lit(False),
    )


def screen_verdict(groups: DataFrame, study: Study) -> tuple[DataFrame, DataFrame]:
    """(groups with ``passes`` and the worst stressed bound, one verdict per rule).

    The false-discovery family of every cost multiple spans all rules and is
    settled before the pass decision.
    """
    keys = ["rule_id", "horizon", "regime"]
    # multiple 1 is the base: one pass over the groups settles every family
    tested = false_discovery(stressed(groups, study, (1.0, *study.stress)), family=["multiple"], skip_null=True, alpha=study.alpha)
    rest = [c for c in tested.columns if c not in (*keys, "multiple")]
    base = F.col("multiple") == 1.0
    judged = tested.withColumn("__ok", _passes(study)).groupBy(*keys).agg(
        F.max(F.when(base, F.struct(*rest))).alias("b"),
        F.bool_and("__ok").alias("passes"),
        F.min(F.when(~base, F.col("ci_lower"))).alias("worst_stress_lower"),
    ).select(*keys, "b.*", "passes", "worst_stress_lower")
    ok = F.col("passes")
    best = F.max_by(F.struct("horizon", "regime", "mean_return", "sample_size"), F.when(ok, F.col("mean_return")))
    verdict = judged.groupBy("rule_id").agg(
        F.count_if(ok).alias("passing_groups"),
        F.count_distinct(F.when(ok, F.col("horizon"))).alias("passing_horizons"),
        F.coalesce(F.bool_or(ok & (F.col("regime") == "bullish")), F.lit(False)).alias("__bull"),
        F.coalesce(F.bool_or(ok & (F.col("regime") == "bearish")), F.lit(False)).alias("__bear"),
        best.alias("__best"),
    )
    regimes_ok = (F.col("__bull") & F.col("__bear")) if study.both_regimes else F.lit(True)
    some = F.col("passing_groups") > 0
    good = some & (F.col("passing_horizons") >= study.min_horizons) & regimes_ok
    why = F.when(good, None).when(~some, "no_passing_group").when(~regimes_ok, "insufficient_both_regimes").otherwise("insufficient_multiple_horizons")
    verdict = verdict.select(
        "rule_id", "passing_groups", "passing_horizons",
        F.when(good, "passed_screen").otherwise("rejected").alias("status"), why.alias("rejection_reason"),
        F.when(some, F.col("__best.horizon")).alias("best_horizon"),
        F.when(some, F.col("__best.regime")).alias("best_regime"),
        F.when(some, F.col("__best.mean_return")).alias("best_mean"),
    )
    return judged, verdict


def best_groups(groups: DataFrame) -> DataFrame:
    """The group with the highest mean of each rule (ties: longer horizon, regime name)."""
    order = F.struct(F.col("mean_return"), F.col("horizon"), F.col("regime"))
    return groups.groupBy("rule_id").agg(F.max(order).alias("b")).select(
        "rule_id", F.col("b.horizon").alias("horizon"), F.col("b.regime").alias("regime"), F.col("b.mean_return").alias("mean_return")
    )


def evidence_table(groups: DataFrame, min_samples: int = 300) -> DataFrame:
    """candidate / rejected with reasons / significantly_negative per group."""
    reject = F.coalesce(F.col("multiple_testing_reject"), F.lit(False))
    big = F.col("sample_size") >= min_samples
    negative = F.coalesce(big & (F.col("mean_return") < 0) & (F.col("ci_upper") < 0) & reject, F.lit(False))
    why = F.array_compact(
        F.array(
            F.when(~big, "insufficient_sample"),
            F.when(F.coalesce(F.col("mean_return") <= 0, F.lit(True)), "non_positive_mean"),
            F.when(F.coalesce(F.col("ci_lower") <= 0, F.lit(True)), "confidence_interval_not_above_zero"),
            F.when(~reject, "multiple_testing_not_significant"),
        )
    )
    return groups.withColumns(
        {
            "reasons": F.when(negative, F.array().cast("array<string>")).otherwise(why),
            "evidence": F.when(negative, "significantly_negative").when(F.size(why) == 0, "candidate").otherwise("rejected"),
        }
    )


def state_evidence(judged: DataFrame, study: Study) -> DataFrame:
    """Per rule and regime: passing horizons, best group and worst stressed lower bound."""
    rows = judged.where("passes")
    best = F.max(F.struct("mean_return", "horizon"))
    return (
        rows.groupBy("rule_id", "regime")
        .agg(
            F.count_distinct("horizon").alias("passing_horizons"),
            best.alias("__b"),
            F.sum("sample_size").alias("sample_size"),
            F.min("worst_stress_lower").alias("worst_stress_lower"),
        )
        .where(F.col("passing_horizons") >= study.min_horizons)
        .select(
            "rule_id", "regime", "passing_horizons", F.col("__b.horizon").alias("best_horizon"),
            F.col("__b.mean_return").alias("best_mean"), "sample_size", "worst_stress_lower",
        )
    )


def drift_check(
    baseline: DataFrame,
    current: DataFrame,
    as_of: dt.date,
    min_observations: int = 300,
    min_mean: float = 0.0,
    max_drop: float = 0.01,
    revalidation_days: int = 180,
    by: tuple[str, ...] = ("rule_id", "regime"),
) -> DataFrame:
    """expired / not_revalidated / insufficient_sample / drifted / revalidated.

    ``baseline``: by + mean_return, valid_until.  ``current``: by + sample_size,
    mean_return, ci_lower, multiple_testing_reject, validation_end.
    """
    now = current.select(
        *by, F.col("sample_size").alias("new_size"), F.col("mean_return").alias("new_mean"), F.col("ci_lower").alias("new_lower"),
        F.coalesce(F.col("multiple_testing_reject"), F.lit(False)).alias("new_reject"), "validation_end",
    )
    joined = baseline.join(now, list(by), "left")
    fell = (
        (F.col("new_mean") < min_mean)
        | (F.col("mean_return") - F.col("new_mean") > max_drop)
        | F.coalesce(F.col("new_lower") <= 0, F.lit(True))
        | ~F.col("new_reject")
    )
    verdict = (
        F.when(F.lit(as_of) >= F.col("valid_until"), "expired")
        .when(F.col("new_size").isNull(), "not_revalidated")
        .when(F.col("new_size") < min_observations, "insufficient_sample")
        .when(fell, "drifted")
        .otherwise("revalidated")
    )
    return joined.withColumn("verdict", verdict).withColumn(
        "valid_until", F.when(F.col("verdict") == "revalidated", F.date_add("validation_end", revalidation_days)).otherwise(F.col("valid_until"))
    )


def rank_rules(
    primary: DataFrame,
    stress: DataFrame,
    years: DataFrame,
    uniqueness: DataFrame,
    min_dates: int = 60,
    min_positive_horizons: int = 2,
    min_year_share: float = 0.6,
    others: DataFrame | None = None,
) -> DataFrame:
    """Order rules by how many horizons hold up; no portfolio terms.

    ``others``: HAC rows of the other regimes; where their interval lies below
    zero they are listed as ``negative_other_regimes`` (regime:horizon, sorted).

    ``primary``: HAC rows with multiple_testing_reject; ``stress``: HAC rows under
    the required multiple; ``years``: positive_year_fraction; ``uniqueness``:
    (rule_id, mean_unique_event_fraction).
    """
    keys = ["rule_id", "horizon", "regime"]
    rows = (
        primary.join(stress.select(*keys, F.col("ci_lower").alias("__s")), keys, "left")
        .join(years.select(*keys, "positive_year_fraction"), keys, "left")
    )
    positive = F.coalesce(
        (F.col("evidence_status") == "descriptive_hac") & (F.col("n_dates") >= min_dates) & (F.col("ci_lower") > 0) & F.col("multiple_testing_reject"),
        F.lit(False),
    )
    out = rows.groupBy("rule_id").agg(
        F.count_if(positive).alias("positive_horizons"),
        F.count_if(positive & (F.col("__s") > 0)).alias("stress_positive_horizons"),
        F.count_if(positive & (F.col("positive_year_fraction") >= min_year_share)).alias("year_stable_horizons"),
        F.min(F.when(positive, F.col("ci_lower"))).alias("minimum_positive_ci_lower"),
    ).join(uniqueness, "rule_id", "left")
    gate = (
        (F.col("positive_horizons") >= min_positive_horizons) & (F.col("stress_positive_horizons") >= 2) & (F.col("year_stable_horizons") >= 2)
    )
    out = out.withColumns(
        {
            "mean_unique_event_fraction": F.coalesce("mean_unique_event_fraction", F.lit(1.0)),
            "status": F.when(gate, "event_study_survivor").otherwise("research_eliminated_event"),
        }
    )
    if others is not None:
        worse = others.where(F.col("ci_upper") < 0).groupBy("rule_id").agg(
            F.sort_array(F.collect_set(F.concat_ws(":", "regime", F.lpad(F.col("horizon").cast("string"), 3, "0")))).alias("negative_other_regimes")
        )
        out = out.join(worse, "rule_id", "left").withColumn("negative_other_regimes", F.coalesce("negative_other_regimes", F.array().cast("array<string>")))
    order = Window.orderBy(
        F.desc("positive_horizons"), F.desc(F.coalesce("minimum_positive_ci_lower", F.lit(-1e99))), F.desc("mean_unique_event_fraction"), "rule_id"
    )  # one row per rule of the run
    return out.withColumn("position", F.row_number().over(order))


def drop_redundant(ranked: DataFrame, overlaps: DataFrame, rules: list[str], families: dict[str, str] | None = None, threshold: float = 0.6) -> DataFrame:
    """Of two survivors that overlap much, the one ranked lower is eliminated.

    Two rules overlap much when they are of one family, or when the larger of
    exact Jaccard and both near shares reaches ``threshold``. Pairs are looked at
    in the order of ``rules``, and a rule that has gone takes no other with it.
    The fold runs over the pairs of a short list of rules, in one row.
    """
    number = lambda c: F.array_position(F.array(*[F.lit(r) for r in rules]), c)
    kin = F.create_map(*[F.lit(x) for r in rules for x in (r, (families or {}).get(r, r))])
    much = (kin[F.col("left_rule")] == kin[F.col("right_rule")]) | (F.greatest("jaccard", "left_near", "right_near") >= threshold)
    place = ranked.select("rule_id", "position", (F.col("status") == "event_study_survivor").alias("alive"))
    pairs = (
        overlaps.where(much).select("left_rule", "right_rule")
        .join(place.select(F.col("rule_id").alias("left_rule"), F.col("position").alias("lp")), "left_rule")
        .join(place.select(F.col("rule_id").alias("right_rule"), F.col("position").alias("rp")), "right_rule")
    )
    weaker = F.when(F.col("lp") < F.col("rp"), F.col("right_rule")).otherwise(F.col("left_rule"))
    pair = F.struct(number(F.col("left_rule")).alias("i"), number(F.col("right_rule")).alias("j"), "left_rule", "right_rule", weaker.alias("weaker"))
    todo = pairs.agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    alive = place.where("alive").agg(F.collect_list("rule_id").alias("alive"))
    left = F.aggregate(
        "pairs", F.col("alive"), lambda acc, x: F.when(F.array_contains(acc, x["left_rule"]) & F.array_contains(acc, x["right_rule"]), F.array_remove(acc, x["weaker"])).otherwise(acc)
    )
    kept = todo.join(alive, F.lit(True)).select(F.explode(left).alias("rule_id"), F.lit(True).alias("__kept"))
    gone = (F.col("status") == "event_study_survivor") & F.col("__kept").isNull()
    out = ranked.join(kept, "rule_id", "left")
    return out.withColumn("status", F.when(gone, "research_eliminated_redundant_high_overlap").otherwise(F.col("status"))).drop("__kept")


def run_summary(outcomes: DataFrame, runs: DataFrame) -> DataFrame:
    """Statistics across runs of one rule, out of sample only.

    ``runs`` (run_id, rule_id, snapshot_id, qa_status) and outcomes carry run_id.
    More than one rule is an error, raised by the job itself.
    """
    facts = runs.agg(
        F.count_distinct("rule_id").alias("rules"),
        F.count(F.lit(1)).alias("runs"),
        F.count_distinct("snapshot_id").alias("snapshots"),
        F.count_if(F.col("qa_status") == "passed").alias("qa_passed"),
    )
    one = facts.select(F.assert_true(F.col("rules") == 1, "runs of different rules cannot be summarised").alias("__ok"), "*").select(
        F.struct(F.col("__ok"), F.col("runs"), F.col("snapshots"), F.col("qa_passed")).alias("f")
    )
    stats = summarize(outcomes.where(F.col("sample_split") == "out_of_sample"), ["horizon", "regime"])
    return (
        false_discovery(stats, skip_null=True)
        .withColumn("__f", one.scalar())
        .select("*", F.col("__f.runs").alias("runs"), F.col("__f.snapshots").alias("snapshots"), F.col("__f.qa_passed").alias("qa_passed"))
        .drop("__f")
    )

"""Many rules at once: one pass over the bars, then statistics on groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import events, stats
from tidemark.operators import outcomes as oc
from tidemark.operators.indicators import market_regime
from tidemark.operators.intervals import members_only
from tidemark.operators.rules import Rule
from tidemark.operators.signals import each_match, lookback, scan
from tidemark.runtime import stage


def long_enough(bars: DataFrame, rules: list[Rule], study: oc.Study) -> DataFrame:
    """Series must be longer than the longest look-back plus the longest horizon plus one."""
    return bars.where(F.col("n_bars") > max(lookback(r) for r in rules) + max(study.horizons) + 1)


def matched_bars(bars: DataFrame, rules: list[Rule], study: oc.Study, memberships: DataFrame | None = None, ahead: bool = True) -> DataFrame:
    """Bars with their ``matched`` array and, with ``ahead``, forward columns.

    Forward returns are computed once per bar, not once per rule; above their
    windows the filter on the array cannot be pushed down and is cheap.
    """
    df = scan(long_enough(bars, rules, study), rules)
    if ahead:
        df = oc.look_ahead(oc.gate_flags(df), study.horizons, excursions=False).where(F.size("matched") > 0)
    if study.min_signal_amount is not None:
        df = df.where(F.coalesce(F.col("amount") >= study.min_signal_amount, F.lit(False)))
    return members_only(df, memberships) if memberships is not None else df


def group_statistics(bars: DataFrame, rules: list[Rule], benchmark: DataFrame, study: oc.Study, memberships: DataFrame | None = None) -> DataFrame:
    """Out-of-sample groups per rule position, horizon and regime.

    Matched rules are exploded last, next to the aggregation that folds them
    again inside the map task: the shuffle carries rules x horizons x regimes
    rows per task.
    """
    picked = matched_bars(bars, rules, study, memberships)
    legs = oc.benchmark_return(oc.stack_horizons(picked, study.horizons, excursions=False), benchmark)
    rows = oc.returns(legs, study).where((F.col("sample_split") == "out_of_sample") & F.col("net_excess_return").isNotNull())
    regime = market_regime(benchmark, study.regime_window).select("session", "regime")
    rows = rows.join(F.broadcast(regime), "session", "left").withColumn("regime", F.coalesce("regime", F.lit("unknown")))
    rows = each_match(rows.select("horizon", "regime", "net_excess_return", "matched"))
    names = F.array(*[F.lit(r.name) for r in rules])
    stats_rows = stats.summarize(rows, ["rule", "horizon", "regime"])
    return stats_rows.withColumn("rule_id", F.element_at(names, F.col("rule") + 1)).drop("rule")


def signal_counts(bars: DataFrame, rules: list[Rule], study: oc.Study, memberships: DataFrame | None = None) -> DataFrame:
    """Signals per rule: one row for every rule, with 0 where it never matched."""
    hits = each_match(matched_bars(bars, rules, study, memberships, ahead=False).select("matched"))
    counts = hits.groupBy("rule").agg(F.count(F.lit(1)).alias("signals"))
    return _every(bars, rules).join(counts, "rule", "left").select("rule_id", F.coalesce("signals", F.lit(0)).alias("signals"))


def _every(bars: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, rule_id) of the run; a handful of rows."""
    return F.broadcast(bars.sparkSession.createDataFrame([(i, r.name) for i, r in enumerate(rules)], "rule int, rule_id string"))


def screen(bars: DataFrame, rules: list[Rule], benchmark: DataFrame, study: oc.Study, memberships: DataFrame | None = None) -> DataFrame:
    """One verdict per rule; a rule without out-of-sample groups is rejected."""
    judged = stats.screen_verdict(group_statistics(bars, rules, benchmark, study, memberships), study)[1]
    out = _every(bars, rules).join(judged, "rule_id", "left").drop("rule")
    return out.withColumns(
        {
            "passing_groups": F.coalesce("passing_groups", F.lit(0)),
            "passing_horizons": F.coalesce("passing_horizons", F.lit(0)),
            "rejection_reason": F.when(F.col("status").isNull(), "no_passing_group").otherwise(F.col("rejection_reason")),
            "status": F.coalesce("status", F.lit("rejected")),
        }
    )


def screen_without_duplicates(
    bars: DataFrame, rules: list[Rule], benchmark: DataFrame, study: oc.Study, memberships: DataFrame | None = None
) -> DataFrame:
    """``screen`` with near-duplicates of better rules rejected.

    Similarity is measured on the bars of every loadable symbol: co-occurrence
    counts add up over symbols, so none has to be left out.  The verdict table (one row per rule) and
    the pair table (one row per pair of passing rules) come to the driver; bars
    never do.
    """
    verdict = stage(screen(bars, rules, benchmark, study, memberships), "verdict")
    place = {r.name: i for i, r in enumerate(rules)}
    passed = [row["rule_id"] for row in verdict.where("status = 'passed_screen'").orderBy(F.desc("best_mean"), "rule_id").select("rule_id").collect()]
    if not passed:
        return verdict.withColumn("cluster", F.lit(None).cast("int"))
    chosen = [rules[place[name]] for name in passed]
    hits = matched_bars(long_enough(bars, rules, study), chosen, study, memberships, ahead=False)
    pairs = events.jaccard_pairs(events.cooccurrence(hits, len(chosen))).collect()
    similar = {(p["i"], p["j"]): p["jaccard"] for p in pairs}
    clusters = events.drop_near_duplicates(similar, list(range(len(chosen))), study.duplicate_jaccard)
    seen: set[int] = set()
    table = []
    for i, name in enumerate(passed):
        table.append((name, clusters[i], clusters[i] in seen))
        seen.add(clusters[i])
    marks = bars.sparkSession.createDataFrame(table, "rule_id string, cluster int, __copy boolean")
    out = verdict.join(F.broadcast(marks), "rule_id", "left")
    copy = F.coalesce(F.col("__copy"), F.lit(False))
    return out.withColumns(
        {
            "status": F.when(copy, "rejected").otherwise(F.col("status")),
            "rejection_reason": F.when(copy, "duplicate_of_kept_candidate").otherwise(F.col("rejection_reason")),
        }
    ).drop("__copy")

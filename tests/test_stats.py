import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.numeric import erf, two_sided_p
from tidemark.operators import stats
from tidemark.operators.outcomes import Study

D0 = dt.date(2020, 1, 1)


def test_erf_series(spark):
    xs = [float(x) for x in np.linspace(0, 6.5, 60)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erf(F.col("x")).alias("e")).collect()
    assert max(abs(r["e"] - math.erf(r["x"])) for r in got) < 5e-15  # near x = 6 the terms reach 1e15 before exp(-36) scales them
    assert spark.range(1).select(two_sided_p(F.lit(-1.96)).alias("p")).first()["p"] == pytest.approx(0.04999579)


def test_groups_and_exclusions(spark):
    rows = [(3, "bullish", 0.01), (3, "bullish", 0.03), (3, "bearish", -0.02), (3, "bearish", 0.0), (1, "unknown", 0.01), (1, "unknown", None), (0, "unknown", 0.03), (1, "unknown", float("nan"))]
    df = spark.createDataFrame(rows, "horizon int, regime string, net_excess_return double")
    got = {(r["horizon"], r["regime"]): r for r in stats.summarize(df, ["horizon", "regime"]).collect()}
    assert len(got) == 3
    bull = got[(3, "bullish")]
    assert bull["mean_return"] == pytest.approx(0.02) and bull["ci_lower"] < 0.02 < bull["ci_upper"]
    assert bull["standard_error"] == pytest.approx(0.01) and bull["t_statistic"] == pytest.approx(2.0)
    one = got[(1, "unknown")]
    assert one["evidence_status"] == "insufficient_sample" and one["t_statistic"] is None and one["ci_lower"] is None
    assert tuple(stats.exclusions(df).first()) == (8, 3)
    same = spark.createDataFrame([(1, "x", 0.1)] * 3, "horizon int, regime string, net_excess_return double")
    assert stats.summarize(same, ["horizon"]).first()["t_statistic"] is None
    with pytest.raises(ValueError):
        stats.summarize(df, ["horizon"], level=1.0)


def test_hac_by_hand(spark):
    df = spark.createDataFrame([("r", 1, "b", D0 + dt.timedelta(days=i), float(i + 1)) for i in range(4)], "rule_id string, horizon int, regime string, session date, effect double")
    got = stats.hac(df, max_lag=5).first()
    assert got["effect"] == 2.5 and got["standard_error"] == pytest.approx(0.625) and got["evidence_status"] == "descriptive_hac"
    flat = df.withColumn("effect", F.lit(0.5))
    assert stats.hac(flat).first()["raw_p_value"] == 0.0
    assert stats.hac(flat.withColumn("effect", F.lit(0.0))).first()["raw_p_value"] == 1.0
    assert stats.hac(df.withColumn("horizon", F.lit(4))).first()["evidence_status"] == "insufficient_dates"


@pytest.mark.parametrize("lag", [1, 5, 20])
def test_hac_against_brute_force(spark, lag):
    values = np.random.default_rng(lag).normal(0.01, 0.1, 60)
    df = spark.createDataFrame([("r", lag, "b", D0 + dt.timedelta(days=3 * i), float(v)) for i, v in enumerate(values)], "rule_id string, horizon int, regime string, session date, effect double")
    c = values - values.mean()
    lrv = (c * c).mean() + sum(2 * (1 - k / (lag + 1)) * (c[k:] * c[:-k]).sum() / len(c) for k in range(1, lag + 1))
    assert stats.hac(df).first()["standard_error"] == pytest.approx(math.sqrt(max(0, lrv) / len(c)))


def test_false_discovery(spark):
    ps = [0.001, 0.01, 0.02, 0.2, 0.3, 0.4, 0.5, 0.8, 0.9]
    df = spark.createDataFrame([(p,) for p in ps], "raw_p_value double")
    got = stats.false_discovery(df).orderBy("raw_p_value").collect()
    assert got[0]["adjusted_p_value"] == pytest.approx(0.009) and got[1]["adjusted_p_value"] == pytest.approx(0.045)
    assert [r["multiple_testing_reject"] for r in got[:3]] == [True, True, False]
    nulls = spark.createDataFrame([(None,)] * 3, "raw_p_value double")
    assert all(r["adjusted_p_value"] == 1.0 and not r["multiple_testing_reject"] for r in stats.false_discovery(nulls).collect())
    mixed = spark.createDataFrame([(0.04,), (None,)], "raw_p_value double")
    assert stats.false_discovery(mixed, skip_null=True).where("raw_p_value is not null").first()["adjusted_p_value"] == pytest.approx(0.04)


def _groups(spark, rows):
    schema = "rule_id string, horizon int, regime string, sample_size long, mean_return double, sample_stddev double"
    return stats.describe(spark.createDataFrame(rows, schema))


def test_verdict_needs_two_horizons_and_survives_stress(spark):
    rows = [
        ("good", 5, "bullish", 400, 0.02, 0.05), ("good", 10, "bearish", 400, 0.03, 0.05), ("single", 5, "bullish", 400, 0.02, 0.05),
        ("thin", 5, "bullish", 400, 0.0025, 0.01), ("thin", 10, "bullish", 400, 0.0025, 0.01), ("small", 5, "bullish", 20, 0.05, 0.01),
    ]
    judged, verdict = stats.screen_verdict(_groups(spark, rows), Study())
    got = {r["rule_id"]: r for r in verdict.collect()}
    assert got["good"]["status"] == "passed_screen" and got["good"]["best_horizon"] == 10
    assert got["single"]["rejection_reason"] == "insufficient_multiple_horizons"
    assert got["thin"]["rejection_reason"] == got["small"]["rejection_reason"] == "no_passing_group"
    both = stats.screen_verdict(_groups(spark, rows[:2] + [("one", 5, "bullish", 400, 0.02, 0.05), ("one", 10, "bullish", 400, 0.02, 0.05)]), Study(both_regimes=True))[1]
    assert {r["rule_id"]: r["rejection_reason"] for r in both.collect()} == {"good": None, "one": "insufficient_both_regimes"}
    state = stats.state_evidence(judged, Study(min_horizons=1)).collect()
    assert {(r["rule_id"], r["regime"]) for r in state} == {("good", "bullish"), ("good", "bearish"), ("single", "bullish")}


def test_evidence_reasons(spark):
    g = stats.false_discovery(_groups(spark, [("a", 1, "x", 400, -0.05, 0.05), ("b", 1, "x", 400, 0.05, 0.05), ("c", 1, "x", 10, 0.0, 0.05)]), skip_null=True)
    got = {r["rule_id"]: (r["evidence"], r["reasons"]) for r in stats.evidence_table(g).collect()}
    assert got["a"] == ("significantly_negative", []) and got["b"] == ("candidate", [])
    assert got["c"][1] == ["insufficient_sample", "non_positive_mean", "confidence_interval_not_above_zero", "multiple_testing_not_significant"]


def test_drift(spark):
    base = spark.createDataFrame([(n, "x", 0.02, dt.date(2022, 1, 1) if n != "old" else dt.date(2020, 1, 1)) for n in ("old", "none", "few", "fell", "ok")], "rule_id string, regime string, mean_return double, valid_until date")
    cur = [("few", "x", 10, 0.02, 0.01, True), ("fell", "x", 400, 0.005, 0.001, True), ("ok", "x", 400, 0.019, 0.01, True), ("old", "x", 400, 0.02, 0.01, True)]
    current = spark.createDataFrame(cur, "rule_id string, regime string, sample_size long, mean_return double, ci_lower double, multiple_testing_reject boolean").withColumn("validation_end", F.lit(dt.date(2021, 1, 1)))
    got = {r["rule_id"]: r["verdict"] for r in stats.drift_check(base, current, dt.date(2021, 6, 1)).collect()}
    assert got == {"old": "expired", "none": "not_revalidated", "few": "insufficient_sample", "fell": "drifted", "ok": "revalidated"}


def test_runs_of_two_rules_cannot_be_summarised(spark):
    rows = spark.createDataFrame([("1", 3, "x", 0.1, "out_of_sample"), ("1", 3, "x", 0.2, "out_of_sample")], "run_id string, horizon int, regime string, net_excess_return double, sample_split string")
    runs = lambda *ids: spark.createDataFrame([(str(i), r, "s", "passed") for i, r in enumerate(ids)], "run_id string, rule_id string, snapshot_id string, qa_status string")
    assert stats.run_summary(rows, runs("a", "a")).first()["runs"] == 2
    with pytest.raises(Exception, match="different rules"):
        stats.run_summary(rows, runs("a", "b")).collect()


def test_lag_beyond_the_sum_fails(spark):
    rows = [("r", 40, "all", dt.date(2020, 1, 1) + dt.timedelta(days=i), 0.01 * (i % 7)) for i in range(90)]
    df = spark.createDataFrame(rows, "rule_id string, horizon int, regime string, session date, effect double")
    with pytest.raises(Exception, match="lag over max_lag"):
        stats.hac(df).collect()
    assert stats.hac(df, max_lag=40).first()["standard_error"] > 0


def test_ranking_lists_negative_regimes_and_drops_the_weaker_of_two_alike(spark):
    hac = "rule_id string, horizon int, regime string, evidence_status string, n_dates long, ci_lower double, ci_upper double, multiple_testing_reject boolean"
    good = lambda rule, lower, n=2: [(rule, h, "bearish", "descriptive_hac", 80, lower, 0.1, True) for h in (1, 3, 5)[:n]]
    primary = spark.createDataFrame(good("a", 0.01, 3) + good("b", 0.03) + good("c", 0.02) + good("d", 0.01, 1), hac)
    others = spark.createDataFrame([("b", 1, "bullish", "descriptive_hac", 80, -0.3, -0.1, True), ("b", 10, "bullish", "descriptive_hac", 80, -0.3, -0.1, True), ("a", 1, "bullish", "descriptive_hac", 80, -0.3, 0.1, False)], hac)
    years = primary.select("rule_id", "horizon", "regime", F.lit(1.0).alias("positive_year_fraction"))
    unique = spark.createDataFrame([("a", 0.5)], "rule_id string, mean_unique_event_fraction double")
    ranked = stats.rank_rules(primary, primary, years, unique, others=others)
    assert [(r["rule_id"], r["status"][:8], r["negative_other_regimes"]) for r in ranked.orderBy("position").collect()] == [
        ("a", "event_st", []), ("b", "event_st", ["bullish:001", "bullish:010"]), ("c", "event_st", []), ("d", "research", [])
    ]
    pairs = [("a", "b", 0.1, 0.2, 0.7), ("a", "c", 0.1, 0.1, 0.1), ("a", "d", 1.0, 1.0, 1.0), ("b", "c", 0.9, 0.9, 0.9)]
    overlaps = spark.createDataFrame(pairs, "left_rule string, right_rule string, jaccard double, left_near double, right_near double")
    status = lambda df: {r["rule_id"]: r["status"].rsplit("_", 1)[-1] for r in df.collect()}
    # b falls to a; c is much like b only, which has gone already; d never survived
    assert status(stats.drop_redundant(ranked, overlaps, ["a", "b", "c", "d"])) == {"a": "survivor", "b": "overlap", "c": "survivor", "d": "event"}
    assert status(stats.drop_redundant(ranked, overlaps, ["b", "c", "a", "d"])) == {"a": "survivor", "b": "overlap", "c": "overlap", "d": "event"}
    assert status(stats.drop_redundant(ranked, overlaps, ["a", "b", "c", "d"], {"a": "x", "c": "x"})) == {"a": "survivor", "b": "overlap", "c": "overlap", "d": "event"}
    assert status(stats.drop_redundant(ranked, overlaps, ["a", "b", "c", "d"], threshold=1.1)) == {"a": "survivor", "b": "survivor", "c": "survivor", "d": "event"}

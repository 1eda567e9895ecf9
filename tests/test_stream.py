import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import outcomes as oc
from tidemark.operators import rules as ru
from tidemark.operators.series import equal_weight_benchmark
from tidemark.plans import event_study as es
from tidemark.streaming import incremental as inc

D = dt.date


def _columns():
    return [f.split()[0] for f in inc.BAR_SCHEMA.split(", ")]


def _members(spark, symbols):
    return spark.createDataFrame([(s, D(2020, 1, 1), None) for s in symbols], "symbol string, active_from date, active_to date")


def _follow(spark, bars, rule, study, root, cuts, bench, members):
    run = inc.FutureRun(rule, bench, members, str(root), study)
    for lo, hi in zip(cuts, cuts[1:]):
        part = bars.where((F.col("bar_ix") >= lo) & (F.col("bar_ix") < hi)).select(*_columns())
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        # a new query per arrival: state has to come back from storage
        run.start(inc.read_bar_stream(spark, f"{root}/in"), f"{root}/checkpoint").awaitTermination()
    run.finish(spark)
    return run


def _batch(bars, rule, study, bench, members):
    rows = es.run(bars, rule, bench, members, study)
    return {(r["symbol"], r["session"], r["horizon"]): round(r["net_excess_return"], 10) for r in rows.collect()}


def test_stream_equals_batch(spark, make_bars, walk, tmp_path):
    bars = make_bars({"600000": walk(160, 21), "300001": walk(150, 22), "688001": walk(160, 23)})
    study, rule = oc.Study(horizons=(1, 5)), ru.breakdown_rule()
    bench, members = equal_weight_benchmark(bars), _members(spark, ["600000", "300001"])
    run = _follow(spark, bars, rule, study, tmp_path, (0, 30, 31, 90, 160), bench, members)
    got = run.outcomes(spark).collect()
    keyed = {(r["symbol"], r["session"], r["horizon"]): round(r["excess_return"], 10) for r in got}
    assert len(got) == len(keyed) > 0 and keyed == _batch(bars, rule, study, bench, members)
    assert run.last_tail(spark).groupBy("symbol").count().agg(F.max("count")).first()[0] == run.tail_bars == 26


def test_recursive_rule_keeps_its_whole_series(spark, make_bars, walk, tmp_path):
    bars = make_bars({"600000": walk(120, 31)})
    rule = ru.Rule("r", "1", {"lt": [ru.metric("rsi", 14), 45.0]})
    study, bench, members = oc.Study(horizons=(1, 3)), equal_weight_benchmark(bars), _members(spark, ["600000"])
    run = _follow(spark, bars, rule, study, tmp_path, (0, 60, 120), bench, members)
    keyed = {(r["symbol"], r["session"], r["horizon"]): round(r["excess_return"], 10) for r in run.outcomes(spark).collect()}
    assert run.tail_bars is None and keyed == _batch(bars, rule, study, bench, members)


def test_late_and_repeated_bars_are_turned_away(spark, make_bars, walk, tmp_path):
    bars = make_bars({"600000": walk(40, 41)})
    run = inc.FutureRun(ru.breakdown_rule(), equal_weight_benchmark(bars), _members(spark, ["600000"]), str(tmp_path), oc.Study(horizons=(1,)), late_days=0)
    pick = lambda lo, hi: bars.where(f"bar_ix between {lo} and {hi}").select(*_columns())
    run.process(pick(0, 19).unionByName(pick(21, 29)), 0)
    twice = pick(28, 39).unionByName(pick(35, 35)).unionByName(pick(20, 20))
    run.process(twice, 1)
    run.process(twice, 1)  # replay after a failure: same tables
    got = {(r["session"].day, r["reason"]) for r in run.rejects(spark).collect()}
    days = lambda i: bars.where(f"bar_ix = {i}").first()["session"].day
    assert got == {(days(20), "out_of_order"), (days(28), "repeated_session"), (days(29), "repeated_session"), (days(35), "repeated_session")}
    assert run.last_tail(spark).agg(F.max("bar_ix")).first()[0] == 38


def test_order_and_batches_of_files_change_nothing(spark, make_bars, walk, tmp_path):
    bars = make_bars({"600000": walk(160, 21), "300001": walk(150, 22)})
    study, rule = oc.Study(horizons=(1, 5)), ru.breakdown_rule()
    bench, members = equal_weight_benchmark(bars), _members(spark, ["600000", "300001"])
    want = _batch(bars, rule, study, bench, members)
    for files in (1, 100):
        root = tmp_path / str(files)
        for k in (2, 0, 3, 1):  # every file holds bars of the whole time, and they come in no order
            bars.where((F.col("bar_ix") + F.length("symbol")) % 4 == k).select(*_columns()).coalesce(1).write.mode("append").parquet(f"{root}/in")
        run = inc.FutureRun(rule, bench, members, str(root), study, late_days=200)
        run.start(inc.read_bar_stream(spark, f"{root}/in", files_per_batch=files), f"{root}/checkpoint").awaitTermination()
        run.finish(spark)
        assert run.rejects(spark).count() == 0
        got = {(r["symbol"], r["session"], r["horizon"]): round(r["excess_return"], 10) for r in run.outcomes(spark).collect()}
        assert got == want and want


def test_outcomes_wait_for_their_benchmark(spark, make_bars, walk, tmp_path):
    bars = make_bars({"600000": walk(90, 21)})
    study, rule = oc.Study(horizons=(1, 5)), ru.breakdown_rule()
    bench, members = equal_weight_benchmark(bars), _members(spark, ["600000"])
    half = bars.where("bar_ix = 45").first()["session"]
    run = inc.FutureRun(rule, bench.where(F.col("session") <= F.lit(half)), members, str(tmp_path), study, late_days=0)
    run.process(bars.where("bar_ix < 80").select(*_columns()), 0)
    early = run.outcomes(spark).count()
    run.benchmark = bench
    run.process(bars.where("bar_ix >= 80").select(*_columns()), 1)
    got = {(r["symbol"], r["session"], r["horizon"]): round(r["excess_return"], 10) for r in run.outcomes(spark).collect()}
    assert early < len(got) and got == _batch(bars, rule, study, bench, members)


def test_tail_and_status(spark, make_bars, tmp_path):
    rows = [(10, 10, 10, 10)] * 25 + [(9, 9, 9, 9)] + [(10, 10, 10, 10)] * 2
    bars = make_bars({"600000": rows})
    run = inc.FutureRun(ru.breakdown_rule(), equal_weight_benchmark(bars), _members(spark, ["600000"]), str(tmp_path), oc.Study(horizons=(1, 2, 3, 5)))
    run.process(bars.select(*_columns()), 0)
    run.finish(spark)
    assert sorted(r["horizon"] for r in run.tail_purged(spark).collect()) == [3, 5]
    state = lambda as_of, end: inc.run_status(run.outcomes(spark), bars, D(2020, 1, 10), end, as_of, 5).first()
    assert state(D(2020, 1, 5), D(2020, 1, 20))["status"] == "waiting"
    assert state(D(2020, 1, 15), D(2020, 1, 20))["status"] == "accumulating_not_adjudicable"
    done = state(D(2020, 1, 20), D(2020, 1, 20))
    assert done["status"] == "eligible_for_adjudication" and done["window_dates"] == done["committed_dates"] == 11


def test_append_once(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert [tuple(r) for r in inc.append_once(rows.where("k = 'b'"), rows, ["k"]).collect()] == [("a", 1)]


def test_few_events_count_as_p_one(spark):
    rows = [("r", "A", D(2020, 1, 1) + dt.timedelta(days=i), h, 0.01 + 0.001 * (i % 3), 0.0016) for h, n in ((1, 120), (5, 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "rule_id string, symbol string, session date, horizon int, excess_return double, cost_round_trip double")
    got = {r["horizon"]: r for r in inc.adjudicate(df, (1, 5)).collect()}
    assert got[1]["multiple_testing_reject"] and got[1]["stress_effect"] < got[1]["effect"]
    assert got[5]["evidence_status"] == "insufficient_events" and got[5]["adjusted_p_value"] == 1.0 and got[5]["effect"] is None

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import outcomes as oc
from tidemark.operators import rules as ru
from tidemark.operators.series import equal_weight_benchmark
from tidemark.plans import event_study as es
from tidemark.streaming import incremental as inc
from tidemark.streaming import symbol_state as ss

D = dt.date
COLUMNS = [f.split()[0] for f in inc.BAR_SCHEMA.split(", ")]
FAR = dt.datetime(2099, 1, 1)
RSI = ru.Rule("r", "1", {"lt": [ru.metric("rsi", 14), 45.0]})
MANY = ru.Rule("m", "1", {"any": [
    {"all": [{"gt": [ru.metric("macd_dif", 26), ru.metric("macd_dea", 26)]}, {"lte": [ru.metric("macd_dif", 26, -1), ru.metric("macd_dea", 26, -1)]}]},
    {"all": [{"gt": [ru.metric("close"), ru.metric("boll_upper", 20)]}, {"gt": [ru.metric("volume_ratio", 5), 1.2]}]},
    {"all": [{"lt": [ru.metric("roc", 10), -0.03]}, ru.falling(), {"gt": [ru.metric("body", None, -1), ru.metric("upper_shadow")]}]},
    {"all": [{"lt": [ru.metric("simple_rsi", 6), 25.0]}, {"gt": [ru.metric("volatility", 10), 0.01]}, {"lt": [ru.metric("ema", 5), ru.metric("sma", 10)]}]},
]})


def _members(spark, symbols):
    return spark.createDataFrame([(s, D(2020, 1, 1), None) for s in symbols], "symbol string, active_from date, active_to date")


def _feed(spark, run, part, files=1):
    part.select(*COLUMNS).coalesce(1).write.mode("append").parquet(f"{run.root}/in")
    query = run.start(inc.read_bar_stream(spark, f"{run.root}/in", files))
    query.awaitTermination()
    return query


def _end(spark, run):
    ss.heartbeat(spark, f"{run.root}/in", FAR, inc.BAR_SCHEMA)
    run.start(inc.read_bar_stream(spark, f"{run.root}/in")).awaitTermination()


def _keyed(rows, value):
    return {(r["symbol"], r["session"], r["horizon"]): round(r[value], 10) for r in rows.collect()}


@pytest.mark.parametrize("rule", [RSI, MANY], ids=["rsi", "many"])
def test_state_store_equals_batch(spark, make_bars, walk, tmp_path, rule):
    """Files come one a batch and out of order; the state holds a fixed number of bars."""
    bars = make_bars({"600000": walk(220, 31), "300001": walk(200, 22), "688001": walk(220, 23)})
    study, members, bench = oc.Study(horizons=(1, 5)), _members(spark, ["600000", "300001"]), equal_weight_benchmark(bars)
    run = ss.SymbolRun(rule, members, str(tmp_path), study, delay="100 days")
    sizes = []
    for lo, hi in ((60, 90), (0, 60), (120, 220), (90, 120)):
        last = _feed(spark, run, bars.where((F.col("bar_ix") >= lo) & (F.col("bar_ix") < hi)))
        sizes.append(ss.state_rows(last.lastProgress))
    _end(spark, run)
    want = _keyed(es.run(bars, rule, bench, members, study), "net_excess_return")
    got = run.outcomes(spark, bench)
    assert got.count() == len(want) > 10 and _keyed(got, "excess_return") == want
    assert run.rejects(spark).count() == 0 and got.where("status <> 'completed'").count() == 0
    # a benchmark that ends early leaves its outcomes waiting
    early = run.outcomes(spark, bench.where(F.col("session") < F.lit(D(2020, 4, 1))))
    assert 0 < early.where("status = 'waiting'").count() < len(want)


def test_state_does_not_grow_with_batches(spark, make_bars, walk, tmp_path):
    bars = make_bars({"600000": walk(300, 5)})
    run = ss.SymbolRun(RSI, _members(spark, ["600000"]), str(tmp_path), oc.Study(horizons=(1, 3)), delay="5 days")
    sizes = [ss.state_rows(_feed(spark, run, bars.where(f"bar_ix between {lo} and {lo + 49}")).lastProgress) for lo in range(0, 300, 50)]
    assert sizes[-1] <= sizes[1] and sizes[-1] < 60


def test_late_repeated_and_keyless_bars(spark, make_bars, walk, tmp_path):
    bars = make_bars({"600000": walk(80, 41)})
    run = ss.SymbolRun(ru.breakdown_rule(), _members(spark, ["600000"]), str(tmp_path), oc.Study(horizons=(1,)), delay="2 days")
    pick = lambda lo, hi: bars.where(f"bar_ix between {lo} and {hi}")
    _feed(spark, run, pick(0, 19).unionByName(pick(21, 59).where("bar_ix <> 50")))
    blank = pick(3, 3).withColumn("symbol", F.lit(None).cast("string"))
    _feed(spark, run, pick(58, 79).unionByName(pick(70, 70)).unionByName(pick(50, 50)).unionByName(pick(20, 20)).unionByName(blank))
    _end(spark, run)
    day = lambda i: D(2020, 1, 1) + dt.timedelta(days=i)
    got = {(r["session"], r["reason"], r["rows"]) for r in run.rejects(spark).collect()}
    assert got == {
        (day(3), "missing_key", 1), (day(20), "before_kept_bars", 1), (day(50), "out_of_order", 1),
        (day(58), "repeated_session", 1), (day(59), "repeated_session", 1), (day(70), "repeated_session", 1),
    }


def test_no_bars_and_missing_values(spark, make_bars, tmp_path):
    bars = make_bars({"600000": [(10, 10, 10, 10, None)] * 30})
    run = ss.SymbolRun(RSI, _members(spark, []), str(tmp_path), oc.Study(horizons=(1,)))
    _feed(spark, run, bars.where("false"))
    _feed(spark, run, bars.withColumn("close", F.when(F.col("bar_ix") % 3 > 0, F.col("close"))).withColumn("available_at", F.lit(None).cast("timestamp")))
    _end(spark, run)
    assert run.outcomes(spark, equal_weight_benchmark(bars)).count() == 0

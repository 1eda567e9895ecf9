import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.metrics import limit_pct
from tidemark.operators import outcomes as oc
from tidemark.operators import rules as ru
from tidemark.operators.series import equal_weight_benchmark, grid
from tidemark.plans import event_study as es


def test_limits_by_board_and_date(spark):
    cases = [
        ("600000", dt.date(2021, 1, 4), False, 0.10), ("688001", dt.date(2021, 1, 4), False, 0.20), ("300001", dt.date(2020, 8, 21), False, 0.10),
        ("300001", dt.date(2020, 8, 24), False, 0.20), ("301001", dt.date(2021, 1, 4), False, 0.20), ("300001", dt.date(2021, 1, 4), True, 0.05), ("300001", None, False, 0.20),
    ]
    df = spark.createDataFrame(cases, "symbol string, session date, is_st boolean, want double")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", limit_pct(F.col("symbol"), F.col("session"), F.col("is_st"))).collect())


def test_horizon_one_leaves_at_the_entry_day_close(make_bars):
    bars = make_bars({"600000": [(10, 11, 9, 10), (10.2, 10.8, 10.0, 10.5), (10.5, 10.9, 10.1, 10.4)]})
    study = oc.Study(horizons=(1, 2))
    rows = oc.outcomes(bars.withColumn("is_signal", F.col("bar_ix") == 0), equal_weight_benchmark(bars), study).orderBy("horizon").collect()
    assert rows[0]["raw_return"] == pytest.approx(10.5 / 10.2 - 1) and rows[0]["exit_at"] == rows[0]["entry_at"]
    assert rows[1]["raw_return"] == pytest.approx(10.4 / 10.2 - 1)
    assert rows[1]["mfe"] == pytest.approx(10.9 / 10.2 - 1) and rows[1]["mae"] == pytest.approx(10.0 / 10.2 - 1)
    assert rows[0]["net_excess_return"] == pytest.approx(-0.0016)


def test_entry_gate_sees_the_open_only(make_bars):
    base = [(10, 10, 10, 10), (10.5, 11, 10, 10.5), (10, 11, 9, 10)]
    flags = lambda rows: oc.gate_flags(make_bars({"600000": rows})).where("bar_ix = 1").first()
    assert flags(base)["buy_flags"] == 0
    changed = [base[0], (10.5, 99, 1, 3, 0.0), base[2]]
    assert flags(changed)["buy_flags"] == 0 and flags(changed)["sell_flags"] != 0
    assert flags([base[0], (10.995, 11, 10, 10.5), base[2]])["buy_flags"] == 2


def test_zero_volume_blocks_the_sale_not_the_purchase(make_bars):
    bars = make_bars({"600000": [(10, 10, 10, 10), (10, 10, 10, 10, 0.0), (10, 10, 10, 10)]})
    row = oc.gate_flags(bars).where("bar_ix = 1").first()
    assert row["buy_flags"] == 0 and row["sell_flags"] == 2 + 4
    blank = make_bars({"600000": [(10, 10, 10, 10), (10, 10, 10, 10, None), (10, 10, 10, 10)]})
    assert oc.gate_flags(blank).where("bar_ix = 1").first()["sell_flags"] == 0
    assert oc.gate_flags(blank, blank_volume_blocks=True).where("bar_ix = 1").first()["sell_flags"] == 2


def test_benchmark_is_never_filled(make_bars, spark):
    bars = make_bars({"600000": [(10, 10, 10, 10)] * 4})
    bench = equal_weight_benchmark(bars).where("session <> date'2020-01-03'")
    rows = oc.outcomes(bars.withColumn("is_signal", F.col("bar_ix") == 0), bench, oc.Study(horizons=(1, 2, 3))).orderBy("horizon").collect()
    assert [r["benchmark_return"] for r in rows] == [0.0, None, 0.0]
    assert rows[1]["net_excess_return"] is None and rows[1]["net_return"] is not None


def test_lockbox_end_cuts_before_the_lead(make_bars, walk):
    bars = make_bars({"600000": walk(200, 11), "600001": walk(200, 12)})
    bench = equal_weight_benchmark(bars)
    end = dt.date(2020, 6, 1)
    rows = es.run_within(bars, ru.breakdown_rule(), dt.date(2020, 1, 1), dt.date(2020, 4, 1), end, dt.date(2020, 7, 1), benchmark=bench)
    assert rows.agg(F.max("exit_at")).first()[0] <= end and rows.count() > 0
    with pytest.raises(ValueError):
        es.run_within(bars, ru.breakdown_rule(), dt.date(2020, 1, 1), dt.date(2020, 4, 1), end, end, benchmark=bench)


def test_membership_is_asked_on_the_signal_date(make_bars, spark):
    bars = make_bars({"600000": [(10, 10, 10, 10)] * 6}).withColumn("is_signal", F.lit(True))
    members = spark.createDataFrame([("600000", dt.date(2020, 1, 2), dt.date(2020, 1, 3))], "symbol string, active_from date, active_to date")
    rows = oc.outcomes(bars, None, oc.Study(horizons=(1,)), memberships=members).collect()
    assert sorted(r["session"] for r in rows) == [dt.date(2020, 1, 2), dt.date(2020, 1, 3)]


def test_sale_moves_to_the_next_eligible_session(make_bars):
    bars = make_bars({"600000": [(10, 11, 9, 10), (10, 10, 10, 10), (10, 11, 9, 10, 0.0), (10, 11, 9, 10), (10, 10, 10, 10)], "600001": [(1, 2, 0.5, 1)] * 5})
    got = oc.approximate_trades(grid(bars)).where("symbol = '600000'").orderBy("session").collect()
    assert [r["buy_resolution"] for r in got][:3] == ["approximate_observed_row", "suspected_one_price_board", "nonpositive_volume"]
    assert [r["sell_delay"] for r in got] == [0, 2, 1, 0, 0]
    assert got[4]["sell_resolution"] == "unresolved_no_eligible_observation"


def test_plans_past_the_series_are_purged(make_bars):
    bars = oc.gate_flags(make_bars({"600000": [(10, 10, 10, 10)] * 10})).withColumn("tradeable_open", F.lit(True))
    events = bars.where("bar_ix in (1, 6)").select(F.lit("r").alias("rule_id"), "symbol", "session")
    got = {r["signal_at"].day: r for r in oc.trade_plans(events, bars, (3,), 2, 7).collect()}
    assert not got[2]["tail_purged"] and got[2]["scheduled_exit"] == dt.date(2020, 1, 5) and got[2]["deadline"] == dt.date(2020, 1, 7)
    assert got[7]["tail_purged"] and got[7]["scheduled_exit"] is None


def test_one_bar_backtest(make_bars):
    bars = make_bars({"600000": [(10, 10, 10, 10), (10, 12, 10, 11), (0, 1, 0, 1), (5, 5, 5, 5)]}).withColumn("is_signal", F.lit(True))
    got = oc.one_bar_backtest(bars, 0.01).first()
    assert got["trades"] == 2 and got["gross_sum"] == pytest.approx(0.1) and got["net_sum"] == pytest.approx(0.08)

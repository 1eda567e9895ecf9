import pytest
from pyspark.sql import functions as F

from tidemark.operators import rules as ru
from tidemark.operators import signals as sg
from tidemark.operators.series import number_bars


def test_hand_made_hammer(make_bars):
    down = [(110 - i, 111 - i, 108 - i, 109 - i) for i in range(9)]
    bars = make_bars({"600000": down + [(101, 101.3, 95, 101.2), (101, 102, 100, 101)]})
    hits = sg.signals(bars, [ru.catalogue_rule("hammer")]).collect()
    assert [(h["rule_id"], h["bar_ix"]) for h in hits] == [("hammer", 9)]


def test_rule_counts_and_warm_up():
    screen, grammar = ru.screen_rules(), ru.grammar_rules()
    assert len(screen) == 178 and len({r.id for r in screen}) == 23
    assert len({str((r.condition, r.params)) for r in screen}) == 178
    assert len(grammar) == 100  # 12+10+18+12+4+6+24+2+3+9 by family
    assert sg.lookback(ru.catalogue_rule("donchian_main")) == 210
    assert sg.lookback(ru.Rule("m", "1", ru.every(*ru.macd_cross(True)))) == 36
    assert sg.lookback(ru.breakdown_rule()) == 20


def test_one_scan_equals_rule_by_rule(make_bars, walk):
    bars = make_bars({"600000": walk(260, 3), "300001": walk(260, 4)})
    rules = ru.screen_rules()[::9]
    together = {(r["rule_version"], r["symbol"], r["bar_ix"]) for r in sg.signals(bars, rules).collect()}
    alone = set()
    for rule in rules:
        for row in sg.signal(bars, rule.condition, rule.params).select("symbol", "bar_ix").collect():
            alone.add((rule.version, row["symbol"], row["bar_ix"]))
    assert together == alone and together


def test_later_bars_do_not_change_earlier_signals(make_bars, walk, spark):
    bars = make_bars({"600000": walk(240, 5), "688001": walk(240, 6)})
    rules = ru.catalogue() + [ru.breakdown_rule()] + ru.grammar_rules()[::7]
    cut = 180
    plain = bars.drop("bar_ix", "n_bars", "prev_close")
    shorter = number_bars(plain.where(F.datediff("session", F.lit("2020-01-01")) <= cut))
    late = F.datediff("session", F.lit("2020-01-01")) > cut
    changed = plain.withColumns({p: F.when(late, F.col(p) * 3).otherwise(F.col(p)) for p in ("open", "high", "low", "close")})
    pick = lambda df: {tuple(r) for r in sg.signals(df, rules).where(f"bar_ix <= {cut}").select("rule_id", "rule_version", "symbol", "bar_ix").collect()}
    base = pick(bars)
    assert base and pick(shorter) == base and pick(number_bars(changed)) == base


def test_partitioning_does_not_matter(make_bars, walk):
    bars = make_bars({f"60000{i}": walk(120, i) for i in range(4)})
    rules = ru.grammar_rules()[::5]
    pick = lambda df: sorted(tuple(r) for r in sg.signals(df, rules).select("rule_version", "symbol", "bar_ix").collect())
    assert pick(bars) == pick(bars.repartition(13, "session"))


def test_status_order(make_bars):
    bars = make_bars({"600000": [(10, 10, 10, 10)] * 4 + [(10, 12, 10, 11)]})
    rule = ru.Rule("d", "1", {"gt": [{"div": [ru.metric("body"), ru.metric("range")]}, 0.1]}, warmup=2)
    got = [r["s"] for r in sg.prepare(bars, [rule]).select("bar_ix", sg.status(rule).alias("s")).orderBy("bar_ix").collect()]
    assert got == ["insufficient_data"] * 4 + ["matched"]
    late = bars.withColumn("available_at", F.when(F.col("bar_ix") == 3, F.col("available_at") + F.expr("INTERVAL 3 DAYS")).otherwise(F.col("available_at")))
    seen = sg.prepare(late, [rule]).withColumn("ok", sg.visible(1, F.col("session") + F.expr("INTERVAL 15 HOURS")))
    got = [r["s"] for r in seen.select("bar_ix", sg.status(rule, F.col("ok")).alias("s")).orderBy("bar_ix").collect()]
    assert got[3:] == ["data_error", "data_error"]


def test_looking_ahead_is_refused(make_bars):
    bars = make_bars({"600000": [(1, 1, 1, 1)]})
    with pytest.raises(ValueError):
        sg.signal(bars, {"gt": [ru.metric("close", offset=1), 0]})
    with pytest.raises(ValueError):
        sg.signal(bars, {"gt": [{"metric": {"name": "sma", "offset": 0}}, 0]})


def test_missing_context_history_is_false(make_bars, walk):
    bars = make_bars({"600000": walk(200, 7)})
    bench = bars.select("session", "open", "close").where("session <> date'2020-06-20'")
    flags = sg.context_flags(bars, bench)
    assert flags.where("session between date'2020-06-20' and date'2020-06-29'").agg(F.max(F.greatest(*[F.col(p).cast("int") for p in ru.CONTEXT_PROFILES]))).first()[0] == 0


def test_no_bar_enters_and_leaves(make_bars, walk):
    flagged = sg.entry_exit(make_bars({"600000": walk(400, 8)}))
    assert set(sg.both_sides(flagged).first().asDict().values()) == {0}


def test_planned_events_wait_and_merge(make_bars):
    bars = make_bars({"600000": [(1, 1, 1, 1)] * 7})
    planned, eligible = {1, 2, 5}, {0, 3, 4, 6}
    df = bars.withColumns({"planned": F.col("bar_ix").isin(*planned), "eligible": F.col("bar_ix").isin(*eligible)})
    fired = [r["bar_ix"] for r in sg.delay_to_eligible(df).where("fires").orderBy("bar_ix").collect()]
    assert fired == [3, 6]

import datetime as dt
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import events as ev
from tidemark.operators import rules as ru
from tidemark.operators import signals as sg


def _events(spark, rows):
    return spark.createDataFrame(rows, "rule_id string, symbol string, bar_ix long")


def test_cooldown_is_greedy_and_ignores_copies(spark):
    ix = [1, 5, 20, 21, 22, 41, 60, 61, 80, 41, 41]
    got = ev.cooldown(_events(spark, [("r", "A", i) for i in ix])).orderBy("bar_ix").collect()
    assert [r["bar_ix"] for r in got] == [1, 21, 41, 61]


def test_cooldown_of_parts_equals_the_whole(spark):
    rng = np.random.default_rng(3)
    rows = [("r", s, int(i)) for s in "ABC" for i in rng.integers(0, 400, 120)]
    whole = {tuple(r) for r in ev.cooldown(_events(spark, rows), 7).collect()}
    parts = {tuple(r) for s in "ABC" for r in ev.cooldown(_events(spark, [x for x in rows if x[1] == s]), 7).collect()}
    assert whole == parts


def test_overlap_by_hand(spark):
    rows = [("a", "A", 1), ("a", "A", 10), ("b", "A", 1), ("b", "A", 14)]
    r = ev.overlap(_events(spark, rows), ["a", "b", "none"], 5).collect()
    ab = r[0]
    assert ab["jaccard"] == pytest.approx(1 / 3) and ab["left_unique"] == 0.5 and ab["left_near"] == 1.0
    none = [x for x in r if x["right_rule"] == "none"][0]
    assert none["right_events"] == 0 and none["jaccard"] == 0.0 and none["right_near"] == 0.0
    assert ev.overlap(_events(spark, rows).where("false"), ["a", "b"], 5).first()["jaccard"] == 1.0


def test_near_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    left = [("l", s, int(i)) for s in "AB" for i in set(rng.integers(0, 300, 40))]
    right = [("r", s, int(i)) for s in "AB" for i in set(rng.integers(0, 300, 25))] * 3
    want = {(s, i) for _, s, i in left if any(s == t and abs(i - j) <= 5 for _, t, j in right)}
    got = [(r["symbol"], r["bar_ix"]) for r in ev.near(_events(spark, left), _events(spark, right), 5).collect()]
    assert set(got) == want and len(got) == len(want)


def test_cooccurrence_equals_pairs(make_bars, walk):
    rules = ru.grammar_rules()[::6]
    scanned = sg.scan(make_bars({"600000": walk(200, 1), "600001": walk(200, 2)}), rules)
    want = {}
    for row in scanned.select("matched").collect():
        for i in row["matched"]:
            want[(i, i)] = want.get((i, i), 0) + 1
        for i, j in combinations(sorted(row["matched"]), 2):
            want[(i, j)] = want.get((i, j), 0) + 1
    got = {(r["i"], r["j"]): r["n"] for r in ev.cooccurrence(scanned.repartition(5), len(rules)).collect()}
    assert got == want


def test_near_duplicates_join_the_better_rule():
    similar = {(0, 1): 0.9, (1, 2): 0.95, (0, 2): 0.2, (2, 3): 0.85}
    assert ev.drop_near_duplicates(similar, [0, 1, 2, 3]) == {0: 0, 1: 0, 2: 1, 3: 1}


def test_same_day_selection_reports_the_rest(spark):
    day = dt.date(2020, 1, 1)
    plans = spark.createDataFrame(
        [("r", 5, day, s, rank, ok) for s, rank, ok in (("A", "3", True), ("B", "1", True), ("C", "0", False), ("D", "2", True))],
        "rule_id string, horizon int, entry_at date, symbol string, selection_rank string, entry_tradeable boolean",
    )
    got = {r["symbol"]: r["decision"] for r in ev.same_day_selection(plans, 2).collect()}
    assert got == {"A": "max_positions", "B": "selected", "C": "entry_untradeable", "D": "selected"}


def test_weekly_scores_come_from_the_session_before(spark):
    days = [dt.date(2020, 1, 2), dt.date(2020, 1, 3), dt.date(2020, 1, 6), dt.date(2020, 1, 7), dt.date(2020, 1, 13)]
    rows = [(s, d, float(i * 10 + j)) for i, d in enumerate(days) for j, s in enumerate(("A", "B", "C"))]
    got = ev.weekly_top(spark.createDataFrame(rows, "symbol string, session date, score double"), 2).orderBy("trade_session", "position").collect()
    assert [(r["trade_session"].day, r["score_session"].day, r["symbol"]) for r in got] == [(6, 3, "C"), (6, 3, "B"), (13, 7, "C"), (13, 7, "B")]
    assert got[0]["iso_week"] == "2020-02"


def test_audit_sample_per_group(spark):
    df = spark.createDataFrame([(g, i) for g in "ab" for i in range(50)], "g string, v long")
    got = ev.audit_sample(df, F.sha2(F.col("v").cast("string"), 256), 3, by=["g"])
    assert got.count() == 6 and {r["v"] for r in got.where("g = 'a'").collect()} == {r["v"] for r in got.where("g = 'b'").collect()}


def test_symbol_selection_gives_reasons(spark):
    d = lambda m: dt.date(2020, m, 1)
    rows = [("A", d(1)), ("A", d(9)), ("B", d(3)), ("B", d(9)), ("C", d(1)), ("C", d(5)), ("D", d(1)), ("D", d(9))]
    bars = spark.createDataFrame(rows, "symbol string, session date")
    taken = spark.createDataFrame([("D",)], "symbol string")
    chosen, judged = ev.next_symbols(bars, F.lit(d(2)), F.lit(d(8)), taken, 3)
    assert [r["symbol"] for r in chosen.collect()] == ["A"]
    assert {r["symbol"]: r["reason"] for r in judged.collect()} == {"A": None, "B": "starts_late", "C": "ends_early", "D": "already_selected"}

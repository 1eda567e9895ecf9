import collections
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import coverage as cv
from tidemark.operators import cross_section as cs
from tidemark.operators import intervals as iv
from tidemark.operators import pit, quality
from tidemark.schema import conform
from tidemark.sources import bars as sb
from tidemark.sources import reference as ref
from tidemark.sources.snapshot import content_snapshot, read_files, snapshot_id, verify_snapshot

D = dt.date
BAR = "symbol string, date date, open double, high double, low double, close double, volume double"


def test_bar_files_by_symbol(spark, tmp_path):
    for symbol in ("600000", "300001", "notes"):
        pd.DataFrame({"date": [D(2020, 1, 2), D(2020, 1, 3)], "open": 1.0, "high": 2.0, "low": 0.5, "close": [1.0, 1.5]}).to_parquet(tmp_path / f"{symbol}.parquet")
    df = sb.read_bars(spark, str(tmp_path), start=D(2020, 1, 3), day="date")
    assert sorted((r["symbol"], r["close"]) for r in df.collect()) == [("300001", 1.5), ("600000", 1.5)]
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date,2020-01-03)]" in df._jdf.queryExecution().executedPlan().toString()


def test_previous_close_skips_dropped_rows(spark):
    rows = [("600000", D(2020, 1, i), 10.0, h, 9.0, c, 1.0) for i, h, c in ((1, 11.0, 10.0), (2, 9.5, 10.5), (3, 11.0, 10.2))]
    got = sb.normalize_bars(spark.createDataFrame(rows, BAR)).orderBy("session").collect()
    assert [r["session"].day for r in got] == [1, 3] and got[1]["prev_close"] == 10.0
    ranged = sb.normalize_bars(spark.createDataFrame(rows, BAR), start=D(2020, 1, 3)).collect()
    assert ranged[0]["prev_close"] is None


def test_repeated_session_fails(spark):
    rows = [("600000", D(2020, 1, 1), 10.0, 11.0, 9.0, 10.0, 1.0)] * 2
    with pytest.raises(Exception, match="repeated session 600000"):
        sb.normalize_bars(spark.createDataFrame(rows, BAR)).collect()
    with pytest.raises(ValueError):
        sb.normalize_bars(spark.createDataFrame(rows, BAR).drop("low"))


def test_bad_membership_line_fails(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"symbol":"1","active_from":"20200101","active_to":null,"source":"x"}\n')
    row = ref.read_memberships(spark, str(tmp_path)).first()
    assert row["symbol"] == "000001" and row["active_from"] == D(2020, 1, 1) and row["active_to"] is None
    (tmp_path / "n.jsonl").write_text('{"symbol":"2","active_from":"soon","source":"x"}\n')
    with pytest.raises(Exception, match="invalid membership line"):
        ref.read_memberships(spark, str(tmp_path)).collect()


def test_snapshot_and_verification(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.parquet").write_bytes(n.encode() * 1000)
    snap = content_snapshot(read_files(spark, {"r": str(tmp_path)}))
    import hashlib

    assert {r["sha256"] for r in snap.collect()} == {"sha256:" + hashlib.sha256(n.encode() * 1000).hexdigest() for n in "abc"}
    manifest = spark.createDataFrame(snap.collect(), snap.schema)
    before = snapshot_id(snap).first()[0]
    (tmp_path / "a.parquet").write_bytes(b"x" * 1000)
    (tmp_path / "b.parquet").write_bytes(b"b")
    (tmp_path / "c.parquet").unlink()
    (tmp_path / "d.parquet").write_bytes(b"d")
    fresh = content_snapshot(read_files(spark, {"r": str(tmp_path)}))
    got = {r["path"][-9]: r["reason"] for r in verify_snapshot(manifest, fresh).collect()}
    assert got == {"a": "content_mismatch", "b": "size_mismatch", "c": "missing", "d": "not_in_manifest"}
    assert snapshot_id(fresh).first()[0] != before


def test_issue_order_across_stretches(spark):
    n = 70_000  # more than one stretch of row numbers
    day = lambda i: D(1900, 1, 1) + dt.timedelta(days=i)
    rows = [("A", i, day(i // 1), 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(n)]
    rows[65_536] = ("A", 65_536, day(65_535), 1.0, 1.0, 1.0, 1.0, 1.0)
    rows[69_000] = ("A", 69_000, None, 1.0, 1.0, 1.0, 1.0, 1.0)
    rows[69_001] = ("A", 69_001, day(5), 1.0, 1.0, 1.0, 1.0, 1.0)
    rows[10] = ("A", 10, day(10), 1.0, 1.0, 1.0, -1.0, float("nan"))
    df = spark.createDataFrame(rows, "symbol string, row_number long, session date, open double, high double, low double, close double, volume double")
    got = {r["row_number"]: r["issue_code"] for r in quality.quarantine(quality.row_issues(df)).collect()}
    assert got == {10: "non_finite", 65_536: "duplicate_session", 69_000: "null", 69_001: "non_monotonic_session"}


def test_domain_checks(spark):
    f = spark.createDataFrame([(True, False, False, True, False), (False, True, True, True, True), (False, False, False, True, True)], "is_suspended boolean, is_limit_up boolean, is_limit_down boolean, can_buy boolean, can_sell boolean")
    got = [r["i"] for r in f.select(quality.tradability_issues().alias("i")).collect()]
    assert got == [["suspended_but_tradable"], ["limit_up_but_buyable", "limit_down_but_sellable", "both_limits"], []]
    row = conform(spark.createDataFrame([("1", "2", 3)], "a string, b string, extra int"), "index_constituents", {"index_symbol": "a", "constituent_symbol": "b", "effective_from": "b", "effective_to": "b"})
    assert row.columns == ["index_symbol", "constituent_symbol", "effective_from", "effective_to"]
    with pytest.raises(ValueError):
        conform(f, "market", {"symbol": "x"})


def test_walk_forward_keeps_the_purge(spark):
    days = spark.createDataFrame([(D(2020, 1, 1) + dt.timedelta(days=i),) for i in range(20)], "day date")
    folds = quality.walk_forward(days, 8, 3, 2).orderBy("fold_id").collect()
    assert [(f["train_from"], f["train_to"], f["test_from"], f["test_to"]) for f in folds] == [(0, 7, 10, 12), (0, 10, 13, 15), (0, 13, 16, 18), (0, 16, 19, 19)]
    rolling = quality.walk_forward(days, 8, 3, 2, expanding=False).orderBy("fold_id").collect()
    assert [(f["train_from"], f["train_to"]) for f in rolling] == [(0, 7), (3, 10), (6, 13), (9, 16)]
    assert quality.walk_forward(days.limit(1), 8, 3, 2).count() == 0


def test_lockbox(spark):
    at = lambda day: spark.createDataFrame([(day,)], "session date")
    assert quality.lockbox_status(at(D(2025, 1, 1)), D(2026, 1, 1)).first()["status"] == "sealed"
    assert quality.lockbox_status(at(D(2026, 1, 1)), D(2026, 1, 1)).first()["status"] == "contaminated"
    assert quality.lockbox_status(at(D(2026, 1, 1)), None).first()["status"] == "exploratory"


def _years(spark, members, bars, year=2019):
    cal = spark.createDataFrame([(D(2019, 1, d),) for d in (2, 3, 4, 7)], "session date")
    m = spark.createDataFrame(members, "symbol string, active_from date, active_to date")
    b = spark.createDataFrame([(s, D(2019, 1, d)) for s, days in bars.items() for d in days] or [("x", D(2019, 1, 2))], "symbol string, session date")
    return {r["symbol"]: r for r in cv.member_years(m, b, cal, (year, year)).collect()}


def test_member_year_categories(spark):
    got = _years(
        spark,
        [("ipo", D(2019, 1, 4), None), ("gone", D(2010, 1, 1), D(2019, 1, 3)), ("hole", D(2010, 1, 1), None), ("edge", D(2010, 1, 1), None), ("none", D(2010, 1, 1), None), ("full", D(2010, 1, 1), None)],
        {"ipo": (4, 7), "gone": (2, 3), "hole": (2, 7), "edge": (3,), "full": (2, 3, 4, 7)},
    )
    assert got["ipo"]["expected"] == 2 and got["ipo"]["adequate"] and got["ipo"]["category"].startswith("structural")
    assert got["gone"]["adequate"] and got["gone"]["category"].startswith("structural")
    assert got["hole"]["internal_gap"] == 2 and got["hole"]["category"] == "unexplained_internal_gaps" and not got["hole"]["adequate"]
    assert (got["edge"]["first_gap"], got["edge"]["last_gap"], got["edge"]["internal_gap"]) == (1, 2, 0)
    assert got["none"]["category"] == "zero_coverage" and got["full"]["category"] == "full_year_coverage"


def test_price_basis(spark):
    days = [D(2019, 1, 1) + dt.timedelta(days=i) for i in range(20)]
    px = ("open", "high", "low", "close")
    base = spark.createDataFrame([("A", d, 1.0, 2.0, 1.0, 2.0) for d in days], "symbol string, session date, open double, high double, low double, close double")
    base = base.select("symbol", "session", *[F.col(p).alias(f"__b_{p}") for p in px])
    rows = [("const", "A", d, 10.0, 20.0, 10.0, 20.0) for d in days] + [("moves", "A", d, 2.0, 4.0, 2.0, 4.0 + i % 2) for i, d in enumerate(days)] + [("short", "A", d, 1.0, 2.0, 1.0, 2.0) for d in days[:19]]
    donors = spark.createDataFrame(rows, "source_id string, symbol string, session date, open double, high double, low double, close double")
    got = {r["source_id"]: r["reason"] for r in cv.price_basis(base, donors, by=("source_id", "symbol")).collect()}
    assert got == {"const": "accepted_constant_ohlc_scale", "moves": "incompatible_adjustment_basis", "short": "insufficient_overlap"}


def test_effective_session_in_local_time(spark):
    cal = spark.createDataFrame([(D(2024, 1, d),) for d in (2, 3, 5)], "session date")
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [(1, at(2, 10), at(2, 10)), (2, at(2, 17), at(2, 17)), (3, at(1, 1), at(1, 1)), (4, at(4, 1), at(5, 1)), (5, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1))]
    df = spark.createDataFrame(rows, "id int, published_at timestamp, available_at timestamp")
    got = {r["id"]: r["effective_session"] for r in pit.effective_session(df, cal).collect()}
    assert got == {1: D(2024, 1, 3), 2: D(2024, 1, 5), 3: D(2024, 1, 2), 4: None, 5: D(2024, 1, 2)}


def test_interval_flags(spark):
    rows = spark.createDataFrame([("A", D(2020, 1, i)) for i in range(1, 6)], "symbol string, session date")
    m = spark.createDataFrame([("A", D(2020, 1, 2), D(2020, 1, 3)), ("A", D(2020, 1, 3), D(2020, 1, 3)), ("A", D(2020, 1, 5), None)], "symbol string, active_from date, active_to date")
    assert sorted(r["session"].day for r in iv.members_only(rows, m).collect()) == [2, 3, 5]
    assert [r["is_member"] for r in iv.active(rows, m).orderBy("session").collect()] == [False, True, True, False, True]


def test_overlapping_intervals_merge(spark):
    rng = np.random.default_rng(4)
    rows = [(s, D(2020, 1, 1) + dt.timedelta(days=int(a)), None if a > 115 else D(2020, 1, 1) + dt.timedelta(days=int(a + n))) for s in "AB" for a, n in zip(rng.integers(0, 120, 15), rng.integers(0, 6, 15))]
    m = spark.createDataFrame(rows, "symbol string, active_from date, active_to date")
    spans = iv.covered(m).collect()
    for s in "AB":
        own = sorted((x["active_from"], x["active_to"]) for x in spans if x["symbol"] == s)
        assert all(b[0] > a[1] + dt.timedelta(days=1) for a, b in zip(own, own[1:]))
        for i in range(130):
            day = D(2020, 1, 1) + dt.timedelta(days=i)
            assert any(a <= day <= b for a, b in own) == any(t == s and a <= day and (b is None or day <= b) for t, a, b in rows)


def test_average_rank_with_ties(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 400), "v": np.r_[np.full(150, 0.5), rng.normal(0, 1, 240).round(2), [-1e6, 1e6] * 5]})
    pdf["want"] = pdf.groupby("g")["v"].rank()
    got = cs.average_rank(spark.createDataFrame(pdf), "g", "v", "rank", buckets=16).toPandas()
    assert (got["rank"] == got["want"]).all() and len(got) == 400


def test_rank_buckets_stay_even_under_outliers(spark):
    """One value far out, and a third of the rows tied: no bucket holds over 1.5 times the mean."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": 1, "v": np.r_[rng.lognormal(0, 3, 6000), [1e15, -1e15, np.nan], np.full(3000, 7.0)]})
    df = spark.createDataFrame(pdf)
    cut = cs.in_buckets(df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("__n")), ["g"], "v", 32)
    sizes = [r["count"] for r in cut.groupBy("__b").count().collect()]
    assert len(sizes) == 32 and max(sizes) <= 1.5 * sum(sizes) / 32 + 1
    got = cs.average_rank(df, "g", "v", "rank").where("not isnan(v)").toPandas()
    assert (got["rank"] == got["v"].rank()).all()


def test_daily_ic_against_pandas(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"symbol": [str(i) for i in range(90)] * 2, "session": [D(2020, 1, 1)] * 90 + [D(2020, 1, 2)] * 90, "score": rng.integers(0, 9, 180).astype(float), "label": rng.normal(size=180)})
    got = {r["session"]: r for r in cs.daily_ic(spark.createDataFrame(pdf)).collect()}
    for day, part in pdf.groupby("session"):
        assert got[day]["symbols"] == 90
        assert got[day]["ic"] == pytest.approx(part["score"].corr(part["label"])) and got[day]["rank_ic"] == pytest.approx(part["score"].rank().corr(part["label"].rank()))


def test_drawdown_counts_the_starting_capital(spark):
    rows = [(D(2020, 1, 1), -0.5), (D(2020, 1, 2), 1.0), (D(2021, 1, 1), 0.1)]
    got = {r["year"]: r for r in cs.path_statistics(spark.createDataFrame(rows, "session date, daily_return double")).collect()}
    assert got[2020]["max_drawdown"] == pytest.approx(-0.5) and got[2020]["compounded"] == pytest.approx(0.0)
    assert got[2021]["compounded"] == pytest.approx(0.1)


def test_bad_symbols_and_dates_are_not_cut_or_lost(spark):
    rows = lambda symbol, day: spark.createDataFrame([(symbol, day, 1.0, 2.0, 0.5, 1.0, 9.0)], "symbol string, date string, open double, high double, low double, close double, volume double")
    assert sb.normalize_bars(rows("7", "2020-01-02")).first()["symbol"] == "000007"
    for symbol, day, what in (("1234567", "2020-01-02", "not a symbol"), ("60000x", "2020-01-02", "not a symbol"), ("600000", "2150-01-02", "not a session"), ("600000", "soon", "not a session")):
        with pytest.raises(Exception, match=what):
            sb.normalize_bars(rows(symbol, day)).collect()
    listing = spark.createDataFrame([(1234567, "20200101", None, "L", 1), (12, "20200101", None, "L", 2)], "symbol long, list_date string, delist_date string, list_status string, row_number long")
    assert [r["symbol"] for r in ref.normalize_listing(listing).collect()] == ["000012"]


def test_revision_conflicts_against_a_count(spark):
    """Copies, one revision with most rows and thousands of contents, NULLs in all columns, an empty table."""
    rows = [("hot", 1, 1, f"c{i % 4000}") for i in range(25_000)] + [("hot", 2, 1, "same")] * 12_000
    rows += [("s", i, i % 3, f"h{i % 5}") for i in range(500)] + [("s", i, i % 3, f"h{i % 7}") for i in range(0, 500, 9)]
    rows += [(None, 1, 1, "x"), (None, 1, 1, "x"), ("n", None, 1, "x"), ("n", None, 1, None), ("n", 5, None, None), ("n", 5, None, None), ("n", 6, 1, None)]
    copies = collections.defaultdict(list)
    for row, n in collections.Counter(rows).items():
        copies[row[:3]].append(n)
    want = {(*k, len(n), max(n), "conflicting_content" if len(n) > 1 else "duplicate_identity") for k, n in copies.items() if len(n) > 1 or max(n) > 1}
    df = spark.createDataFrame(rows, "source string, source_record_id long, revision_id int, content_hash string")
    assert {tuple(r) for r in pit.revision_conflicts(df.repartition(3)).collect()} == want
    assert pit.revision_conflicts(df.limit(0)).count() == 0


def test_revision_conflicts_hold_no_split(spark, monkeypatch):
    """Map tasks build no hash table, and partitions of many rows aren't joined by their compressed bytes."""
    monkeypatch.setattr(pit, "PARTITION_ROWS", 1000, raising=False)
    df = spark.range(5000).selectExpr("'s' AS source", "id AS source_record_id", "1 AS revision_id", "sha2('x', 256) AS content_hash")
    out = pit.revision_conflicts(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan
    assert plan.count("Aggregate") and plan.rindex("Aggregate") < plan.rindex("Exchange") < plan.index("MapInArrow")
    assert out.rdd.getNumPartitions() == 6

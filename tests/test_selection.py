import datetime as dt
import hashlib
import random

from pyspark.sql import functions as F

from tidemark.operators import coverage as cv
from tidemark.operators import intervals as iv
from tidemark.operators import quality
from tidemark.operators.selection import select_rank, sort_key


def test_sort_key_orders_as_doubles(spark):
    values = [float("-inf"), -1e300, -2.0, -1e-320, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e308, float("inf")]
    rows = spark.createDataFrame([(x,) for x in [*values, -0.0]], "x double").select("x", sort_key(F.col("x")).alias("k")).collect()
    keys = [r["k"] for r in rows]
    assert keys[:-1] == sorted(set(keys[:-1])) and keys[-1] == keys[4]


def test_ranks_against_sorting(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-9) + 1, float(rng.randint(-3, 3)), None])) for g in "aabbbbbbcd" for _ in range(60)]
    rows += [("e", None), ("e", 2.0)]
    groups = {g: sorted(x for k, x in rows if k == g and x is not None) for g in "abcde"}
    ranks = [(g, r) for g, xs in groups.items() for r in [len(xs) // 2 + 1]]
    got = select_rank(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", spark.createDataFrame(ranks, "g string, rank long"))
    assert {r["g"]: r["x"] for r in got.collect()} == {g: groups[g][r - 1] for g, r in ranks if r <= len(groups[g])}


def test_rank_of_a_large_group_and_no_list_in_the_plan(spark):
    rows = spark.range(1_000_000).select(F.lit("s").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(700_001)) / 1000.0).alias("x"))
    ranks = spark.createDataFrame([("s", 500_001)], "g string, rank long")
    expected = rows.orderBy("x").offset(500_000).first()["x"]
    assert select_rank(rows, ["g"], "x", ranks).first()["x"] == expected
    prices = "symbol string, session date, open double, high double, low double, close double"
    empty = spark.createDataFrame([], prices)
    plan = cv.price_basis(empty, empty)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_interval_joins_use_symbol_and_year(spark):
    day = dt.date
    spans = [("a", day(1999, 12, 30), day(2000, 1, 2)), ("a", day(2005, 6, 1), None), ("a", day(2003, 1, 1), day(2002, 1, 1)), ("b", None, day(2001, 1, 1)), ("b", day(1960, 1, 1), day(1971, 1, 1))]
    m = spark.createDataFrame(spans, "symbol string, active_from date, active_to date")
    days = [day(1959, 1, 1), day(1965, 1, 1), day(1999, 12, 29), day(1999, 12, 31), day(2000, 1, 2), day(2000, 1, 3), day(2002, 6, 1), day(2005, 5, 31), day(2005, 6, 1), day(2098, 1, 1), day(2150, 1, 1), None]
    rows = spark.createDataFrame([(s, d) for s in "ab" for d in days], "symbol string, session date")
    inside = lambda s, d: d is not None and any(x == s and f and f <= d and (t is None or d <= t) for x, f, t in spans)
    expected = {(s, d) for s in "ab" for d in days if inside(s, d)}
    joined = iv.members_only(rows, m)
    assert {(r["symbol"], r["session"]) for r in joined.collect()} == expected
    # here a span without a start begins with the calendar
    begun = lambda s, d: d is not None and any(x == s and (f or iv.FIRST_DAY) <= d and (t is None or d <= t) for x, f, t in spans)
    calendar = {(s, d) for s in "ab" for d in days if begun(s, d) and 1970 <= d.year <= 2099}
    flagged = iv.active(rows, m).collect()
    assert len(flagged) == rows.count() and {(r["symbol"], r["session"]) for r in flagged if r["is_member"]} == calendar
    for df in (joined, iv.active(rows, m)):
        assert "__y" in next(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)


def test_content_digest_by_stretches(spark):
    first = dt.date(1998, 1, 1)
    rows = [("s", first + dt.timedelta(days=i), 1.0, 2.0, 0.5, 1.5 + i, 10.0) for i in range(700)]
    df = spark.createDataFrame(rows, "symbol string, session date, open double, high double, low double, close double, volume double")
    got = quality.content_entries(df.orderBy(F.rand(1)), first, dt.date(2010, 1, 1)).first()
    hashes = df.select("session", quality.row_identity(df, ["symbol", "session", *quality.PRICES, "volume"]).alias("h")).collect()
    parts = {}
    for r in sorted(hashes, key=lambda r: r["session"]):
        parts.setdefault((r["session"] - dt.date(1970, 1, 1)).days // quality.STRETCH_DAYS, []).append(r["h"])
    sha = lambda xs: hashlib.sha256(",".join(xs).encode()).hexdigest()
    assert len(parts) > 2 and got["content_hash"] == "sha256:" + sha([sha(parts[k]) for k in sorted(parts)])
    assert (got["selected_rows"], got["min_session"], got["max_session"]) == (700, first, first + dt.timedelta(days=699))

"""Sources, quality, coverage, point-in-time joins, cross-section."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.identity import padded_symbol
from tidemark.operators import coverage as cv
from tidemark.operators import cross_section as cs
from tidemark.operators import events as ev
from tidemark.operators import intervals as iv
from tidemark.operators import outcomes as oc
from tidemark.operators import pit, quality, series
from tidemark.operators.indicators import add_indicators
from tidemark.operators.signals import signal
from tidemark.runtime import scratch
from tidemark.sources import bars as sb
from tidemark.sources import reference as ref
from tidemark.sources import sinks
from tidemark.sources.snapshot import content_snapshot, snapshot_id, verify_snapshot
from workload import common as c
from workload import sql_rules as sr
from workload.common import query, r, with_bars
from workload.study_queries import BREAKDOWN, STUDY, study_ctes, study_rows

S = "CAST(session AS VARCHAR) AS session"
D = dt.date
PX = ("open", "high", "low", "close")


# ---- sources -----------------------------------------------------------------
@query(with_bars(select=f"SELECT symbol, {S}, {r('close', 'close')}, {r('volume', 'volume')} FROM rawbars WHERE session BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'"))
def read_bars(spark, sf):
    """Bars written by symbol, then read back over a date range."""
    path = scratch(spark, "bars")
    c.raw_bars(spark, sf).repartition("symbol").write.partitionBy("symbol").parquet(path)
    df = sb.read_bars(spark, path, D(1998, 1, 1), D(1999, 12, 31))
    return c.publish(df.select("symbol", "session", "close", "volume"))


_messy_sql = """messy AS (SELECT symbol, session, CASE WHEN volume = 50 THEN 'n/a' ELSE CAST(open AS VARCHAR) END AS open, high, CASE WHEN volume = 49 THEN high + 1 ELSE low END AS low,
  CASE WHEN volume = 48 THEN 'NaN'::DOUBLE WHEN volume = 47 THEN -close ELSE close END AS close, CASE WHEN volume = 46 THEN 'NaN'::DOUBLE ELSE volume END AS volume, amount FROM rawbars),
 typed AS (SELECT symbol, session, try_cast(open AS DOUBLE) AS open, high, low, CASE WHEN isnan(close) THEN NULL ELSE close END AS close, CASE WHEN isnan(volume) THEN NULL ELSE volume END AS volume, amount FROM messy),
 good AS (SELECT * FROM typed WHERE session BETWEEN DATE '1996-01-01' AND DATE '2001-06-30' AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(open, close) AND low <= least(open, close))"""


def _messy(spark, sf):
    v = F.col("volume")
    nan = F.lit(float("nan"))
    return c.raw_bars(spark, sf).select(
        "symbol", F.col("session").alias("date"),
        F.when(v == 50, "n/a").otherwise(F.col("open").cast("string")).alias("open"), "high",
        F.when(v == 49, F.col("high") + 1).otherwise(F.col("low")).alias("low"),
        F.when(v == 48, nan).when(v == 47, -F.col("close")).otherwise(F.col("close")).alias("close"),
        F.when(v == 46, nan).otherwise(v).alias("volume"), F.col("amount").alias(sb.AMOUNT_FALLBACK),
    )


@query(with_bars(_messy_sql, select=f"""SELECT symbol, {S}, {', '.join(r(x, x) for x in PX)}, {r('volume', 'volume')}, {r('amount', 'amount')}, row_number() OVER w - 1 AS bar_ix,
  round_even(lag(close) OVER w * 1e8, 0) / 1e8 + 0.0 AS prev_close FROM good WINDOW w AS (PARTITION BY symbol ORDER BY session)"""))
def normalize_bars(spark, sf):
    df = sb.normalize_bars(_messy(spark, sf), D(1996, 1, 1), D(2001, 6, 30))
    return c.publish(df.select("symbol", "session", *PX, "volume", "amount", "bar_ix", "prev_close"))


@query("SELECT CASE WHEN l_suppkey < 100000 THEN lpad(CAST(l_suppkey AS VARCHAR), 6, '0') ELSE CAST(l_suppkey AS VARCHAR) END AS symbol, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS session, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_sessions(spark, sf):
    li = c.table(spark, sf, "lineitem").select(padded_symbol(F.col("l_suppkey")).alias("symbol"), F.to_date("l_shipdate").alias("session"))
    return c.publish(sb.repeated_sessions(li))


@query(with_bars("a AS (SELECT symbol, session, close, 0 AS p FROM rawbars WHERE symbol < '600010')", "b AS (SELECT symbol, session, close * 1.01 AS close, 1 AS p FROM rawbars)",
    "own AS (SELECT symbol, min(p) AS p FROM (SELECT symbol, p FROM a UNION ALL SELECT symbol, p FROM b) GROUP BY 1)",
    "base AS (SELECT u.symbol, u.session, u.close FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u JOIN own USING (symbol, p))",
    "top AS (SELECT symbol, session, close * 1.02 AS close FROM rawbars WHERE session >= DATE '2001-06-01')",
    select=f"SELECT coalesce(t.symbol, b.symbol) AS symbol, CAST(coalesce(t.session, b.session) AS VARCHAR) AS session, {r('coalesce(t.close, b.close)', 'close')} FROM base b FULL JOIN top t ON t.symbol = b.symbol AND t.session = b.session"))
def compose_sources(spark, sf):
    b = c.raw_bars(spark, sf).select("symbol", "session", "close")
    overlay = b.where(F.col("session") >= F.lit(D(2001, 6, 1))).withColumn("close", F.col("close") * 1.02)
    return c.publish(sb.compose_sources([b.where("symbol < '600010'"), b.withColumn("close", F.col("close") * 1.01)], overlay))


_factor = "CASE WHEN volume <> 50 THEN 1 + bar_ix / 10000.0 END"


@query(with_bars(f"f AS (SELECT *, CAST({_factor} AS DOUBLE) AS fa FROM bars)", "l AS (SELECT symbol, arg_max(fa, session) FILTER (WHERE fa IS NOT NULL) AS sc FROM f GROUP BY 1)",
    select=f"SELECT symbol, bar_ix, {r('CASE WHEN sc > 0 THEN open * fa / sc ELSE open END', 'open')}, {r('CASE WHEN sc > 0 THEN close * fa / sc ELSE close END', 'close')} FROM f JOIN l USING (symbol)"))
def adjust_prices(spark, sf):
    b = c.bars(spark, sf)
    b = b.withColumns({f"raw_{p}": F.col(p) for p in PX}).withColumn("adj_factor", F.when(F.col("volume") != 50, 1 + F.col("bar_ix") / 10000.0))
    return c.publish(sb.adjust_prices(b).select("symbol", "bar_ix", "open", "close"))


@query(with_bars("old AS (SELECT symbol, session, close, amount FROM rawbars WHERE session <= DATE '2001-06-30')",
    "new AS (SELECT symbol, session, close + 1 AS close, amount * 1000 AS amount FROM rawbars WHERE session >= DATE '2001-01-01' AND volume <> 50)",
    select=f"SELECT coalesce(n.symbol, o.symbol) AS symbol, CAST(coalesce(n.session, o.session) AS VARCHAR) AS session, {r('coalesce(n.close, o.close)', 'close')}, {r('coalesce(n.amount, o.amount)', 'amount', 2)} FROM old o FULL JOIN new n ON n.symbol = o.symbol AND n.session = o.session"))
def upsert_bars(spark, sf):
    b = c.raw_bars(spark, sf)
    existing = b.where(F.col("session") <= F.lit(D(2001, 6, 30))).select("symbol", "session", "close", "amount")
    vendor = b.where(F.col("session") >= F.lit(D(2001, 1, 1))).select(
        F.concat("symbol", F.lit(".X")).alias("ts_code"), F.date_format("session", "yyyyMMdd").alias("trade_date"), *PX,
        F.col("open").alias("pre_close"), F.col("volume").alias("vol"), "amount",
    ).withColumn("close", F.col("close") + 1)
    factors = vendor.select("ts_code", "trade_date", F.when(F.col("vol") != 50, F.lit(1.0)).alias("adj_factor"))
    listing = c.memberships(spark, sf).select(F.concat("symbol", F.lit(".X")).alias("ts_code"), "symbol", F.col("source").alias("name"))
    batch = sb.overlay_rows(vendor, factors, listing).select("symbol", "session", "close", "amount")
    out = sb.upsert_bars(existing, batch)
    return c.publish(out.withColumn("amount", F.rint(F.col("amount") * 100) / 100))


@query(f"WITH {c.MEMBERS_SQL} SELECT symbol, CAST(active_from AS VARCHAR) AS active_from, CAST(active_to AS VARCHAR) AS active_to FROM members")
def read_memberships(spark, sf):
    path = scratch(spark, "members")
    c.memberships(spark, sf).write.json(path)
    return c.publish(ref.read_memberships(spark, path).select("symbol", "active_from", "active_to"))


@query("""WITH b AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS symbol, CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'L' ELSE 'P' END AS st, o_orderkey AS n,
   CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS af, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 30 END AS ato FROM orders WHERE o_custkey < 1000000),
 k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY (st = 'D') DESC, CASE WHEN st = 'D' THEN -n WHEN st = 'L' THEN 1 ELSE 3 END DESC, n DESC) AS rn FROM b WHERE af IS NOT NULL)
 SELECT symbol, st AS list_status, CAST(af AS VARCHAR) AS active_from, CAST(ato AS VARCHAR) AS active_to FROM k WHERE rn = 1""")
def normalize_listing(spark, sf):
    o = c.table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    text = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", day.cast("string")).when(F.col("o_orderpriority") == "5-LOW", F.date_format(day, "yyyy/MM")).otherwise(F.date_format(day, "yyyyMMdd"))
    basics = o.select(
        F.col("o_custkey").alias("symbol"), text.alias("list_date"), F.date_format(F.date_add(day, 30), "yyyyMMdd").alias("delist_date"),
        F.when(F.col("o_orderstatus") == "F", "D").when(F.col("o_orderstatus") == "O", "L").otherwise("P").alias("list_status"), F.col("o_orderkey").alias("row_number"),
    )
    return c.publish(ref.normalize_listing(basics).select("symbol", "list_status", "active_from", "active_to"))


@query("""SELECT CASE WHEN p_partkey < 100000 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END AS symbol, p_type AS name, CAST(CASE WHEN p_size > 40 THEN DATE '1970-01-01' ELSE CAST(try_strptime('199001' || lpad(CAST(p_size AS VARCHAR), 2, '0'), '%Y%m%d') AS DATE) END AS VARCHAR) AS active_from,
  CASE WHEN p_retailprice > 950 THEN '2001-12-31' END AS active_to FROM part WHERE p_type LIKE '%ST%'""")
def st_intervals(spark, sf):
    p = c.table(spark, sf, "part").select(
        F.col("p_partkey").alias("symbol"), F.col("p_type").alias("name"),
        F.when(F.col("p_size") <= 40, F.concat(F.lit("199001"), F.lpad(F.col("p_size").cast("string"), 2, "0"))).alias("start_date"),
        F.when(F.col("p_retailprice") > 950, "20011231").alias("end_date"),
    )
    return c.publish(ref.st_intervals(p))


# Pages are the files: the role is the site's language, the path the url with its id.
_SNAP = """snap AS (SELECT regexp_extract(url, '://[^/]*/([a-z]*)', 1) AS role, url || '#' || page_id AS path, octet_length(encode(html)) AS size, 'sha256:' || sha256(html) AS sha256 FROM pages)"""


def _snapshot(spark, sf):
    p = c.table(spark, sf, "pages")
    path = F.concat("url", F.lit("#"), F.col("page_id").cast("string"))
    return content_snapshot(p.select(F.regexp_extract("url", "://[^/]*/([a-z]*)", 1).alias("role"), path.alias("path"), F.col("html").alias("content")))


@query(f"WITH {_SNAP} SELECT role, path, size::BIGINT AS size, sha256 FROM snap")
def file_snapshot(spark, sf):
    return _snapshot(spark, sf)


@query(f"""WITH {_SNAP}, e AS (SELECT substr(sha256(path), 1, 3) AS g, concat_ws('|', role, path, size::VARCHAR, sha256) AS entry FROM snap),
 d AS (SELECT g, sha256(string_agg(entry, chr(10) ORDER BY entry)) AS d FROM e GROUP BY 1) SELECT 'sha256:' || sha256(string_agg(d, chr(10) ORDER BY g)) AS snapshot_id FROM d""")
def file_snapshot_id(spark, sf):
    return snapshot_id(_snapshot(spark, sf))


@query(f"""WITH {_SNAP} SELECT role, path, CASE WHEN role = 'de' THEN 'not_in_manifest' WHEN role = 'fr' THEN 'size_mismatch' ELSE 'content_mismatch' END AS reason FROM snap WHERE role IN ('de', 'fr', 'es')
 UNION ALL SELECT 'gone', path, 'missing' FROM snap WHERE role = 'de'""")
def file_snapshot_verification(spark, sf):
    """A manifest with a wrong size, a wrong hash, files of a lost role and files it never had."""
    fresh = _snapshot(spark, sf)
    role = F.col("role")
    manifest = fresh.select(
        F.when(role == "de", "gone").otherwise(role).alias("role"), "path", F.when(role == "fr", F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(role == "es", "sha256:0").otherwise(F.col("sha256")).alias("sha256"),
    )
    return verify_snapshot(manifest, fresh)


@query(with_bars(*study_ctes(), select="SELECT 'breakdown' AS rule_id, symbol, horizon::BIGINT AS horizon, count(*) AS outcomes FROM outc GROUP BY 1, 2, 3"))
def write_events(spark, sf):
    path = scratch(spark, "events")
    rows = study_rows(spark, sf).select("rule_id", "symbol", "session", "horizon", "net_return")
    sinks.write_events(rows, path)
    back = sinks.read_events(spark, path, "breakdown", rows.schema)
    return c.publish(back.groupBy("rule_id", "symbol", "horizon").agg(F.count(F.lit(1)).alias("outcomes")))


# ---- quality -----------------------------------------------------------------
_dirty_sql = """dirty AS (SELECT symbol, bar_ix AS row_number, CASE WHEN volume = 44 THEN NULL WHEN volume = 45 THEN lag(session) OVER w WHEN volume = 43 THEN session - 10 ELSE session END AS session,
  CASE WHEN volume = 48 THEN -open ELSE open END AS open, CASE WHEN volume = 46 THEN low - 1 ELSE high END AS high, low,
  CASE WHEN volume = 50 THEN NULL WHEN volume = 49 THEN 'NaN'::DOUBLE ELSE close END AS close, CASE WHEN volume = 47 THEN -volume ELSE volume END AS volume, amount, prev_close, is_st FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session)),
 prv AS (SELECT *, last_value(session IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY row_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps FROM dirty),
 iss AS (SELECT *, CASE WHEN session IS NULL THEN 'null' WHEN session = ps THEN 'duplicate_session' WHEN session < ps THEN 'non_monotonic_session' WHEN close IS NULL THEN 'null' WHEN isnan(close) THEN 'non_finite'
   WHEN open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 THEN 'non_positive_price' WHEN volume < 0 THEN 'negative_volume' WHEN high < greatest(open, low, close) OR low > least(open, high, close) THEN 'ohlc_bounds' END AS issue_code FROM prv)"""


def _dirty(spark, sf):
    v, s = F.col("volume"), F.col("session")
    return c.bars(spark, sf).select(
        "symbol", F.col("bar_ix").alias("row_number"),
        F.when(v == 44, None).when(v == 45, F.lag("session").over(series.by_symbol())).when(v == 43, F.date_sub(s, 10)).otherwise(s).alias("session"),
        F.when(v == 48, -F.col("open")).otherwise(F.col("open")).alias("open"), F.when(v == 46, F.col("low") - 1).otherwise(F.col("high")).alias("high"), "low",
        F.when(v == 50, None).when(v == 49, F.lit(float("nan"))).otherwise(F.col("close")).alias("close"), F.when(v == 47, -v).otherwise(v).alias("volume"), "amount", "prev_close", "is_st",
    )


def _audited(spark, sf):
    return quality.row_issues(_dirty(spark, sf))


@query(with_bars(_dirty_sql, select="SELECT symbol, row_number, issue_code FROM iss"))
def row_issues(spark, sf):
    return _audited(spark, sf).select("symbol", "row_number", "issue_code")


@query(with_bars(_dirty_sql, select="SELECT 'clean' AS part, count(*) AS rows FROM iss WHERE issue_code IS NULL UNION ALL SELECT 'quarantine', count(*) FROM iss WHERE issue_code IS NOT NULL"))
def clean_and_quarantine(spark, sf):
    a = _audited(spark, sf)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows")
    return count(quality.clean(a), "clean").unionByName(count(quality.quarantine(a), "quarantine"))


@query(with_bars(_dirty_sql, select="SELECT issue_code, count(*) AS issues FROM iss WHERE issue_code IS NOT NULL GROUP BY 1"))
def issue_counts(spark, sf):
    return quality.campaign(_audited(spark, sf))[0]


@query(with_bars(_dirty_sql, select="SELECT count(*) AS rows, count(DISTINCT symbol) AS files, count(issue_code) AS issues, bool_and(issue_code IS NULL) AS admitted FROM iss"))
def quality_campaign(spark, sf):
    return quality.campaign(_audited(spark, sf))[1]


@query(with_bars(_dirty_sql, select="""SELECT count(*) FILTER (WHERE issue_code IS NOT NULL AND (session IS NULL OR session >= DATE '1999-01-01')) AS blocking_issues, count(*) FILTER (WHERE issue_code IS NOT NULL AND session < DATE '1999-01-01') AS excluded_issues,
  count(*) FILTER (WHERE issue_code IS NULL AND session BETWEEN DATE '1999-01-01' AND DATE '2000-12-31') AS research_rows, count(DISTINCT CASE WHEN issue_code IS NULL AND session BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' THEN symbol END) AS research_files, 'blocked' AS status FROM iss"""))
def window_admission(spark, sf):
    return quality.window_admission(_audited(spark, sf), D(1999, 1, 1), D(2000, 12, 31))


_hash_sql = "'sha256:' || sha256(concat_ws('|', {})) ".format(", ".join(
    f"'{n}=' || CAST({'CAST(' + n + ' AS DECIMAL(28,8))' if n not in ('symbol', 'session') else n} AS VARCHAR)" for n in sorted(["symbol", "session", *PX, "volume"])))


@query(with_bars(f"h AS (SELECT symbol, session, {_hash_sql} AS rh FROM rawbars WHERE session BETWEEN DATE '1999-01-01' AND DATE '2000-12-31')",
    "st AS (SELECT symbol, floor((session - DATE '1970-01-01') / 256) AS k, count(*) AS n, min(session) AS a, max(session) AS b, sha256(string_agg(rh, ',' ORDER BY session)) AS d FROM h GROUP BY 1, 2)",
    select="SELECT symbol, CAST(sum(n) AS BIGINT) AS selected_rows, CAST(min(a) AS VARCHAR) AS min_session, CAST(max(b) AS VARCHAR) AS max_session, 'sha256:' || sha256(string_agg(d, ',' ORDER BY k)) AS content_hash FROM st GROUP BY symbol"))
def content_entries(spark, sf):
    return c.publish(quality.content_entries(c.raw_bars(spark, sf), D(1999, 1, 1), D(2000, 12, 31)))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, array_to_string(list_filter([CASE WHEN s AND (b OR e) THEN 'suspended_but_tradable' END, CASE WHEN u AND b THEN 'limit_up_but_buyable' END, CASE WHEN d AND e THEN 'limit_down_but_sellable' END,
  CASE WHEN u AND d THEN 'both_limits' END, CASE WHEN s AND (u OR d) THEN 'suspended_with_limit' END], lambda x: x IS NOT NULL), ',') AS issues FROM
  (SELECT *, l_quantity < 5 AS s, l_discount > 0.07 AS u, l_tax > 0.06 AS d, l_returnflag = 'A' AS b, l_linestatus = 'O' AS e FROM lineitem)""")
def tradability_checks(spark, sf):
    li = c.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") < 5).alias("is_suspended"), (F.col("l_discount") > 0.07).alias("is_limit_up"), (F.col("l_tax") > 0.06).alias("is_limit_down"),
        (F.col("l_returnflag") == "A").alias("can_buy"), (F.col("l_linestatus") == "O").alias("can_sell"),
    )
    return c.publish(li.select("l_orderkey", "l_linenumber", "l_partkey", quality.tradability_issues().alias("issues")))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(split_part(text, chr(10), 2)) = '' THEN 'empty_title' END, CASE WHEN trim(text) = '' THEN 'empty_content' END], lambda x: x IS NOT NULL), ',') AS issues FROM documents""")
def text_checks(spark, sf):
    d = c.table(spark, sf, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(2)).alias("title"), F.col("text").alias("content"))
    return c.publish(d.select("doc_id", quality.text_issues("title", "content").alias("issues")))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, CASE WHEN b < a THEN 'interval_reversed' ELSE '' END AS issues FROM (SELECT *, CAST(l_shipdate AS DATE) AS a, CASE WHEN l_returnflag = 'A' THEN CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) - 5 END AS b FROM lineitem)""")
def constituent_checks(spark, sf):
    li = c.table(spark, sf, "lineitem")
    start = F.to_date("l_shipdate")
    rows = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.lit("000300").alias("index_symbol"), F.col("l_suppkey").cast("string").alias("constituent_symbol"), start.alias("effective_from"),
        F.when(F.col("l_returnflag") == "A", F.date_add(start, F.col("l_quantity").cast("int") - 5)).alias("effective_to"),
    )
    return c.publish(rows.select("l_orderkey", "l_linenumber", "l_partkey", quality.constituent_issues().alias("issues")))


@query(with_bars(select="""SELECT symbol, CAST(session AS VARCHAR) AS session, array_to_string(list_filter([CASE WHEN close - 52 <= 0 THEN 'invalid_close' END, CASE WHEN high < greatest(open, low, close - 52) OR low > least(open, high, close - 52) THEN 'ohlc_bounds' END], lambda x: x IS NOT NULL), ',') AS issues FROM rawbars"""))
def market_checks(spark, sf):
    b = c.raw_bars(spark, sf).withColumn("close", F.col("close") - 52)
    return c.publish(b.select("symbol", "session", quality.market_issues().alias("issues")))


_ORD = """rec AS (SELECT o_orderkey, o_orderstatus, o_custkey, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS pub,
  CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_custkey % 48 AS INTEGER)) AS av FROM orders)"""


def _records(spark, sf):
    o = c.table(spark, sf, "orders")
    base = F.to_date("o_orderdate").cast("timestamp")
    hours = lambda h: base + F.make_dt_interval(F.lit(0), h.cast("int"))
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", hours(F.col("o_orderkey") % 24).alias("published_at"), hours(F.col("o_custkey") % 48).alias("available_at"),
        hours(F.lit(30)).alias("ingested_at"), F.date_add(F.to_date("o_orderdate"), 1).alias("effective_session"),
    )


@query(f"""WITH {_ORD} SELECT o_orderkey, array_to_string(list_filter([CASE WHEN pub > av THEN 'available_before_published' END, CASE WHEN av > CAST(CAST(av - to_hours(CAST(o_custkey % 48 AS INTEGER)) AS DATE) AS TIMESTAMP) + INTERVAL 30 HOUR THEN 'ingested_before_available' END,
  CASE WHEN CAST(av - to_hours(CAST(o_custkey % 48 AS INTEGER)) AS DATE) + 1 <= CAST(greatest(pub, av) + INTERVAL 8 HOUR AS DATE) THEN 'effective_not_after_knowledge_date' END], lambda x: x IS NOT NULL), ',') AS issues FROM rec""")
def knowledge_order_checks(spark, sf):
    return c.publish(_records(spark, sf).select("o_orderkey", quality.pit_issues().alias("issues")))


@query(with_bars(select=f"""SELECT symbol, {S}, CASE WHEN b IS NOT NULL AND p IS NULL THEN 'prev_close_missing' ELSE 'prev_close_inconsistent' END AS issue FROM
  (SELECT symbol, session, CASE WHEN volume = 50 THEN NULL WHEN volume = 49 THEN prev_close + 0.5 ELSE prev_close END AS p, lag(close) OVER {sr.PLAIN} AS b FROM bars) WHERE (b IS NOT NULL AND p IS NULL) OR abs(p - b) > greatest(1e-10, abs(b) * 1e-10)"""))
def previous_close_checks(spark, sf):
    v = F.col("volume")
    b = c.bars(spark, sf).withColumn("prev_close", F.when(v == 50, None).when(v == 49, F.col("prev_close") + 0.5).otherwise(F.col("prev_close")))
    return c.publish(quality.previous_close_issues(b).select("symbol", "session", "issue"))


@query(with_bars(*study_ctes(), select=f"SELECT symbol, {S}, horizon::BIGINT AS horizon, CASE WHEN exit_at >= DATE '2001-06-01' THEN 'past_lockbox' ELSE '' END AS issues FROM outc"))
def outcome_checks(spark, sf):
    return c.publish(quality.outcome_issues(study_rows(spark, sf), D(2001, 6, 1), STUDY.round_trip).select("symbol", "session", "horizon", "issues"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf):
    return c.publish(quality.repeated_keys(c.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query(with_bars(select="SELECT CAST(max(session) AS VARCHAR) AS last_session, CASE WHEN max(session) >= DATE '2001-06-01' THEN 'contaminated' ELSE 'sealed' END AS status FROM rawbars"))
def lockbox_status(spark, sf):
    return c.publish(quality.lockbox_status(c.raw_bars(spark, sf), D(2001, 6, 1)))


_folds = """dd AS (SELECT session AS day, row_number() OVER (ORDER BY session) - 1 AS ix FROM (SELECT DISTINCT session FROM rawbars)),
 nn AS (SELECT count(*) AS n FROM dd), ff AS (SELECT i AS fold_id, 520 + i * 250 AS t0, least(520 + i * 250 + 250, n) - 1 AS t1, 520 + i * 250 - 20 - 1 AS r1 FROM nn, range(0, 100) g(i) WHERE 520 + i * 250 < n AND n >= 770),
 folds AS (SELECT fold_id, 0::BIGINT AS train_from, r1 AS train_to, t0 AS test_from, t1 AS test_to, a.day AS train_start, b.day AS train_end, x.day AS test_start, y.day AS test_end FROM ff JOIN dd a ON a.ix = 0 JOIN dd b ON b.ix = r1 JOIN dd x ON x.ix = t0 JOIN dd y ON y.ix = t1)"""


def _walk(spark, sf):
    return quality.walk_forward(c.raw_bars(spark, sf).select("session"), 500, 250, 20)


@query(with_bars(_folds, select="SELECT fold_id, train_from, train_to, test_from, test_to, CAST(train_start AS VARCHAR) AS train_start, CAST(train_end AS VARCHAR) AS train_end, CAST(test_start AS VARCHAR) AS test_start, CAST(test_end AS VARCHAR) AS test_end FROM folds"))
def walk_forward_folds(spark, sf):
    return c.publish(_walk(spark, sf))


_bdc, _ = sr.prepared([BREAKDOWN])


@query(with_bars(_folds, *_bdc, select=f"SELECT symbol, {S}, fold_id, CASE WHEN session BETWEEN test_start AND test_end THEN 'test' ELSE 'train' END AS role FROM prep JOIN folds ON session BETWEEN train_start AND train_end OR session BETWEEN test_start AND test_end WHERE {sr.matches(BREAKDOWN)}"))
def fold_labels(spark, sf):
    hits = signal(c.bars(spark, sf), BREAKDOWN.condition).select("symbol", "session")
    return c.publish(quality.label_folds(hits, _walk(spark, sf)).select("symbol", "session", "fold_id", "role"))


@query(with_bars(_dirty_sql, "pd AS (SELECT symbol, session, count(*) AS n, bool_or(NOT coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND NOT isnan(close) AND prev_close > 0, FALSE)) AS p, bool_or(NOT coalesce(volume >= 0, FALSE)) AS v, bool_or(coalesce(high < greatest(open, low, close) OR low > least(open, high, close), FALSE)) AS b FROM dirty GROUP BY 1, 2)",
    select="SELECT symbol, bool_or(n > 1) AS repeated_session, bool_or(p) AS bad_price, bool_or(v) AS bad_size, bool_or(b) AS bad_bounds, FALSE AS bad_st FROM pd GROUP BY symbol HAVING bool_or(n > 1 OR p OR v OR b)"))
def strict_contract(spark, sf):
    return quality.strict_contract(_dirty(spark, sf))


# ---- point in time -------------------------------------------------------------
@query(with_bars(_ORD, "cal AS (SELECT DISTINCT session FROM rawbars)", select="SELECT o_orderkey, CAST((SELECT min(session) FROM cal WHERE session > CAST(greatest(pub, av) + INTERVAL 8 HOUR AS DATE)) AS VARCHAR) AS effective_session FROM rec"))
def effective_session(spark, sf):
    cal = c.raw_bars(spark, sf).select("session").distinct()
    rec = _records(spark, sf).drop("effective_session")
    return c.publish(pit.effective_session(rec, cal).select("o_orderkey", "effective_session"))


def _revisions(spark, sf):
    return c.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("source"), F.col("l_orderkey").alias("source_record_id"), F.col("l_linenumber").alias("revision_id"),
        F.sha2((F.col("l_partkey") % 3).cast("string"), 256).alias("content_hash"), F.col("l_shipdate").cast("timestamp").alias("available_at"), "l_partkey", "l_suppkey", "l_extendedprice",
    )


@query("""WITH k AS (SELECT l_returnflag AS source, l_orderkey AS source_record_id, l_linenumber::BIGINT AS revision_id, l_partkey % 3 AS h, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4)
 SELECT source, source_record_id, revision_id, count(*) AS contents, max(n) AS most_copies, CASE WHEN count(*) > 1 THEN 'conflicting_content' ELSE 'duplicate_identity' END AS issue FROM k GROUP BY 1, 2, 3 HAVING count(*) > 1 OR max(n) > 1""")
def revision_conflicts(spark, sf):
    return c.publish(pit.revision_conflicts(_revisions(spark, sf)))


@query("""SELECT source, source_record_id, max(av)::DATE::VARCHAR AS available, max(revision_id) FILTER (WHERE av = m)::BIGINT AS revision_id FROM (SELECT l_returnflag AS source, l_orderkey AS source_record_id, l_linenumber AS revision_id, l_shipdate AS av,
  max(l_shipdate) OVER (PARTITION BY l_returnflag, l_orderkey) AS m FROM lineitem WHERE l_shipdate <= TIMESTAMP '1999-06-30') GROUP BY 1, 2""")
def latest_visible_revision(spark, sf):
    rows = pit.latest_visible(_revisions(spark, sf), F.lit(dt.datetime(1999, 6, 30)))
    return c.publish(rows.select("source", "source_record_id", F.to_date("available_at").alias("available"), "revision_id"))


@query(with_bars(c.MEMBERS_SQL, """ev AS (SELECT b.*, volume < 5 AS susp, EXISTS (SELECT 1 FROM members m WHERE m.symbol = b.symbol AND b.session >= m.active_from AND (m.active_to IS NULL OR b.session <= m.active_to)) AS listed,
   round_even(prev_close * 1.1 * 100, 0) / 100 AS up, round_even(prev_close * 0.9 * 100, 0) / 100 AS dn, month(session) <> 10 AS is_open, volume < 45 AS known FROM bars b WHERE prev_close IS NOT NULL)""",
    select=f"""SELECT symbol, {S}, is_open AND listed AND NOT susp AND open < up AS can_buy_open, is_open AND listed AND NOT susp AND open > dn AS can_sell_open,
      array_to_string(list_sort(list_filter([CASE WHEN listed THEN 'listed' ELSE 'not_listed' END, CASE WHEN is_st THEN 'st' END, CASE WHEN susp THEN 'suspended' END, CASE WHEN NOT is_open THEN 'market_closed' END,
      CASE WHEN is_open AND listed AND NOT susp AND open = up THEN 'at_up_limit' END, CASE WHEN is_open AND listed AND NOT susp AND open = dn THEN 'at_down_limit' END], lambda x: x IS NOT NULL)), ',') AS reason_codes FROM ev WHERE known"""))
def daily_tradability(spark, sf):
    b = c.bars(spark, sf).where("prev_close is not null")
    early = F.col("session").cast("timestamp")
    late = F.when(F.col("volume") < 45, early).otherwise(early + F.expr("INTERVAL 2 HOURS"))
    base = b.withColumn("available_at", early)
    cal = base.select("session", "available_at", (F.month("session") != 10).alias("is_open")).distinct()
    cents = lambda x: F.rint(F.col("prev_close") * x * 100) / 100
    listing = iv.active(base, c.memberships(spark, sf), flag="is_listed")
    out = pit.daily_tradability(
        cal, base.withColumn("is_suspended", F.col("volume") < 5), base, listing,
        base.withColumnRenamed("open", "open_price"), b.withColumns({"available_at": late, "up_limit": cents(1.1), "down_limit": cents(0.9)}),
    )
    return c.publish(out.select("symbol", "session", "can_buy_open", "can_sell_open", "reason_codes"))


@query(with_bars(c.MEMBERS_SQL, select="SELECT DISTINCT symbol FROM members WHERE active_from <= DATE '2001-01-15' AND (active_to IS NULL OR active_to >= DATE '2001-01-15')"))
def universe_as_of(spark, sf):
    return iv.members_on(c.memberships(spark, sf), D(2001, 1, 15))


def _part_members(spark, sf):
    return c.table(spark, sf, "part").select((F.col("p_partkey") + 600000).cast("string").alias("symbol"), F.lit(D(1995, 1, 1)).alias("active_from"), F.lit(None).cast("date").alias("active_to"))


@query(with_bars("u AS (SELECT DISTINCT CAST(p_partkey + 600000 AS VARCHAR) AS symbol FROM part)", select="SELECT symbol FROM u WHERE symbol NOT IN (SELECT symbol FROM rawbars)"))
def missing_prices(spark, sf):
    return iv.missing_prices(_part_members(spark, sf), c.raw_bars(spark, sf))


@query(with_bars("u AS (SELECT DISTINCT CAST(p_partkey + 600000 AS VARCHAR) AS symbol FROM part)", "m AS (SELECT count(*) AS n, count(*) FILTER (WHERE symbol NOT IN (SELECT symbol FROM rawbars)) AS k FROM u)",
    select=f"SELECT n AS universe_symbols, k AS missing_symbols, {r('(n - k) / n', 'coverage_ratio')}, CASE WHEN k = 0 THEN 'complete' ELSE 'incomplete_price_history' END AS status FROM m"))
def price_coverage(spark, sf):
    return c.publish(iv.price_coverage(_part_members(spark, sf), c.raw_bars(spark, sf)))


@query(with_bars("e AS (SELECT left(symbol, 3) AS dataset, symbol, is_st, (idx % 10 = 3 AND session BETWEEN DATE '1997-02-01' AND DATE '1998-11-30') AS x FROM rawbars)",
    select="SELECT dataset, count(*) AS rows, count(*) FILTER (WHERE is_st) AS cached_st, count(*) FILTER (WHERE x) AS expected_st, count(*) FILTER (WHERE is_st <> x) AS mismatches, count(DISTINCT CASE WHEN is_st <> x THEN symbol END) AS mismatched_symbols FROM e GROUP BY 1"))
def st_audit(spark, sf):
    b = c.raw_bars(spark, sf).withColumn("dataset", F.substring("symbol", 1, 3))
    st = c.memberships(spark, sf).where(F.substring("symbol", 4, 3).cast("int") % 10 == 3).select("symbol", F.lit(D(1997, 2, 1)).alias("active_from"), F.lit(D(1998, 11, 30)).alias("active_to"))
    return iv.st_audit(b, st)


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL AND sha256(d.text) NOT IN (SELECT sha256(e.text) FROM documents e JOIN labels USING (doc_id))")
def unknown_logic(spark, sf):
    d = c.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("logic_hash"))
    lab = c.table(spark, sf, "labels").select("doc_id")
    return pit.known_logic(d.join(lab, "doc_id", "left_anti"), d.join(lab, "doc_id", "left_semi"))[0].select("doc_id")


@query(with_bars(_dirty_sql, select=f"""SELECT i.symbol, i.row_number, CAST(i.session AS VARCHAR) AS session, i.issue_code, 'donor' AS replacement_source FROM iss i JOIN rawbars b ON b.symbol = i.symbol AND b.session = i.session WHERE i.issue_code IS NOT NULL AND b.volume < 49"""))
def replacement_rows(spark, sf):
    issues = quality.quarantine(_audited(spark, sf)).withColumn("source_id", F.lit("cache"))
    b = c.raw_bars(spark, sf)
    donors = b.where("volume < 49").select("symbol", "session", F.lit("donor").alias("source_id"), F.lit("h").alias("row_hash"))
    same = b.select("symbol", "session", F.lit("cache").alias("source_id"), F.lit("h").alias("row_hash"))
    return c.publish(pit.replacements(issues, donors.unionByName(same)).select("symbol", "row_number", "session", "issue_code", "replacement_source"))


# ---- coverage ------------------------------------------------------------------
@query(with_bars(c.MEMBERS_SQL, "per AS (SELECT symbol, count(*) AS n, min(session) AS f, max(session) AS l FROM rawbars WHERE session <= DATE '2001-10-31' GROUP BY 1)", "act AS (SELECT symbol FROM members WHERE active_to IS NULL)",
    "j AS (SELECT u.symbol, per.*, u.symbol IN (SELECT symbol FROM act) AS a FROM (SELECT DISTINCT CAST(p_partkey + 600000 AS VARCHAR) AS symbol FROM part UNION SELECT symbol FROM members) u LEFT JOIN per ON per.symbol = u.symbol)",
    select=f"""SELECT count(*) AS symbols_requested, count(n) AS symbols_loaded, sum(n)::BIGINT AS rows_loaded, CAST(min(f) AS VARCHAR) AS earliest, CAST(max(l) AS VARCHAR) AS latest, count(*) FILTER (WHERE a) AS active_symbols, count(*) FILTER (WHERE n < 60) AS short_histories,
      count(*) FILTER (WHERE n IS NULL) AS load_failures, count(*) FILTER (WHERE a AND l < DATE '2001-10-31' - 14) AS stale_active, count(*) FILTER (WHERE a AND l >= DATE '2001-10-31' - 14) AS fresh_active,
      {r('count(*) FILTER (WHERE a AND l >= DATE $$2001-10-31$$ - 14) / count(*) FILTER (WHERE a)', 'freshness_ratio')}, 'failed' AS status FROM j""".replace("$$", "'")))
def quality_profile(spark, sf):
    m = c.memberships(spark, sf)
    asked = _part_members(spark, sf).select("symbol").unionByName(m.select("symbol"))
    return c.publish(cv.profile(c.raw_bars(spark, sf), m.where("active_to is null"), asked, D(2001, 10, 31)))


@query(with_bars(select="SELECT symbol, count(*) AS observed_sessions, count(*) FILTER (WHERE volume <= 0) AS zero_volume, count(*) FILTER (WHERE is_st) AS st_rows, count(*) FILTER (WHERE open = high AND open = low AND open = close) AS one_price_boards, (SELECT count(DISTINCT session) FROM rawbars) AS calendar_count, (SELECT count(DISTINCT session) FROM rawbars) - count(*) AS missing_sessions FROM rawbars GROUP BY symbol"))
def feasibility(spark, sf):
    b = c.raw_bars(spark, sf)
    return cv.feasibility(b, b.select("session"))


_YEARS = """cal AS (SELECT DISTINCT session FROM rawbars), my AS (SELECT m.*, y AS year, greatest(active_from, make_date(y, 1, 1)) AS s, least(coalesce(active_to, make_date(y, 12, 31)), make_date(y, 12, 31)) AS e FROM members m, range(1995, 2002) g(y) WHERE year(active_from) <= y AND (active_to IS NULL OR year(active_to) >= y)),
 ex AS (SELECT my.symbol, my.year, cal.session, row_number() OVER (PARTITION BY my.symbol, my.year ORDER BY cal.session) AS k, b.symbol IS NOT NULL AS seen FROM my JOIN cal ON cal.session BETWEEN my.s AND my.e LEFT JOIN (SELECT symbol, session FROM rawbars WHERE volume < 45) b ON b.symbol = my.symbol AND b.session = cal.session),
 ag AS (SELECT symbol, year, count(*) AS expected, count(*) FILTER (WHERE seen) AS observed, min(k) FILTER (WHERE seen) AS lo, max(k) FILTER (WHERE seen) AS hi FROM ex GROUP BY 1, 2),
 yr AS (SELECT my.symbol, my.active_to, my.year, expected, observed, observed / expected AS ratio, CASE WHEN observed = 0 THEN expected ELSE lo - 1 END AS first_gap, CASE WHEN observed = 0 THEN 0 ELSE expected - hi END AS last_gap,
   CASE WHEN observed = 0 THEN 0 ELSE hi - lo + 1 - observed END AS internal_gap, (s > make_date(my.year, 1, 1) OR e < make_date(my.year, 12, 31)) AS structural FROM my JOIN ag ON ag.symbol = my.symbol AND ag.year = my.year),
 yy AS (SELECT *, observed > 0 AND ratio >= 0.99 AND internal_gap <= 3 AS adequate, CASE WHEN observed = 0 THEN 'zero_coverage' WHEN structural AND observed = expected THEN 'structural_partial_due_listing_or_delisting' WHEN internal_gap > 0 THEN 'unexplained_internal_gaps'
   WHEN first_gap > 0 OR last_gap > 0 THEN 'unexplained_edge_gaps' ELSE 'full_year_coverage' END AS category FROM yr)"""


def _member_years(spark, sf):
    b = c.raw_bars(spark, sf)
    return cv.member_years(c.memberships(spark, sf), b.where("volume < 45"), b.select("session").distinct(), (1995, 2001))


@query(with_bars(c.MEMBERS_SQL, _YEARS, select=f"SELECT symbol, year, expected, observed, {r('ratio', 'ratio')}, first_gap, last_gap, internal_gap, structural, adequate, category FROM yy"))
def member_year_coverage(spark, sf):
    rows = _member_years(spark, sf).select("symbol", "year", "expected", "observed", "ratio", "first_gap", "last_gap", "internal_gap", "structural", "adequate", "category")
    return c.publish(rows)


@query(with_bars(c.MEMBERS_SQL, _YEARS, """t AS (SELECT year, count(*) AS members, count(*) FILTER (WHERE adequate) AS adequate_members, count(*) FILTER (WHERE active_to IS NOT NULL) AS nonactive_members, count(*) FILTER (WHERE active_to IS NOT NULL AND adequate) AS nonactive_adequate, count(*) FILTER (WHERE category = 'zero_coverage') AS zero_members FROM yy GROUP BY 1)""",
    select=f"""SELECT *, {r('adequate_members / members', 'adequate_ratio')}, {r('CASE WHEN nonactive_members > 0 THEN nonactive_adequate / nonactive_members ELSE 1.0 END', 'nonactive_adequate_ratio')}, {r('zero_members / members', 'zero_ratio')},
      adequate_members / members >= 0.95 AND CASE WHEN nonactive_members > 0 THEN nonactive_adequate / nonactive_members ELSE 1.0 END >= 0.9 AND zero_members / members <= 0.005 AS passes FROM t"""))
def year_thresholds(spark, sf):
    return c.publish(cv.year_thresholds(_member_years(spark, sf)))


_donor_sql = """own AS (SELECT * FROM bars WHERE volume <= 30), don AS (SELECT 'd1' AS source_id, 1 AS priority, symbol, session, bar_ix, f, open * f AS open, high * f AS high, low * f AS low, close * f AS close, volume FROM (SELECT *, CASE WHEN symbol < '600010' THEN 2.0 ELSE 1 + bar_ix * 1e-4 END AS f FROM bars)
   UNION ALL SELECT 'd2', 2, symbol, session, bar_ix, 0.5, open * 0.5, high * 0.5, low * 0.5, close * 0.5, volume FROM bars WHERE symbol < '688000'),
 rt AS (SELECT d.source_id, d.priority, d.symbol, d.close / o.close AS q, greatest(abs((d.open / o.open) / (d.close / o.close) - 1), abs((d.high / o.high) / (d.close / o.close) - 1), abs((d.low / o.low) / (d.close / o.close) - 1), abs((d.close / o.close) / (d.close / o.close) - 1)) AS sp FROM don d JOIN own o ON o.symbol = d.symbol AND o.session = d.session),
 bs AS (SELECT source_id, priority, symbol, count(*) AS n, list_sort(list(q))[count(*) // 2 + 1] AS md, min(q) AS mn, max(q) AS mx, max(sp) AS sp FROM rt GROUP BY 1, 2, 3),
 vd AS (SELECT *, greatest(abs(mn / md - 1), abs(mx / md - 1)) AS cd FROM bs),
 rs AS (SELECT *, CASE WHEN n < 20 THEN 'insufficient_overlap' WHEN cd <= 1e-6 AND sp <= 1e-6 THEN 'accepted_constant_ohlc_scale' ELSE 'incompatible_adjustment_basis' END AS reason FROM vd)"""


def _donors(spark, sf):
    b = c.bars(spark, sf)
    scaled = lambda df, f: df.withColumns({p: F.col(p) * f for p in PX})
    f1 = F.when(F.col("symbol") < "600010", 2.0).otherwise(1 + F.col("bar_ix") * 1e-4)
    d1 = scaled(b, f1).withColumns({"source_id": F.lit("d1"), "priority": F.lit(1)})
    d2 = scaled(b.where("symbol < '688000'"), F.lit(0.5)).withColumns({"source_id": F.lit("d2"), "priority": F.lit(2)})
    return b.where("volume <= 30"), d1.unionByName(d2).select("source_id", "priority", "symbol", "session", *PX, "volume")


@query(with_bars(_donor_sql, select=f"SELECT source_id, symbol, n AS overlap_sessions, {r('md', 'close_ratio_median')}, {r('cd', 'close_dispersion')}, reason FROM rs"))
def price_basis(spark, sf):
    own, donors = _donors(spark, sf)
    base = own.select("symbol", "session", *[F.col(p).alias(f"__b_{p}") for p in PX])
    out = cv.price_basis(base, donors, by=("source_id", "symbol"))
    return c.publish(out.select("source_id", "symbol", "overlap_sessions", "close_ratio_median", "close_dispersion", "reason"))


_MISS = """cal AS (SELECT DISTINCT session FROM rawbars), mis AS (SELECT DISTINCT m.symbol, cal.session FROM members m JOIN cal ON cal.session >= m.active_from AND (m.active_to IS NULL OR cal.session <= m.active_to) WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.symbol = m.symbol AND o.session = cal.session))"""


@query(with_bars(c.MEMBERS_SQL, "own AS (SELECT * FROM bars WHERE volume <= 30)", _MISS, select=f"SELECT symbol, {S} FROM mis"))
def missing_sessions(spark, sf):
    own, _ = _donors(spark, sf)
    return c.publish(cv.missing_sessions(c.memberships(spark, sf), own, c.raw_bars(spark, sf)))


@query(with_bars(c.MEMBERS_SQL, _donor_sql, _MISS, "ch AS (SELECT symbol, arg_min(source_id, priority) AS source_id FROM rs WHERE reason LIKE 'accepted%' GROUP BY 1)",
    select=f"SELECT d.symbol, CAST(d.session AS VARCHAR) AS session, d.source_id, {r('d.close', 'close')} FROM don d JOIN ch ON ch.symbol = d.symbol AND ch.source_id = d.source_id JOIN mis ON mis.symbol = d.symbol AND mis.session = d.session"))
def fill_gaps(spark, sf):
    own, donors = _donors(spark, sf)
    miss = cv.missing_sessions(c.memberships(spark, sf), own, c.raw_bars(spark, sf))
    return c.publish(cv.fill_gaps(miss, own, donors).select("symbol", "session", "source_id", "close"))


# ---- calendar grid and cross-section ---------------------------------------------
_GRID = """gr AS (SELECT s.symbol, k.session, b.* EXCLUDE (symbol, session), b.close IS NOT NULL AS observed FROM (SELECT DISTINCT symbol FROM rawbars) s, (SELECT DISTINCT session FROM rawbars) k LEFT JOIN rawbars b ON b.symbol = s.symbol AND b.session = k.session)"""


@query(with_bars(_GRID, select=f"SELECT symbol, {S}, observed, {r('close', 'close')}, {r(f'last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'valuation_close')} FROM gr"))
def calendar_grid(spark, sf):
    g = series.grid(c.raw_bars(spark, sf))
    return c.publish(g.select("symbol", "session", "observed", "close", "valuation_close"))


@query(with_bars(_GRID, """rs AS (SELECT *, CASE WHEN NOT observed THEN 'no_observed_row' WHEN is_st THEN 'st_excluded' WHEN coalesce(volume <= 0, TRUE) THEN 'nonpositive_volume' WHEN open = high AND open = low AND open = close THEN 'suspected_one_price_board' ELSE 'approximate_observed_row' END AS buy,
   row_number() OVER (PARTITION BY symbol ORDER BY session) AS p, count(*) OVER (PARTITION BY symbol) AS n FROM gr)""",
    "nx AS (SELECT *, min(CASE WHEN buy = 'approximate_observed_row' THEN p END) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np FROM rs)",
    select=f"SELECT a.symbol, CAST(a.session AS VARCHAR) AS session, a.buy AS buy_resolution, CAST(b.session AS VARCHAR) AS sell_session, CASE WHEN a.np IS NULL THEN 'unresolved_no_eligible_observation' ELSE 'delayed_approximate_observed_row' END AS sell_resolution, coalesce(a.np, a.n) - a.p AS sell_delay FROM nx a LEFT JOIN rs b ON b.symbol = a.symbol AND b.p = a.np"))
def approximate_tradability(spark, sf):
    out = oc.approximate_trades(series.grid(c.raw_bars(spark, sf)))
    return c.publish(out.select("symbol", "session", "buy_resolution", "sell_session", "sell_resolution", "sell_delay"))


@query(with_bars(select=f"SELECT symbol, {S}, coalesce(volume <= 0, TRUE) OR is_st OR (open = high AND open = low AND open = close) AS blocked, {r('close / prev_close - 1', 'change')} FROM bars"))
def observed_gates(spark, sf):
    return c.publish(oc.observed_gates(c.bars(spark, sf)).select("symbol", "session", "blocked", "change"))


def _scores(spark, sf):
    df = add_indicators(c.bars(spark, sf), {("roc", 5)})
    nxt = F.lead("close").over(series.by_symbol()) / F.col("close") - 1
    return df.select("symbol", "session", F.rint(F.col("roc_5") * 1e4).alias("score"), nxt.alias("label"))


_SC = f"sc AS (SELECT symbol, session, round_even((close / lag(close, 5) OVER {sr.PLAIN} - 1) * 1e4, 0) AS score, lead(close) OVER {sr.PLAIN} / close - 1 AS label FROM bars)"
_IC = """fl AS (SELECT * FROM sc WHERE score IS NOT NULL AND label IS NOT NULL), rk AS (SELECT *, rank() OVER (PARTITION BY session ORDER BY score) + (count(*) OVER (PARTITION BY session, score) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY session ORDER BY label) + (count(*) OVER (PARTITION BY session, label) - 1) / 2.0 AS rl FROM fl),
 ic AS (SELECT session, count(*) AS symbols, CASE WHEN count(*) >= 2 AND max(score) > min(score) AND max(label) > min(label) THEN {C1} END AS ic, CASE WHEN count(*) >= 2 AND max(rs) > min(rs) AND max(rl) > min(rl) THEN {C2} END AS rank_ic FROM rk GROUP BY 1)""".replace("{C1}", c.settled("corr(score, label)")).replace("{C2}", c.settled("corr(rs, rl)"))


@query(with_bars(_SC, _IC, select=f"SELECT {S}, symbols, {r('ic', 'ic')}, {r('rank_ic', 'rank_ic')} FROM ic"))
def daily_ic(spark, sf):
    return c.publish(cs.daily_ic(_scores(spark, sf)))


@query(with_bars(_SC, _IC, select="SELECT year(session) AS year, count(ic) AS days, " + ", ".join(
    f"{r(f'avg({n})', f'{n}_mean')}, {r(f'stddev_samp({n})', f'{n}_std')}, {r(f'avg({n}) / nullif(stddev_samp({n}), 0)', f'{n}_ir', 6)}, {r(f'avg(CASE WHEN {n} > 0 THEN 1.0 WHEN {n} IS NOT NULL THEN 0.0 END)', f'{n}_positive_share')}" for n in ("ic", "rank_ic")) + " FROM ic GROUP BY 1"))
def ic_by_year(spark, sf):
    y = cs.ic_by_year(cs.daily_ic(_scores(spark, sf)))
    return c.publish(y.withColumns({f"{n}_ir": F.rint(F.col(f"{n}_ir") * 1e6) / 1e6 for n in ("ic", "rank_ic")}))


_EW = f"{_GRID}, ch AS (SELECT symbol, session, close / lag(close) OVER {sr.PLAIN} - 1 AS r FROM gr), ew AS (SELECT session, avg(r) AS daily_return, count(r) AS symbols FROM ch WHERE r IS NOT NULL GROUP BY 1)"


@query(with_bars(_EW, select=f"SELECT {S}, {r('daily_return', 'daily_return')}, symbols FROM ew"))
def equal_weight_returns(spark, sf):
    return c.publish(cs.equal_weight_returns(series.grid(c.raw_bars(spark, sf))))


@query(with_bars(c.BENCH_SQL, _EW, "wl AS (SELECT session, daily_return AS r, exp(sum(ln(1 + daily_return)) OVER (ORDER BY session)) AS w FROM ew)", "dr AS (SELECT *, w / greatest(1.0, max(w) OVER (ORDER BY session)) - 1 AS d FROM wl)",
    "bq AS (SELECT session, close / lag(close) OVER (ORDER BY session) - 1 AS b FROM bench)",
    select=f"SELECT year(d.session) AS year, count(*) AS days, {r('exp(sum(ln(1 + r))) - 1', 'compounded')}, {r('min(d)', 'max_drawdown')}, {r('exp(sum(ln(1 + b))) - 1', 'benchmark_compounded')}, {r('exp(sum(ln(1 + r))) - exp(sum(ln(1 + b)))', 'excess')} FROM dr d LEFT JOIN bq USING (session) GROUP BY 1"))
def return_path(spark, sf):
    ew = cs.equal_weight_returns(series.grid(c.raw_bars(spark, sf)))
    b = c.benchmark(spark, sf)
    b = b.select("session", (F.col("close") / F.lag("close").over(Window.orderBy("session")) - 1).alias("daily_return"))
    return c.publish(cs.path_statistics(ew, b))


@query(with_bars(_SC, "dy AS (SELECT session, lag(session) OVER (ORDER BY session) AS prev, isoyear(session) || '-' || lpad(weekofyear(session)::VARCHAR, 2, '0') AS iso_week FROM (SELECT DISTINCT session FROM sc))",
    "fs AS (SELECT iso_week, min(session) AS t, arg_min(prev, session) AS s FROM dy WHERE prev IS NOT NULL OR TRUE GROUP BY 1)",
    "tk AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, symbol) AS position FROM sc WHERE score IS NOT NULL)",
    select=f"SELECT iso_week, CAST(t AS VARCHAR) AS trade_session, CAST(s AS VARCHAR) AS score_session, symbol, {r('score', 'score')}, position FROM fs JOIN tk ON tk.session = fs.s WHERE position <= 5"))
def weekly_top(spark, sf):
    return c.publish(ev.weekly_top(_scores(spark, sf).select("symbol", "session", "score"), 5))


@query("SELECT o_orderkey, isoyear(o_orderdate)::BIGINT AS iso_year, weekofyear(o_orderdate) AS iso_week, year(o_orderdate) AS year, strftime(o_orderdate, '%Y%m%d') AS compact, CAST(CAST(o_orderdate + INTERVAL 20 HOUR + INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS local_day FROM orders")
def date_parts(spark, sf):
    o = c.table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    return c.publish(
        o.select(
            "o_orderkey", F.extract(F.lit("YEAROFWEEK"), day).alias("iso_year"), F.weekofyear(day).alias("iso_week"), F.year(day).alias("year"), F.date_format(day, "yyyyMMdd").alias("compact"),
            F.to_date(F.from_utc_timestamp(day.cast("timestamp") + F.expr("INTERVAL 20 HOURS"), "Asia/Shanghai")).alias("local_day"),
        )
    )



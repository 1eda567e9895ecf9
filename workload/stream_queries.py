"""The incremental study: bars arrive in three periods, in order."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.signals import lookback
from tidemark.runtime import scratch, stage
from tidemark.sources.store import Store
from tidemark.streaming import incremental as inc
from tidemark.streaming import symbol_state as ss
from workload import common as c
from workload.common import query, r, with_bars
from workload.screen_queries import hac_sql
from workload.study_queries import BREAKDOWN, RSI_LOW, STUDY, study_ctes, study_rows

S = "CAST(session AS VARCHAR) AS session"
D = dt.date
CUTS = (None, D(1998, 1, 1), D(2000, 6, 1), None)

_ctes = [x.replace(f"AND n_bars >= {lookback(BREAKDOWN) + max(STUDY.horizons) + 1} AND bar_ix < n_bars - 1 ", "") for x in study_ctes()]


def followed(spark, sf, repeat: bool = False) -> inc.FutureRun:
    """Write the bars period by period; after each, the stream takes what came.

    Every period starts a new query on the same checkpoint, so the state comes
    back from storage each time.
    """
    root = scratch(spark, "future")
    bars = c.raw_bars(spark, sf).select(*[f.split()[0] for f in inc.BAR_SCHEMA.split(", ")])
    run = inc.FutureRun(BREAKDOWN, c.benchmark(spark, sf), c.memberships(spark, sf), root, STUDY)
    overdue = F.col("session").between(F.lit(D(1997, 11, 1)), F.lit(D(1997, 11, 20))) & F.col("symbol").endswith("5")
    for lo, hi in zip(CUTS, CUTS[1:]):
        since = F.lit(True) if lo is None else F.col("session") >= F.lit(lo)
        part = bars.where(since if hi is None else since & (F.col("session") < F.lit(hi)))
        if repeat and lo is not None:  # the last weeks of the period before come again
            part = part.unionByName(bars.where((F.col("session") >= F.date_sub(F.lit(lo), 20)) & (F.col("session") < F.lit(lo))))
        if repeat and lo in CUTS[:2]:  # a few bars of the first period come with the second
            part = part.where(~overdue) if lo is None else part.unionByName(bars.where(overdue))
        part.write.mode("append").parquet(f"{root}/in")
        run.start(inc.read_bar_stream(spark, f"{root}/in", files_per_batch=100_000), f"{root}/checkpoint").awaitTermination()
    run.finish(spark)
    return run


_COLS = ("symbol", "session", "bar_ix", "horizon", "entry_at", "exit_at", "net_return", "benchmark_return", "excess_return")


@query(with_bars(*_ctes, select=f"""SELECT symbol, {S}, bar_ix, horizon::BIGINT AS horizon, CAST(entry_at AS VARCHAR) AS entry_at, CAST(exit_at AS VARCHAR) AS exit_at, {r('net_return', 'net_return')}, {r('benchmark_return', 'benchmark_return')},
  {r('net_excess_return', 'excess_return')} FROM outc WHERE benchmark_return IS NOT NULL"""))
def incremental_outcomes(spark, sf):
    return c.publish(followed(spark, sf).outcomes(spark).select(*_COLS))


@query(with_bars(*_ctes, select=f"""SELECT symbol, {S}, h::BIGINT AS horizon, 'tail_purged' AS status FROM (SELECT ahead.*, max(bar_ix) OVER (PARTITION BY symbol) AS last FROM ahead), (VALUES (1), (3), (5), (10), (20)) v(h)
  WHERE is_signal AND bar_ix + h > last AND EXISTS (SELECT 1 FROM members m WHERE m.symbol = ahead.symbol AND ahead.session >= m.active_from AND (m.active_to IS NULL OR ahead.session <= m.active_to))""".replace("ahead.symbol AND ahead.session >=", "t.symbol AND t.session >=").replace("ahead.session <=", "t.session <=").replace("FROM ahead), (VALUES", "FROM ahead) t, (VALUES")))
def incremental_tail(spark, sf):
    return c.publish(followed(spark, sf).tail_purged(spark).select("symbol", "session", "horizon", "status"))


@query(with_bars("per AS (SELECT *, CASE WHEN session < DATE '1998-01-01' THEN 1 WHEN session < DATE '2000-06-01' THEN 2 ELSE 3 END AS per FROM rawbars)",
    select=f"""SELECT symbol, {S}, 'repeated_session' AS reason, 1::BIGINT AS rows FROM per WHERE (per = 1 AND session >= DATE '1998-01-01' - 20) OR (per = 2 AND session >= DATE '2000-06-01' - 20)
  UNION ALL SELECT symbol, {S}, 'out_of_order', 1 FROM per WHERE session BETWEEN DATE '1997-11-01' AND DATE '1997-11-20' AND symbol LIKE '%5'"""))
def incremental_rejects(spark, sf):
    """Bars that arrive again a batch later, or for the first time a period late, are turned away with a reason."""
    return c.publish(followed(spark, sf, repeat=True).rejects(spark).select("symbol", "session", "reason", "rows"))


_rsi_ctes = [x.replace(f"AND n_bars >= {lookback(RSI_LOW) + max(STUDY.horizons) + 1} AND bar_ix < n_bars - 1 ", "") for x in study_ctes(RSI_LOW)]
FAR = dt.datetime(2099, 1, 1)


def in_store(spark, sf, rule, files, delay: str, at_once: bool) -> ss.SymbolRun:
    """The rule followed with its state in the state store, a file a batch; at the end a heartbeat releases what is held."""
    run = ss.SymbolRun(rule, c.memberships(spark, sf), scratch(spark, "state"), STUDY, delay)
    take = lambda: run.start(inc.read_bar_stream(spark, f"{run.root}/in")).awaitTermination()
    for part in files:
        part.coalesce(1).write.mode("append").parquet(f"{run.root}/in")
        if not at_once:
            take()
    if at_once:
        take()
    ss.heartbeat(spark, f"{run.root}/in", FAR, inc.BAR_SCHEMA)
    take()
    return run


def _arriving(spark, sf) -> DataFrame:
    return c.raw_bars(spark, sf).select(*[f.split()[0] for f in inc.BAR_SCHEMA.split(", ")])


@query(with_bars(*_rsi_ctes, select=f"""SELECT symbol, {S}, bar_ix, horizon::BIGINT AS horizon, CAST(entry_at AS VARCHAR) AS entry_at, CAST(exit_at AS VARCHAR) AS exit_at, {r('net_return', 'net_return')}, {r('benchmark_return', 'benchmark_return')},
  {r('net_excess_return', 'excess_return')} FROM outc WHERE benchmark_return IS NOT NULL""", recursive=True))
def state_outcomes(spark, sf):
    """A rule on a recursive indicator; four files in turns of a month, which come in no order."""
    bars = stage(_arriving(spark, sf), "arriving")
    files = [bars.where(F.month("session") % 4 == k) for k in (2, 0, 3, 1)]
    run = in_store(spark, sf, RSI_LOW, files, "4000 days", at_once=True)
    return c.publish(run.outcomes(spark, c.benchmark(spark, sf)).where("status = 'completed'").select(*_COLS))


@query(with_bars(*_rsi_ctes, select=f"""SELECT horizon::BIGINT AS horizon, count(*) AS outcomes, count(DISTINCT symbol) AS symbols, count(DISTINCT session) AS sessions, {r('avg(net_excess_return)', 'mean_excess', 6)}
  FROM outc WHERE benchmark_return IS NOT NULL GROUP BY 1""", recursive=True))
def state_outcomes_resumed(spark, sf):
    """The same from three files, each consumed by a query of its own that takes the state up from storage."""
    bars = stage(_arriving(spark, sf), "arriving")
    years = [bars.where(f"year(session) {cut}") for cut in ("< 1995", "between 1995 and 1997", "> 1997")]
    rows = in_store(spark, sf, RSI_LOW, years, "10 days", at_once=False).outcomes(spark, c.benchmark(spark, sf)).where("status = 'completed'")
    return c.publish(rows.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("outcomes"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("session").alias("sessions"), F.avg("excess_return").alias("mean_excess")
    ), 6)


@query(with_bars(select=f"""SELECT symbol, {S}, 'repeated_session' AS reason, 1::BIGINT AS rows FROM rawbars WHERE session >= DATE '1998-01-01' - 20 AND session < DATE '1998-01-01'
  UNION ALL SELECT symbol, {S}, 'out_of_order', 1 FROM rawbars WHERE session BETWEEN DATE '1997-12-01' AND DATE '1997-12-05' AND symbol LIKE '%5'
  UNION ALL SELECT symbol, {S}, 'before_kept_bars', 1 FROM rawbars WHERE session BETWEEN DATE '1996-06-01' AND DATE '1996-06-05' AND symbol LIKE '%7'"""))
def state_rejects(spark, sf):
    """Bars that come once more while held, or after the watermark let their symbol pass them."""
    bars = stage(_arriving(spark, sf), "arriving")
    overdue = (F.col("session").between(F.lit(D(1997, 12, 1)), F.lit(D(1997, 12, 5))) & F.col("symbol").endswith("5")) | (
        F.col("session").between(F.lit(D(1996, 6, 1)), F.lit(D(1996, 6, 5))) & F.col("symbol").endswith("7")
    )
    turn = F.lit(D(1998, 1, 1))
    first = bars.where((F.col("session") < turn) & ~overdue)
    second = bars.where((F.col("session") >= F.date_sub(turn, 20)) | overdue)
    run = in_store(spark, sf, BREAKDOWN, [first, second], "20 days", at_once=False)
    return c.publish(run.rejects(spark).select("symbol", "session", "reason", "rows"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem GROUP BY 1, 2 HAVING NOT bool_or(l_shipdate < TIMESTAMP '1998-01-01')")
def append_once(spark, sf):
    li = c.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    old = li.where(F.col("l_shipdate") < F.lit(dt.datetime(1998, 1, 1)))
    return c.publish(inc.append_once(old, li, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber"))


_LINES = ("l_orderkey", "l_linenumber", "shipped")
_IN_STORE = "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS shipped, {value} AS l_quantity FROM lineitem GROUP BY 1, 2, 3"


def _line_store(spark, sf) -> tuple[Store, DataFrame]:
    """An empty store of line items by year and bucket of the order, and its rows."""
    rows = c.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("shipped"), "l_quantity")
    parts = {"year": F.year("shipped"), "bucket": F.pmod("l_orderkey", F.lit(4)).cast("int")}
    return Store(scratch(spark, "lines"), _LINES, parts), rows


@query(_IN_STORE.format(value="coalesce(max(l_quantity) FILTER (WHERE l_quantity < 25), max(l_quantity))"))
def store_append(spark, sf):
    """Small quantities first, then all, then the first batch again: what was stored stays."""
    store, rows = _line_store(spark, sf)
    for batch in (rows.where("l_quantity < 25"), rows, rows.where("l_quantity < 25")):
        store.append(batch)
    return c.publish(store.read(spark).select(*_LINES, "l_quantity"))


@query(_IN_STORE.format(value="coalesce(max(l_quantity) FILTER (WHERE l_quantity >= 25 AND CAST(l_shipdate AS DATE) >= DATE '2001-01-01'), max(l_quantity) FILTER (WHERE l_quantity < 25), max(l_quantity))"))
def store_upsert(spark, sf):
    """All rows, then the small quantities, then the large ones of the last year, which rewrites that year alone."""
    store, rows = _line_store(spark, sf)
    for batch in (rows, rows.where("l_quantity < 25"), rows.where("l_quantity >= 25 and shipped >= date'2001-01-01'")):
        store.upsert(batch)
    return c.publish(store.read(spark).select(*_LINES, "l_quantity"))


@query(with_bars(*_ctes, "cd AS (SELECT session, count(*) OVER (ORDER BY session ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM (SELECT DISTINCT session FROM rawbars WHERE session <= DATE '2001-03-01'))",
    select="SELECT count(*) AS window_dates, count(*) FILTER (WHERE later >= 20) AS committed_dates, (SELECT count(*) FROM outc WHERE session BETWEEN DATE '1999-01-01' AND DATE '2001-06-30') AS events, 'accumulating_not_adjudicable' AS status FROM cd WHERE session >= DATE '1999-01-01'"))
def run_status(spark, sf):
    return inc.run_status(_batch(spark, sf), c.raw_bars(spark, sf), D(1999, 1, 1), D(2001, 6, 30), D(2001, 3, 1), 20)


def _batch(spark, sf):
    """The same committed rows from the batch study (equal to the stream)."""
    rows = study_rows(spark, sf).where("benchmark_return is not null")
    return rows.select("rule_id", "symbol", "session", "horizon", F.col("net_excess_return").alias("excess_return"), F.lit(STUDY.round_trip).alias("cost_round_trip"))


_adj_day = "day AS (SELECT 'breakdown' AS rule_id, horizon, session, k, avg(net_excess_return - (k - 1.0) * 0.0016) AS effect FROM outc, (VALUES (1.0::DOUBLE), (2.0)) v(k) GROUP BY 1, 2, 3, 4), evn AS (SELECT horizon, count(*) AS events FROM outc GROUP BY 1)"


@query(with_bars(*study_ctes(), _adj_day, *hac_sql("day", "rule_id, horizon, k"), "fam AS (SELECT hac.*, events, CASE WHEN events < 100 THEN 1.0 ELSE p END AS pp FROM hac JOIN evn USING (horizon))",
    "fk AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pp) AS rn, count(*) OVER (PARTITION BY k) AS mm FROM fam)",
    "fa AS (SELECT *, least(1.0, min(pp * mm / rn) OVER (PARTITION BY k ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adj FROM fk)",
    select=f"SELECT a.rule_id, a.horizon::BIGINT AS horizon, a.events, a.n_dates, CASE WHEN a.events < 100 THEN 'insufficient_events' ELSE a.evidence_status END AS evidence_status, {r('CASE WHEN a.events >= 100 THEN a.effect END', 'effect', 6)}, {r('a.adj', 'adjusted_p_value', 6)}, {r('b.adj', 'stress_adjusted_p_value', 6)} FROM fa a JOIN fa b ON a.horizon = b.horizon AND a.k = 1 AND b.k = 2"))
def adjudication(spark, sf):
    a = inc.adjudicate(_batch(spark, sf), STUDY.horizons)
    return c.publish(a.select("rule_id", "horizon", "events", "n_dates", "evidence_status", "effect", "adjusted_p_value", "stress_adjusted_p_value"), 6)

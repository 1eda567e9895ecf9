"""Signals, outcomes, event studies and their statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import outcomes as oc
from tidemark.operators import rules as ru
from tidemark.operators import signals as sg
from tidemark.operators import stats
from tidemark.operators.intervals import members_only
from tidemark.operators.series import number_bars
from tidemark.plans import event_study as es
from tidemark.runtime import scratch
from tidemark.sources import layout
from workload import common as c
from workload import sql_rules as sr
from workload.common import query, r, with_bars

STUDY = oc.Study(oos_start=c.OOS)
H = STUDY.horizons
BREAKDOWN = ru.breakdown_rule()
S = "CAST(session AS VARCHAR) AS session"

# ---- signals ----------------------------------------------------------------
_cat_ctes, _ = sr.prepared(ru.catalogue())
_cat_case = " UNION ALL ".join(
    f"SELECT '{x.id}' AS rule_id, '{x.version}' AS rule_version, symbol, {S}, bar_ix FROM prep WHERE {sr.matches(x)}" for x in ru.catalogue()
)


@query(with_bars(*_cat_ctes, select=_cat_case, recursive=True))
def catalogue_scan(spark, sf):
    return c.publish(sg.signals(c.bars(spark, sf), ru.catalogue()).select("rule_id", "rule_version", "symbol", "session", "bar_ix"))


_hammer = ru.catalogue_rule("hammer")
_ham_ctes, _ = sr.prepared([_hammer])
_ham_leaves = [sr.sql(n, _hammer.params) for n in _hammer.condition["all"]]


@query(with_bars(*_ham_ctes, select=f"""SELECT symbol, bar_ix,
  CASE WHEN bar_ix < {sg.lookback(_hammer)} THEN 'insufficient_data' WHEN {sr.sql(_hammer.condition, _hammer.params)} THEN 'matched' ELSE 'not_matched' END AS status,
  array_to_string([CASE WHEN {_ham_leaves[0]} THEN '1' ELSE '0' END, CASE WHEN {_ham_leaves[1]} THEN '1' ELSE '0' END, CASE WHEN {_ham_leaves[2]} THEN '1' ELSE '0' END], ',') AS passed,
  {r("CASE WHEN greatest(body, 0.01) = 0 THEN 0.0 ELSE lower_shadow / greatest(body, 0.01) END", "first_actual")}, 2.0::DOUBLE AS first_threshold FROM prep"""))
def signal_status_and_explanation(spark, sf):
    df = sg.prepare(c.bars(spark, sf), [_hammer])
    why = sg.explanation(_hammer)
    return c.publish(
        df.select(
            "symbol", "bar_ix", sg.status(_hammer).alias("status"),
            F.transform(why, lambda x: F.when(x["passed"], "1").otherwise("0")).alias("passed"),
            why[0]["actual"].alias("first_actual"), why[0]["threshold"].alias("first_threshold"),
        )
    )


_mixed = ru.Rule(
    "mixed", "1",
    {"any": [
        {"not": [{"gt": [ru.metric("close"), ru.metric("open")]}]},
        {"all": [{"gt": [{"div": [ru.metric("body"), ru.metric("range")]}, 0.8]}, {"gte": [{"add": [ru.metric("high"), ru.metric("low")]}, {"sub": [{"mul": [ru.metric("close"), 2]}, 0.5]}]}]},
        {"eq": [{"min": [ru.metric("open"), ru.metric("close")]}, ru.metric("low")]},
        {"lt": [{"abs": [ru.metric("roc", 3)]}, 0.001]},
    ]},
)
_mix_ctes, _ = sr.prepared([_mixed])


@query(with_bars(*_mix_ctes, select=f"SELECT symbol, {S}, bar_ix FROM prep WHERE {sr.matches(_mixed)}"))
def condition_tree_nodes(spark, sf):
    return c.publish(sg.signal(c.bars(spark, sf), _mixed.condition).select("symbol", "session", "bar_ix"))


@query(with_bars(select="SELECT symbol, bar_ix FROM bars WHERE close > open AND volume > 40"))
def signal_from_column(spark, sf):
    return sg.signal(c.bars(spark, sf), (F.col("close") > F.col("open")) & (F.col("volume") > 40)).select("symbol", "bar_ix")


_late = "available_at + CASE WHEN volume >= 48 THEN INTERVAL 30 HOUR ELSE INTERVAL 0 HOUR END"
_bd_ctes, _ = sr.prepared([BREAKDOWN])


@query(with_bars(*_bd_ctes, f"""seen AS (SELECT *, max({_late}) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) <= session + INTERVAL 39 HOUR AS ok FROM prep)""",
    select=f"""SELECT symbol, bar_ix, CASE WHEN bar_ix < {sg.lookback(BREAKDOWN)} THEN 'insufficient_data' WHEN NOT ok THEN 'data_error'
      WHEN {sr.sql(BREAKDOWN.condition, {})} THEN 'matched' ELSE 'not_matched' END AS status FROM seen"""))
def visibility_guard(spark, sf):
    late = F.col("available_at") + F.when(F.col("volume") >= 48, F.expr("INTERVAL 30 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    b = c.bars(spark, sf).withColumn("available_at", late)
    observed = F.col("session").cast("timestamp") + F.expr("INTERVAL 39 HOURS")
    df = sg.prepare(b, [BREAKDOWN]).withColumn("__seen", sg.visible(sg.lookback(BREAKDOWN), observed))
    return df.select("symbol", "bar_ix", sg.status(BREAKDOWN, F.col("__seen")).alias("status"))


# ---- outcomes ---------------------------------------------------------------
_LIMIT = "(CASE WHEN is_st THEN 0.05 WHEN symbol LIKE '688%' THEN 0.2 WHEN (symbol LIKE '300%' OR symbol LIKE '301%') AND session >= DATE '2020-08-24' THEN 0.2 ELSE 0.1 END::DOUBLE)"
GATES = f"""gates AS (SELECT *, coalesce(open > 0 AND prev_close > 0 AND open / prev_close - 1 >= {_LIMIT} - 0.001, FALSE) AS lim_up,
  coalesce(close > 0 AND prev_close > 0 AND close / prev_close - 1 <= -{_LIMIT} + 0.001, FALSE) AS lim_down,
  coalesce(volume <= 0, FALSE) AS no_volume, coalesce(amount <= 0, FALSE) AS no_amount FROM bars)"""


def ahead(source: str, keep: str) -> str:
    cols = [keep, f"lead(g.session) OVER w AS entry_at", "lead(g.open) OVER w AS entry_price", "lead(g.lim_up) OVER w AS entry_up"]
    for h in H:
        f = f"(PARTITION BY g.symbol ORDER BY g.session ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        cols += [
            f"lead(g.session, {h}) OVER w AS exit_at_{h}", f"lead(g.close, {h}) OVER w AS exit_{h}",
            f"lead(g.lim_down OR g.no_volume OR g.no_amount, {h}) OVER w AS blocked_{h}", f"lead(g.lim_down, {h}) OVER w AS down_{h}",
            f"max(g.high) OVER {f} AS hi_{h}", f"min(g.low) OVER {f} AS lo_{h}",
        ]
    return f"ahead AS (SELECT {', '.join(cols)} FROM {source} WINDOW w AS (PARTITION BY g.symbol ORDER BY g.session))"


def legs(where: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT *, {h} AS horizon, exit_at_{h} AS exit_at, exit_{h} AS exit_price, blocked_{h} AS blocked, down_{h} AS exit_down, hi_{h} AS hi, lo_{h} AS lo FROM ahead WHERE exit_at_{h} IS NOT NULL AND {where}"
        for h in H
    )
    return f"legs AS ({parts})"


OUT = """outc AS (SELECT l.*, l.exit_price / l.entry_price - 1.0 AS raw_return, l.exit_price / l.entry_price - 1.0 - 0.0016 AS net_return,
  x.close / e.open - 1.0 AS benchmark_return, l.exit_price / l.entry_price - 1.0 - (x.close / e.open - 1.0) AS excess_return,
  l.exit_price / l.entry_price - 1.0 - 0.0016 - (x.close / e.open - 1.0) AS net_excess_return,
  hi / entry_price - 1 AS mfe, lo / entry_price - 1 AS mae,
  CASE WHEN l.entry_at >= DATE '1999-01-01' THEN 'out_of_sample' ELSE 'in_sample' END AS sample_split, coalesce(reg.regime, 'unknown') AS regime
  FROM legs l LEFT JOIN bench e ON e.session = l.entry_at LEFT JOIN bench x ON x.session = l.exit_at LEFT JOIN reg ON reg.session = l.session
  {gate})"""
IS_MEMBER = "EXISTS (SELECT 1 FROM members m WHERE m.symbol = ahead.symbol AND ahead.session >= m.active_from AND (m.active_to IS NULL OR ahead.session <= m.active_to))"
LIVE = "WHERE NOT entry_up AND NOT blocked"


def study_ctes(rule: ru.Rule = BREAKDOWN, gate: str = LIVE, member: bool = True) -> list[str]:
    ctes, _ = sr.prepared([rule], source="gates")
    keep = f"g.symbol, g.session, g.bar_ix, g.amount AS signal_amount, {sr.matches(rule)} AND n_bars >= {sg.lookback(rule) + max(H) + 1} AND bar_ix < n_bars - 1 AS is_signal"
    where = "is_signal" + (f" AND {IS_MEMBER}" if member else "")
    return [GATES, *ctes, ahead("prep g", keep), c.BENCH_SQL, c.REGIME_SQL, c.MEMBERS_SQL, legs(where), OUT.format(gate=gate)]


def study_rows(spark, sf, rule=BREAKDOWN, study=STUDY):
    return es.run(c.bars(spark, sf), rule, c.benchmark(spark, sf), c.memberships(spark, sf), study)


_SUMMARY = f"""SELECT horizon::BIGINT AS horizon, regime, count(*) AS sample_size, {r('avg(net_excess_return)', 'mean_return')},
  {r('CASE WHEN count(*) >= 2 THEN stddev_samp(net_excess_return) END', 'sample_stddev')}"""
_GROUPS = "grp AS (SELECT horizon::BIGINT AS horizon, regime, count(*) AS n, avg(net_excess_return) AS m, CASE WHEN count(*) >= 2 THEN stddev_samp(net_excess_return) END AS sd FROM outc WHERE sample_split = 'out_of_sample' AND net_excess_return IS NOT NULL GROUP BY 1, 2)"
_TESTS = f"""tst AS (SELECT *, sd / sqrt(n) AS se, m / nullif(sd / sqrt(n), 0) AS t FROM grp), pv AS (SELECT *, {c.p_value_sql('t')} AS p FROM tst)"""
BH = """rk AS (SELECT *, row_number() OVER (PARTITION BY p IS NULL{fam} ORDER BY p) AS rn, count(*) OVER (PARTITION BY p IS NULL{fam}) AS mm FROM pv),
 bh AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(p * mm / rn) OVER (PARTITION BY p IS NULL{fam} ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS adj FROM rk)"""


@query(with_bars(*study_ctes(), _GROUPS, _TESTS, BH.format(fam=""), select=f"""SELECT horizon, regime, n AS sample_size, {r('m', 'mean_return')}, {r('sd', 'sample_stddev')}, {r('se', 'standard_error')},
  {r('t', 't_statistic')}, {r(f'm - {c.Z95} * se', 'ci_lower')}, {r(f'm + {c.Z95} * se', 'ci_upper')}, CASE WHEN n >= 2 THEN 'descriptive_only' ELSE 'insufficient_sample' END AS evidence_status,
  {r('p', 'raw_p_value')}, {r('adj', 'adjusted_p_value')}, coalesce(adj <= 0.05, FALSE) AS multiple_testing_reject FROM bh"""))
def event_study(spark, sf):
    """Flagship: signal, gated outcomes, regimes, statistics and FDR."""
    return c.publish(es.statistics(study_rows(spark, sf)))


_OUT_COLS = f"""symbol, {S}, bar_ix, horizon::BIGINT AS horizon, CAST(entry_at AS VARCHAR) AS entry_at, CAST(exit_at AS VARCHAR) AS exit_at,
  {r('entry_price', 'entry_price')}, {r('exit_price', 'exit_price')}, {r('raw_return', 'raw_return')}, {r('net_return', 'net_return')}, {r('benchmark_return', 'benchmark_return')},
  {r('excess_return', 'excess_return')}, {r('net_excess_return', 'net_excess_return')}, {r('mfe', 'mfe')}, {r('mae', 'mae')}, sample_split, regime, {r('signal_amount', 'signal_amount')}"""


@query(with_bars(*study_ctes(), select=f"SELECT {_OUT_COLS} FROM outc"))
def forward_outcomes(spark, sf):
    cols = ["symbol", "session", "bar_ix", "horizon", "entry_at", "exit_at", "entry_price", "exit_price", "raw_return", "net_return", "benchmark_return",
            "excess_return", "net_excess_return", "mfe", "mae", "sample_split", "regime", "signal_amount"]
    return c.publish(study_rows(spark, sf).select(*cols))


_WHY = """array_to_string(list_filter([CASE WHEN entry_up THEN 'entry:limit_up_buy_unavailable' END, CASE WHEN exit_down THEN 'exit:limit_down_sell_unavailable' END], lambda x: x IS NOT NULL), ',') AS reason_codes"""


@query(with_bars(*study_ctes(gate=""), select=f"SELECT symbol, {S}, horizon::BIGINT AS horizon, NOT entry_up AS entry_executable, NOT blocked AS exit_executable, {_WHY}, {r('net_return', 'net_return')} FROM outc"))
def gated_outcomes_with_reasons(spark, sf):
    rows = study_rows(spark, sf, study=oc.Study(oos_start=c.OOS, skip_untradeable=False))
    return c.publish(rows.select("symbol", "session", "horizon", "entry_executable", "exit_executable", "reason_codes", "net_return"))


_REPORT = "count(*) AS outcomes, " + ", ".join(
    r(f"avg({e})", n) for e, n in (("CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END", "win_rate"), ("net_return", "mean_net"), ("benchmark_return", "mean_benchmark"), ("net_excess_return", "mean_net_excess"), ("mfe", "mean_mfe"), ("mae", "mean_mae"))
)


@query(with_bars(*study_ctes(), select=f"SELECT CASE WHEN grouping(sample_split) = 1 THEN 'all' ELSE sample_split END AS section, horizon::BIGINT AS horizon, {_REPORT} FROM outc GROUP BY GROUPING SETS ((horizon), (sample_split, horizon))"))
def study_report(spark, sf):
    return c.publish(stats.report(study_rows(spark, sf)))


@query(with_bars(*study_ctes(), select=f"SELECT regime, count(*) AS outcomes, {r('avg(net_excess_return)', 'mean_net_excess')} FROM outc WHERE sample_split = 'out_of_sample' AND horizon = 3 AND net_excess_return IS NOT NULL GROUP BY 1"))
def regime_report(spark, sf):
    return c.publish(stats.regime_means(study_rows(spark, sf)))


# the derived prices swing inside a band: 30 is never reached
RSI_LOW = ru.Rule("rsi_low", "1", {"lt": [ru.metric("rsi", 14), 45.0]})


@query(with_bars(*study_ctes(RSI_LOW), select=f"SELECT {_OUT_COLS} FROM outc", recursive=True))
def rsi_outcomes(spark, sf):
    cols = ["symbol", "session", "bar_ix", "horizon", "entry_at", "exit_at", "entry_price", "exit_price", "raw_return", "net_return", "benchmark_return",
            "excess_return", "net_excess_return", "mfe", "mae", "sample_split", "regime", "signal_amount"]
    return c.publish(study_rows(spark, sf, RSI_LOW).select(*cols))


@query(with_bars(*study_ctes(), select=f"SELECT {_OUT_COLS} FROM outc"))
def laid_out_study(spark, sf):
    """The study over bars stored in buckets by symbol, which it reads without an exchange of their own."""
    path = scratch(spark, "laid")
    laid = layout.save_bars(c.raw_bars(spark, sf), path.rsplit("/", 1)[1].replace("-", "_"), buckets=8, path=path)
    rows = es.run(number_bars(laid), BREAKDOWN, c.benchmark(spark, sf), c.memberships(spark, sf), STUDY)
    cols = ["symbol", "session", "bar_ix", "horizon", "entry_at", "exit_at", "entry_price", "exit_price", "raw_return", "net_return", "benchmark_return",
            "excess_return", "net_excess_return", "mfe", "mae", "sample_split", "regime", "signal_amount"]
    return c.publish(rows.select(*cols))


@query(with_bars(*study_ctes(), select="SELECT count(*) AS outcomes_received, count(*) FILTER (WHERE net_excess_return IS NULL OR NOT (horizon > 0)) AS outcomes_excluded FROM outc"))
def outcome_exclusions(spark, sf):
    return stats.exclusions(study_rows(spark, sf))


@query(with_bars(*_bd_ctes, f"n AS (SELECT *, lead(open) OVER {sr.PLAIN} AS i, lead(close) OVER {sr.PLAIN} AS o, {sr.matches(BREAKDOWN)} AS hit FROM prep)",
    select=f"SELECT count(*) AS trades, {r('sum(o / i - 1)', 'gross_sum')}, {r('sum(o / i - 1 - 0.0016)', 'net_sum')} FROM n WHERE hit AND i > 0"))
def one_bar_backtest(spark, sf):
    df = sg.prepare(c.bars(spark, sf), [BREAKDOWN])
    return c.publish(oc.one_bar_backtest(df, 0.0016, sg.matches(BREAKDOWN)))


@query(with_bars(*_bd_ctes, select=f"""SELECT symbol, bar_ix, h::BIGINT AS horizon, CASE WHEN n_bars - 1 - bar_ix >= h + 5 THEN 'completed' ELSE 'tail_purged' END AS status
  FROM prep, (VALUES (5), (10), (20)) v(h) WHERE {sr.matches(BREAKDOWN)}"""))
def matured_or_tail(spark, sf):
    df = sg.signal(c.bars(spark, sf), BREAKDOWN.condition)
    return c.publish(oc.maturity(df, (5, 10, 20), delay=5).select("symbol", "bar_ix", "horizon", "status"))


_PANEL_WHY = """array_to_string(list_filter([CASE WHEN no_volume THEN 'zero_or_invalid_volume' END, CASE WHEN no_amount THEN 'zero_or_invalid_amount' END, CASE WHEN lim_down THEN 'limit_down_sell_unavailable' END], lambda x: x IS NOT NULL), ',')"""


@query(with_bars(GATES, select=f"""SELECT symbol, {S}, NOT lim_up AS tradeable_open, NOT (lim_down OR no_volume OR no_amount) AS tradeable_close,
  CASE WHEN lim_up THEN 'limit_up_buy_unavailable' ELSE '' END AS open_reason_codes, {_PANEL_WHY} AS close_reason_codes FROM gates WHERE prev_close IS NOT NULL"""))
def execution_panel(spark, sf):
    panel, _ = oc.execution_panel(c.bars(spark, sf))
    return c.publish(panel.select("symbol", "session", "tradeable_open", "tradeable_close", "open_reason_codes", "close_reason_codes"))


@query(with_bars(select=f"SELECT symbol, {S}, 'missing_prev_close_first_available_bar' AS reason, {r('close', 'close_reference')} FROM bars WHERE prev_close IS NULL"))
def execution_panel_set_aside(spark, sf):
    return c.publish(oc.execution_panel(c.bars(spark, sf))[1])


@query(with_bars(*_bd_ctes, c.MEMBERS_SQL, select=f"""SELECT symbol, {S} FROM prep p WHERE {sr.matches(BREAKDOWN)} AND EXISTS (SELECT 1 FROM members m WHERE m.symbol = p.symbol
  AND p.session >= m.active_from AND (m.active_to IS NULL OR p.session <= m.active_to))"""))
def membership_semi_join(spark, sf):
    hits = sg.signal(c.bars(spark, sf), BREAKDOWN.condition)
    return c.publish(members_only(hits, c.memberships(spark, sf)).select("symbol", "session"))


_within = [
    "cut AS (SELECT * EXCLUDE (bar_ix, n_bars, prev_close) FROM bars WHERE session BETWEEN DATE '1996-01-01' AND DATE '2000-12-31')",
    "inside AS (SELECT *, row_number() OVER w - 1 AS bar_ix, count(*) OVER (PARTITION BY symbol) AS n_bars, lag(close) OVER w AS prev_close FROM cut WINDOW w AS (PARTITION BY symbol ORDER BY session))",
    *[x.replace("FROM bars)", "FROM inside)") if x.startswith("gates AS") else x for x in study_ctes()],
]


@query(with_bars(*_within, select=f"SELECT symbol, {S}, horizon::BIGINT AS horizon, CAST(exit_at AS VARCHAR) AS exit_at, {r('net_excess_return', 'net_excess_return')}, sample_split FROM outc"))
def study_within_boundaries(spark, sf):
    """Start, out-of-sample start, end and lockbox: the end cuts the bars first."""
    rows = es.run_within(
        c.bars(spark, sf), BREAKDOWN, dt.date(1996, 1, 1), dt.date(1999, 1, 1), dt.date(2000, 12, 31), dt.date(2001, 6, 1),
        benchmark=c.benchmark(spark, sf), memberships=c.memberships(spark, sf), study=STUDY,
    )
    return c.publish(rows.select("symbol", "session", "horizon", "exit_at", "net_excess_return", "sample_split"))


@query(with_bars(*_bd_ctes, select=f"SELECT symbol, {S}, bar_ix FROM prep WHERE {sr.matches(BREAKDOWN)} ORDER BY symbol, session"))
def ordered_signals(spark, sf):
    return c.publish(sg.signal(c.bars(spark, sf), BREAKDOWN.condition).select("symbol", "session", "bar_ix")).orderBy("symbol", "session")

"""Many-rule scans, event sets, dated tests, rankings."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.functions.identity import row_identity
from tidemark.operators import events as ev
from tidemark.operators import outcomes as oc
from tidemark.operators import rules as ru
from tidemark.operators import series
from tidemark.operators import signals as sg
from tidemark.operators import stats
from tidemark.plans import rule_comparison as rc
from tidemark.plans import rule_screen as rs
from workload import common as c
from workload import sql_rules as sr
from workload.common import query, r, with_bars
from workload.study_queries import BREAKDOWN, GATES, H, IS_MEMBER, LIVE, OUT, STUDY, ahead, legs, study_ctes, study_rows

S = "CAST(session AS VARCHAR) AS session"
SCREEN = ru.screen_rules()
GRAMMAR = ru.grammar_rules()
# the derived prices are a random walk inside a band, so the gates are lower
LOOSE = replace(STUDY, min_observations=30, min_horizons=1)


def _names(rules):
    return "[" + ", ".join(f"'{x.name}'" for x in rules) + "]"


def _counts_sql(rules):
    return f"SELECT rule_id, count(n.rule) AS signals FROM (SELECT unnest({_names(rules)}) AS rule_id) LEFT JOIN (SELECT {_names(rules)}[rule + 1] AS rule_id, rule FROM (SELECT unnest(matched) AS rule FROM hits)) n USING (rule_id) GROUP BY rule_id"


def scan_ctes(rules, forward=True, member=True):
    need = max(sg.lookback(x) for x in rules) + max(H) + 1
    ctes, _ = sr.prepared(rules, source="gates")
    keep = f"g.symbol, g.session, g.bar_ix, g.n_bars, {sr.matched_list(rules)} AS matched"
    where = f"len(matched) > 0 AND n_bars > {need}" + (f" AND {IS_MEMBER}" if member else "")
    out = [GATES, *ctes, ahead("prep g", keep), c.BENCH_SQL, c.REGIME_SQL, c.MEMBERS_SQL, f"hits AS (SELECT * FROM ahead WHERE {where})"]
    if forward:
        out += [legs(where), OUT.format(gate=LIVE)]
    return out


@query(with_bars(*scan_ctes(SCREEN, forward=False), recursive=True,
    select=_counts_sql(SCREEN)))
def wide_screen_signal_counts(spark, sf):
    return rs.signal_counts(c.bars(spark, sf), SCREEN, STUDY, c.memberships(spark, sf))


@query(with_bars(*scan_ctes(GRAMMAR, forward=False, member=False), recursive=True,
    select=_counts_sql(GRAMMAR)))
def grammar_signal_counts(spark, sf):
    return rs.signal_counts(c.bars(spark, sf), GRAMMAR, STUDY)


_grp = """grp AS (SELECT rule, horizon::BIGINT AS horizon, regime, count(*) AS n, avg(net_excess_return) AS m, CASE WHEN count(*) >= 2 THEN stddev_samp(net_excess_return) END AS sd
  FROM (SELECT unnest(matched) AS rule, horizon, regime, net_excess_return FROM outc WHERE sample_split = 'out_of_sample' AND net_excess_return IS NOT NULL) GROUP BY 1, 2, 3)"""


@query(with_bars(*scan_ctes(SCREEN), _grp, recursive=True,
    select=f"SELECT {_names(SCREEN)}[rule + 1] AS rule_id, horizon, regime, n AS sample_size, {r('m', 'mean_return')}, {r('sd', 'sample_stddev')}, {r('m / nullif(sd / sqrt(n), 0)', 't_statistic', 6)} FROM grp"))
def wide_screen_groups(spark, sf):
    g = rs.group_statistics(c.bars(spark, sf), SCREEN, c.benchmark(spark, sf), STUDY, c.memberships(spark, sf))
    return c.publish(g.select("rule_id", "horizon", "regime", "sample_size", "mean_return", "sample_stddev", F.round("t_statistic", 6).alias("t_statistic")))


_mult = f"""mult AS (SELECT grp.*, k, m - (k - 1.0) * 0.0016 AS mk FROM grp, (VALUES (1.0::DOUBLE), (2.0), (3.0)) v(k)),
 tst AS (SELECT *, sd / sqrt(n) AS se, mk / nullif(sd / sqrt(n), 0) AS t FROM mult), pv AS (SELECT *, {c.p_value_sql('t')} AS p FROM tst),
 rk AS (SELECT *, row_number() OVER (PARTITION BY p IS NULL, k ORDER BY p) AS rn, count(*) OVER (PARTITION BY p IS NULL, k) AS mm FROM pv),
 bh AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(p * mm / rn) OVER (PARTITION BY p IS NULL, k ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS adj FROM rk),
 ok AS (SELECT *, coalesce(n >= 30 AND mk > 0 AND mk - {c.Z95} * se > 0 AND adj <= 0.05, FALSE) AS good FROM bh),
 per AS (SELECT rule, horizon, regime, any_value(n) AS n, max(CASE WHEN k = 1 THEN mk END) AS m, bool_and(good) AS passes FROM ok GROUP BY 1, 2, 3)"""


@query(with_bars(*scan_ctes(SCREEN), _grp, _mult, recursive=True, select=f"""SELECT rule_id, count(*) FILTER (WHERE passes) AS passing_groups,
  count(DISTINCT CASE WHEN passes THEN horizon END) AS passing_horizons, CASE WHEN coalesce(bool_or(passes), FALSE) THEN 'passed_screen' ELSE 'rejected' END AS status,
  CASE WHEN NOT coalesce(bool_or(passes), FALSE) THEN 'no_passing_group' END AS rejection_reason, {r('max(CASE WHEN passes THEN m END)', 'best_mean')}
  FROM (SELECT unnest({_names(SCREEN)}) AS rule_id) LEFT JOIN (SELECT *, {_names(SCREEN)}[rule + 1] AS rule_id FROM per) p USING (rule_id) GROUP BY rule_id"""))
def screen_verdict(spark, sf):
    v = rs.screen(c.bars(spark, sf), SCREEN, c.benchmark(spark, sf), LOOSE, c.memberships(spark, sf))
    return c.publish(v.select("rule_id", "passing_groups", "passing_horizons", "status", "rejection_reason", "best_mean"))


@query(with_bars(*scan_ctes(SCREEN), _grp, _mult, recursive=True, select=f"""SELECT {_names(SCREEN)}[rule + 1] AS rule_id, {r('max(m)', 'best_mean')} FROM per WHERE passes GROUP BY rule
  ORDER BY max(m) DESC, rule_id LIMIT 10"""))
def top_rules(spark, sf):
    v = rs.screen(c.bars(spark, sf), SCREEN, c.benchmark(spark, sf), LOOSE, c.memberships(spark, sf))
    return c.publish(ev.top_rules(v, 10).select("rule_id", "best_mean"))


# Best rule first; each joins the most similar kept one (the earlier of equals) at 0.85 or more, else is kept.
_kept = f"""ver AS (SELECT rule_id, count(*) FILTER (WHERE passes) AS pg, max(CASE WHEN passes THEN m END) AS bm FROM (SELECT unnest({_names(SCREEN)}) AS rule_id) LEFT JOIN (SELECT *, {_names(SCREEN)}[rule + 1] AS rule_id FROM per) p USING (rule_id) GROUP BY rule_id),
 ranked AS (SELECT rule_id, list_position({_names(SCREEN)}, rule_id) - 1 AS rule, row_number() OVER (ORDER BY bm DESC, rule_id) AS n FROM ver WHERE pg > 0),
 one AS (SELECT symbol, bar_ix, n FROM (SELECT symbol, bar_ix, unnest(matched) AS rule FROM hits) JOIN ranked USING (rule)),
 pair AS (SELECT a.n AS n, b.n AS k, count(*) AS n_both FROM one a JOIN one b ON a.symbol = b.symbol AND a.bar_ix = b.bar_ix AND b.n <= a.n GROUP BY 1, 2),
 alone AS (SELECT n, n_both AS c FROM pair WHERE n = k),
 jac AS (SELECT x.n, list(coalesce(p.n_both / (x.c + y.c - p.n_both), 0.0) ORDER BY y.n) AS js FROM alone x JOIN alone y ON y.n < x.n LEFT JOIN pair p ON p.n = x.n AND p.k = y.n GROUP BY 1),
 greedy(n, kept, cluster) AS (SELECT 1::BIGINT, [1::BIGINT], 0::BIGINT UNION ALL
   SELECT g.n + 1, CASE WHEN list_max(v) >= 0.85 THEN kept ELSE list_append(kept, g.n + 1) END, CASE WHEN list_max(v) >= 0.85 THEN list_position(v, list_max(v)) - 1 ELSE len(kept) END
   FROM (SELECT g.n, g.kept, list_transform(g.kept, lambda k: js[k]) AS v FROM greedy g JOIN jac ON jac.n = g.n + 1) g),
 marked AS (SELECT rule_id, cluster, len(kept) = len(lag(kept) OVER (ORDER BY n)) AS copy FROM greedy JOIN ranked USING (n))"""


@query(with_bars(*scan_ctes(SCREEN), _grp, _mult, _kept, recursive=True, select="""SELECT rule_id, CASE WHEN pg = 0 OR coalesce(copy, FALSE) THEN 'rejected' ELSE 'passed_screen' END AS status,
  CASE WHEN pg = 0 THEN 'no_passing_group' WHEN copy THEN 'duplicate_of_kept_candidate' END AS rejection_reason, cluster FROM ver LEFT JOIN marked USING (rule_id)"""))
def screen_without_duplicates(spark, sf):
    """Greedy choice over the verdict table."""
    v = rs.screen_without_duplicates(c.bars(spark, sf), SCREEN, c.benchmark(spark, sf), LOOSE, c.memberships(spark, sf))
    return c.publish(v.select("rule_id", "status", "rejection_reason", "cluster"))


CAT = ru.catalogue()


@query(with_bars(*scan_ctes(CAT, forward=False, member=False), "x AS (SELECT symbol, bar_ix, unnest(matched) AS rule FROM hits)", recursive=True,
    select=f"SELECT a.rule::BIGINT AS i, b.rule::BIGINT AS j, count(*) AS n FROM x a JOIN x b ON a.symbol = b.symbol AND a.bar_ix = b.bar_ix AND a.rule <= b.rule GROUP BY 1, 2"))
def rule_cooccurrence(spark, sf):
    hits = rs.matched_bars(c.bars(spark, sf), CAT, STUDY, ahead=False)
    return c.publish(ev.cooccurrence(hits, len(CAT)))


# ---- context profiles and entry/exit pairs -----------------------------------
_CTX = [x for x in ru.context_base_rules() if x.id != "ctx_rsi_oversold"]
_ctx_ctes, _ = sr.prepared(_CTX)


def _profile_sql(filters):
    parts = []
    for f in filters:
        if f[0] == "market_regime":
            op = ">" if f[1] == "above_sma" else "<"
            parts.append(f"coalesce(bn = {f[2]} AND bcs {op} bma, FALSE)")
        elif f[0] == "relative_strength":
            op = "<=" if f[2] == "lte" else ">="
            parts.append(f"coalesce(CASE WHEN rn_{f[1]} = {f[1] + 1} THEN rs_{f[1]} END {op} {f[3]}, FALSE)")
        elif f[0] == "realized_volatility":
            op = "<=" if f[2] == "lte" else ">="
            parts.append(f"coalesce(CASE WHEN bar_ix >= {f[1]} THEN vol_{f[1]} END {op} {f[3]}, FALSE)")
        else:
            parts.append(f"coalesce(CASE WHEN bar_ix >= {f[1] - 1} THEN vr_{f[1]} END >= {f[2]}, FALSE)")
    return " AND ".join(parts)


_ctx_cols = ", ".join(
    f"{c.settled(f'close / lag(close, {n}) OVER {sr.PLAIN} - 1 - (bc / lag(bc, {n}) OVER {sr.PLAIN} - 1)')} AS rs_{n}, count(bc) OVER {sr.over(n + 1)} AS rn_{n}, "
    f"{c.settled(f'stddev_samp(ret) OVER {sr.over(n)}')} AS vol_{n}, {c.settled(f'volume / avg(volume) OVER {sr.over(n)}')} AS vr_{n}"
    for n in (10, 20)
)


@query(with_bars(*_ctx_ctes, c.BENCH_SQL, f"cj AS (SELECT p.*, b.close AS bc, p.close / lag(p.close) OVER (PARTITION BY p.symbol ORDER BY p.session) - 1 AS ret FROM prep p LEFT JOIN bench b USING (session))",
    f"cx AS (SELECT *, {_ctx_cols}, {c.settled('bc')} AS bcs, {c.settled(f'avg(bc) OVER {sr.over(60)}')} AS bma, count(bc) OVER {sr.over(60)} AS bn FROM cj)",
    select=" UNION ALL ".join(f"SELECT '{x.id}' AS rule_id, '{name}' AS profile, count(*) FILTER (WHERE {sr.matches(x)} AND {_profile_sql(f)}) AS signals FROM cx" for x in _CTX for name, f in ru.CONTEXT_PROFILES.items())))
def context_profiles(spark, sf):
    df = sg.context_flags(c.bars(spark, sf), c.benchmark(spark, sf))
    profiles = list(ru.CONTEXT_PROFILES)
    df = sg.prepare(df, _CTX)
    sums = [F.count_if(sg.matches(x) & F.col(p)).alias(f"{x.id}|{p}") for x in _CTX for p in profiles]
    total = df.agg(*sums)
    rows = F.array(*[F.struct(F.lit(x.id).alias("rule_id"), F.lit(p).alias("profile"), F.col(f"`{x.id}|{p}`").alias("signals")) for x in _CTX for p in profiles])
    return total.select(F.explode(rows).alias("x")).select("x.*")


_pair_roll = {}
for _name, _fam, _p in ru.ENTRY_EXIT:
    if _fam == "sma_cross":
        for _n in _p:
            _pair_roll[f"sma_{_n}"] = sr.rolling("sma", _n)
    if _fam == "boll_reversion":
        _pair_roll[f"sma_{_p[0]}"] = sr.rolling("sma", _p[0])
        _pair_roll[f"bs_{_p[0]}"] = f"CASE WHEN bar_ix >= {_p[0] - 1} THEN {c.settled(f'stddev_samp(close) OVER {sr.over(_p[0])}')} END"
    if _fam == "rsi":
        _n = _p[0]
        _g, _l = f"avg(gain) OVER {sr.over(_n)}", f"avg(loss) OVER {sr.over(_n)}"
        _pair_roll[f"sr_{_n}"] = f"CASE WHEN bar_ix >= {_n} THEN {c.settled(f'CASE WHEN {_l} > 0 THEN 100.0 - 100.0 / (1.0 + {_g} / {_l}) WHEN {_g} > 0 THEN 100.0 ELSE 50.0 END')} END"
    if _fam == "momentum":
        _pair_roll[f"roc_{_p[0]}"] = sr.rolling("roc", _p[0])
    if _fam == "breakout":
        for _f in ("max", "min"):
            _pair_roll[f"{_f}c_{_p[0]}"] = f"CASE WHEN bar_ix >= {_p[0]} THEN {_f}(close) OVER {sr.over(_p[0], _p[0], 1)} END"
    if _fam == "volume_price":
        _pair_roll[f"mv_{_p[0]}"] = f"CASE WHEN bar_ix >= {_p[0] - 1} THEN {c.settled(f'avg(volume) OVER {sr.over(_p[0])}')} END"
        _pair_roll["roc_1"] = sr.rolling("roc", 1)
_spans = sorted({n for _, f, p in ru.ENTRY_EXIT if f == "ema_cross" for n in p})
_ema_cut = ", ".join(f"CASE WHEN bar_ix >= {n - 1} THEN ema_{n} END AS em_{n}" for n in _spans)
_lagged = [x for n, f, p in ru.ENTRY_EXIT if f in ("sma_cross", "ema_cross") for x in (f"{'sma' if f[0] == 's' else 'em'}_{p[0]}", f"{'sma' if f[0] == 's' else 'em'}_{p[1]}")]
_lag_sql = ", ".join(f"lag({x}) OVER {sr.PLAIN} AS p_{x}" for x in sorted(set(_lagged)))


def _pair_sql(family, p):
    if family in ("sma_cross", "ema_cross"):
        k = "sma" if family[0] == "s" else "em"
        a, b = f"{k}_{p[0]}", f"{k}_{p[1]}"
        return f"{a} > {b} AND p_{a} <= p_{b}", f"{a} < {b} AND p_{a} >= p_{b}"
    if family == "rsi":
        return f"sr_{p[0]} < {p[1]}", f"sr_{p[0]} > {p[2]}"
    if family == "momentum":
        return f"roc_{p[0]} > 0", f"roc_{p[0]} < 0"
    if family == "breakout":
        return f"close > maxc_{p[0]}", f"close < minc_{p[0]}"
    if family == "boll_reversion":
        low = c.settled(f"sma_{p[0]} - bs_{p[0]} * {p[1]}")
        return f"close < {low}", f"close > sma_{p[0]}"
    return f"roc_1 > 0 AND volume > mv_{p[0]} * {p[1]}", f"(roc_1 < 0 OR volume < mv_{p[0]})"


_walk = sr.recursion(set(_spans), set(), False)
PAIR_CTES = [
    f"chg AS (SELECT *, close - lag(close) OVER {sr.PLAIN} AS ch FROM bars)",
    "gl AS (SELECT *, CASE WHEN ch IS NOT NULL THEN greatest(ch, 0.0) END AS gain, CASE WHEN ch IS NOT NULL THEN greatest(-ch, 0.0) END AS loss FROM chg)",
    *_walk,
    f"pr AS (SELECT gl.*, {', '.join(f'{e} AS {n}' for n, e in sorted(_pair_roll.items()))}, {_ema_cut} FROM gl JOIN ewm USING (symbol, bar_ix))",
    f"pl AS (SELECT *, {_lag_sql} FROM pr)",
]


@query(with_bars(*PAIR_CTES, recursive=True, select=" UNION ALL ".join(
    f"SELECT '{n}' AS pair, count(*) FILTER (WHERE {_pair_sql(f, p)[0]}) AS entries, count(*) FILTER (WHERE {_pair_sql(f, p)[1]}) AS exits, count(*) FILTER (WHERE ({_pair_sql(f, p)[0]}) AND ({_pair_sql(f, p)[1]})) AS both_sides FROM pl" for n, f, p in ru.ENTRY_EXIT)))
def entry_exit_pairs(spark, sf):
    df = sg.entry_exit(c.bars(spark, sf))
    sums = []
    for n, _, _ in ru.ENTRY_EXIT:
        a, b = F.col(f"{n}_entry"), F.col(f"{n}_exit")
        sums.append(F.struct(F.lit(n).alias("pair"), F.count_if(a).alias("entries"), F.count_if(b).alias("exits"), F.count_if(a & b).alias("both_sides")).alias(n))
    return df.agg(*sums).select(F.explode(F.array(*[F.col(n) for n, _, _ in ru.ENTRY_EXIT])).alias("x")).select("x.*")


_ELIG = "(volume > 0 AND NOT is_st AND NOT (open = high AND open = low AND open = close))"


@query(with_bars(f"pl AS (SELECT symbol, session, bar_ix, {_ELIG} AS eligible, lag(close < open, 1, FALSE) OVER {sr.PLAIN} AS planned FROM bars)",
    f"ru AS (SELECT *, coalesce(sum(eligible::INT) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM pl)",
    select="SELECT symbol, bar_ix FROM (SELECT *, eligible AND bool_or(planned) OVER (PARTITION BY symbol, run) AS fires FROM ru) WHERE fires"))
def delay_to_eligible(spark, sf):
    b = oc.observed_gates(c.bars(spark, sf))
    planned = F.lag(F.col("close") < F.col("open"), 1, False).over(series.by_symbol())
    return sg.delay_to_eligible(b.withColumns({"eligible": ~F.col("blocked"), "planned": planned})).where("fires").select("symbol", "bar_ix")


# ---- event sets ---------------------------------------------------------------
_events_sql = "evs AS (SELECT symbol, bar_ix, session, {names}[rule + 1] AS rule_id FROM (SELECT symbol, bar_ix, session, unnest(matched) AS rule FROM hits))".format(names="[" + ", ".join(f"'{x.id}'" for x in CAT) + "]")


def cat_events(spark, sf):
    hits = rs.matched_bars(c.bars(spark, sf), CAT, STUDY, ahead=False)
    names = F.array(*[F.lit(x.id) for x in CAT])
    return sg.each_match(hits.select("symbol", "session", "bar_ix", "matched")).select("symbol", "session", "bar_ix", F.element_at(names, F.col("rule") + 1).alias("rule_id"))


_cat = scan_ctes(CAT, forward=False, member=False)


@query(with_bars(*_cat, _events_sql, "cool AS (SELECT rule_id, symbol, min(bar_ix) AS bar_ix FROM evs GROUP BY 1, 2 UNION ALL SELECT k.rule_id, k.symbol, (SELECT min(e.bar_ix) FROM evs e WHERE e.rule_id = k.rule_id AND e.symbol = k.symbol AND e.bar_ix >= k.bar_ix + 20) FROM cool k WHERE k.bar_ix IS NOT NULL)",
    recursive=True, select="SELECT rule_id, symbol, bar_ix FROM cool WHERE bar_ix IS NOT NULL"))
def cooldown(spark, sf):
    return ev.cooldown(cat_events(spark, sf), 20)


@query(with_bars(*_cat, _events_sql, "cn AS (SELECT rule_id, count(*) AS n FROM evs GROUP BY 1)",
    f"nr AS (SELECT a.rule_id AS l, b.rule_id AS r, count(DISTINCT (a.symbol, a.bar_ix)) AS n FROM evs a JOIN evs b ON a.symbol = b.symbol AND abs(a.bar_ix - b.bar_ix) <= 5 GROUP BY 1, 2)",
    "sh AS (SELECT a.rule_id AS l, b.rule_id AS r, count(*) AS n FROM evs a JOIN evs b ON a.symbol = b.symbol AND a.bar_ix = b.bar_ix GROUP BY 1, 2)",
    "pp AS (SELECT a.i AS i, b.i AS j, a.x AS l, b.x AS r FROM (VALUES {v}) a(i, x), (VALUES {v}) b(i, x) WHERE a.i < b.i)".format(v=", ".join(f"({i}, '{x.id}')" for i, x in enumerate(CAT))),
    "q AS (SELECT pp.l, pp.r, coalesce(a.n, 0) AS ln, coalesce(b.n, 0) AS rn, coalesce(sh.n, 0) AS s, coalesce(n1.n, 0) AS nl, coalesce(n2.n, 0) AS nrr FROM pp LEFT JOIN cn a ON a.rule_id = pp.l LEFT JOIN cn b ON b.rule_id = pp.r LEFT JOIN sh ON sh.l = pp.l AND sh.r = pp.r LEFT JOIN nr n1 ON n1.l = pp.l AND n1.r = pp.r LEFT JOIN nr n2 ON n2.l = pp.r AND n2.r = pp.l)",
    recursive=True, select=f"""SELECT l AS left_rule, r AS right_rule, ln AS left_events, rn AS right_events, s AS shared, {r('CASE WHEN ln + rn - s > 0 THEN s / (ln + rn - s) ELSE 1.0 END', 'jaccard')},
      {r('CASE WHEN ln > 0 THEN s / ln ELSE 0.0 END', 'left_contained')}, {r('CASE WHEN rn > 0 THEN s / rn ELSE 0.0 END', 'right_contained')}, {r('CASE WHEN ln > 0 THEN (ln - s) / ln ELSE 0.0 END', 'left_unique')}, {r('CASE WHEN rn > 0 THEN (rn - s) / rn ELSE 0.0 END', 'right_unique')},
      {r('CASE WHEN ln > 0 THEN nl / ln ELSE 0.0 END', 'left_near')}, {r('CASE WHEN rn > 0 THEN nrr / rn ELSE 0.0 END', 'right_near')} FROM q"""))
def event_overlap(spark, sf):
    return c.publish(ev.overlap(cat_events(spark, sf), [x.id for x in CAT], 5))


@query(with_bars(*_cat, _events_sql, recursive=True, select="""SELECT symbol, bar_ix FROM evs a WHERE rule_id = 'breakout_60d' AND EXISTS (SELECT 1 FROM evs b WHERE b.rule_id = 'momentum_breakout' AND a.symbol = b.symbol AND abs(a.bar_ix - b.bar_ix) <= 5)"""))
def near_events(spark, sf):
    e = cat_events(spark, sf)
    return ev.near(e.where("rule_id = 'breakout_60d'"), e.where("rule_id = 'momentum_breakout'"), 5).select("symbol", "bar_ix")


@query(with_bars(select=f"SELECT {S}, row_number() OVER (ORDER BY session) - 1 AS session_ix FROM (SELECT DISTINCT session FROM rawbars)"))
def observed_calendar(spark, sf):
    return c.publish(series.calendar_of(c.raw_bars(spark, sf)))


_row_hash = "'sha256:' || sha256(concat_ws('|', 'close=' || CAST(CAST(close AS DECIMAL(28,8)) AS VARCHAR), 'session=' || CAST(session AS VARCHAR), 'symbol=' || symbol))"


@query(with_bars(select=f"SELECT symbol, {S}, row_hash FROM (SELECT symbol, session, {_row_hash} AS row_hash FROM rawbars) ORDER BY row_hash LIMIT 25"))
def audit_sample(spark, sf):
    b = c.raw_bars(spark, sf)
    return c.publish(ev.audit_sample(b, row_identity(b, ["symbol", "session", "close"]), 25).select("symbol", "session", "row_hash"))


@query(with_bars(select="SELECT symbol, min(session)::VARCHAR AS min_session, max(session)::VARCHAR AS max_session, count(*) AS bars, CASE WHEN symbol IN ('600000', '600001') THEN 'already_selected' WHEN min(session) > DATE '1995-01-03' THEN 'starts_late' WHEN max(session) < DATE '2001-11-01' THEN 'ends_early' END AS reason FROM rawbars GROUP BY symbol"))
def symbol_selection(spark, sf):
    b = c.raw_bars(spark, sf)
    taken = b.select("symbol").distinct().where(F.col("symbol").isin("600000", "600001"))
    return c.publish(ev.next_symbols(b, F.lit(dt.date(1995, 1, 3)), F.lit(dt.date(2001, 11, 1)), taken, 5)[1])


@query(with_bars(*_cat, _events_sql, recursive=True, select="SELECT DISTINCT symbol, bar_ix FROM evs WHERE rule_id = 'donchian_main' INTERSECT SELECT DISTINCT symbol, bar_ix FROM evs WHERE rule_id = 'momentum_breakout'"))
def event_intersection(spark, sf):
    e = cat_events(spark, sf)
    pick = lambda x: e.where(F.col("rule_id") == x).select("symbol", "bar_ix")
    return pick("donchian_main").intersect(pick("momentum_breakout"))


@query(with_bars(*_cat, _events_sql, recursive=True, select="SELECT symbol, bar_ix FROM evs WHERE rule_id = 'donchian_main' UNION SELECT symbol, bar_ix FROM evs WHERE rule_id = 'momentum_breakout'"))
def event_union(spark, sf):
    e = cat_events(spark, sf)
    pick = lambda x: e.where(F.col("rule_id") == x).select("symbol", "bar_ix")
    return pick("donchian_main").union(pick("momentum_breakout")).distinct()


# ---- plans and same-day choice ------------------------------------------------
_plan_ctes = [GATES, *sr.prepared([BREAKDOWN], source="gates")[0]]
_plan_w = "(PARTITION BY symbol ORDER BY session)"
_plan = "pln AS (" + " UNION ALL ".join(
    f"SELECT 'breakdown' AS rule_id, symbol, session, {h} AS horizon, lead(session) OVER {_plan_w} AS entry_at, lead(open) OVER {_plan_w} AS entry_open, lead(NOT lim_up) OVER {_plan_w} AS entry_tradeable, lead(session, {h}) OVER {_plan_w} AS sx, lead(session, {h + 5}) OVER {_plan_w} AS deadline, {sr.matches(BREAKDOWN)} AS hit FROM prep" for h in (5, 10, 20)
) + "), plans AS (SELECT *, sha256(concat_ws('|', '7', rule_id, symbol, session::VARCHAR)) AS selection_rank FROM pln WHERE hit)"


def _plans(spark, sf):
    b = oc.gate_flags(c.bars(spark, sf)).withColumn("tradeable_open", F.col("buy_flags") == 0)
    events = sg.signal(c.bars(spark, sf), BREAKDOWN.condition).select(F.lit("breakdown").alias("rule_id"), "symbol", "session")
    return oc.trade_plans(events, b, (5, 10, 20), 5, 7)


@query(with_bars(*_plan_ctes, _plan, select=f"""SELECT rule_id, symbol, session::VARCHAR AS signal_at, horizon::BIGINT AS horizon, entry_at::VARCHAR AS entry_at, {r('entry_open', 'entry_open')}, entry_tradeable,
  CASE WHEN deadline IS NOT NULL THEN sx END::VARCHAR AS scheduled_exit, deadline::VARCHAR AS deadline, selection_rank, deadline IS NULL AS tail_purged FROM plans"""))
def trade_plans(spark, sf):
    return c.publish(_plans(spark, sf))


@query(with_bars(*_plan_ctes, _plan, "ok AS (SELECT *, CASE WHEN entry_tradeable THEN row_number() OVER (PARTITION BY rule_id, horizon, entry_at, entry_tradeable ORDER BY selection_rank, symbol) END AS n FROM plans WHERE deadline IS NOT NULL)",
    select="SELECT rule_id, symbol, session::VARCHAR AS signal_at, horizon::BIGINT AS horizon, CASE WHEN NOT entry_tradeable THEN 'entry_untradeable' WHEN n > 1 THEN 'max_positions' ELSE 'selected' END AS decision FROM ok"))
def same_day_selection(spark, sf):
    chosen = ev.same_day_selection(_plans(spark, sf).where("not tail_purged"), 1)
    return c.publish(chosen.select("rule_id", "symbol", "signal_at", "horizon", "decision"))


# ---- dated tests ---------------------------------------------------------------
COMPARE = [x for x in CAT if x.id in ("hammer", "breakout_60d", "donchian_main")] + [BREAKDOWN]
_cmp = scan_ctes(COMPARE, member=False)
_cmp[-2:] = [_cmp[-2].replace(f" AND n_bars > {max(sg.lookback(x) for x in COMPARE) + max(H) + 1}", ""), _cmp[-1]]
_cmp_names = "[" + ", ".join(f"'{x.id}'" for x in COMPARE) + "]"
_daily = f"""oo AS (SELECT {_cmp_names}[rule + 1] AS rule_id, horizon, regime, symbol, session, bar_ix, net_excess_return FROM (SELECT *, unnest(matched) AS rule FROM outc) WHERE sample_split = 'out_of_sample' AND net_excess_return IS NOT NULL),
 day AS (SELECT rule_id, horizon, regime, session, avg(net_excess_return) AS effect, count(*) AS events FROM oo GROUP BY 1, 2, 3, 4)"""


def _oos(spark, sf):
    rows = rc.rule_outcomes(c.bars(spark, sf), COMPARE, c.benchmark(spark, sf), STUDY)
    return rows.where((F.col("sample_split") == "out_of_sample") & F.col("net_excess_return").isNotNull())


@query(with_bars(*_cmp, _daily, select=f"SELECT rule_id, horizon::BIGINT AS horizon, regime, {S}, {r('effect', 'effect')}, events FROM day"))
def daily_effects(spark, sf):
    return c.publish(stats.daily_effects(_oos(spark, sf)))


def hac_sql(source: str, keys: str = "rule_id, horizon, regime", lag: str = "horizon") -> list[str]:
    terms = " + ".join(
        f"CASE WHEN {lag} >= {k} THEN 2.0 * (1.0 - {k}.0 / ({lag} + 1)) * cen * coalesce(lag(cen, {k}) OVER o, 0.0) ELSE 0.0 END" for k in range(1, 21)
    )
    p = c.p_value_sql("(effect / se)")
    return [
        f"cen AS (SELECT *, effect - avg(effect) OVER (PARTITION BY {keys}) AS cen FROM {source})",
        f"wt AS (SELECT *, cen * cen + {terms} AS w FROM cen WINDOW o AS (PARTITION BY {keys} ORDER BY session))",
        f"hg AS (SELECT {keys}, count(*) AS n_dates, avg(effect) AS effect, sqrt(greatest(0.0, sum(w) / count(*)) / count(*)) AS se0, max({lag}) AS lg FROM wt GROUP BY {keys})",
        "hs AS (SELECT *, CASE WHEN se0 > abs(effect) * 1e-14 THEN se0 ELSE 0.0 END AS se FROM hg)",
        f"hac AS (SELECT *, CASE WHEN n_dates <= lg THEN 'insufficient_dates' ELSE 'descriptive_hac' END AS evidence_status, CASE WHEN se > 0 THEN {p.replace('(effect / se)', '(effect / nullif(se, 0))')} WHEN effect <> 0 THEN 0.0 ELSE 1.0 END AS p FROM hs)",
    ]


@query(with_bars(*_cmp, _daily, *hac_sql("day"), select=f"""SELECT rule_id, horizon::BIGINT AS horizon, regime, n_dates, {r('effect', 'effect')}, {r('se', 'standard_error')}, {r(f'effect - {c.Z95} * se', 'ci_lower')},
  {r(f'effect + {c.Z95} * se', 'ci_upper')}, evidence_status, {r('p', 'raw_p_value', 6)} FROM hac"""))
def hac_tests(spark, sf):
    h = stats.hac(stats.daily_effects(_oos(spark, sf)))
    h = h.withColumn("raw_p_value", F.rint(F.col("raw_p_value") * 1e6) / 1e6)
    return c.publish(h.select("rule_id", "horizon", "regime", "n_dates", "effect", "standard_error", "ci_lower", "ci_upper", "evidence_status", "raw_p_value"))


@query(with_bars(*_cmp, _daily, *hac_sql("day"), "rk AS (SELECT *, row_number() OVER (ORDER BY p) AS rn, count(*) OVER () AS mm FROM hac)",
    select=f"SELECT rule_id, horizon::BIGINT AS horizon, regime, {r('least(1.0, min(p * mm / rn) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 'adjusted_p_value', 6)} FROM rk"))
def false_discovery(spark, sf):
    h = stats.false_discovery(stats.hac(stats.daily_effects(_oos(spark, sf))))
    return c.publish(h.select("rule_id", "horizon", "regime", "adjusted_p_value"), 6)


@query(with_bars(*_cmp, _daily, "st AS (SELECT rule_id, horizon, regime, session, k, effect - (k - 1.0) * 0.0016 AS effect FROM day, (VALUES (2.0::DOUBLE), (3.0)) v(k))", *hac_sql("st", "rule_id, horizon, regime, k"),
    select=f"SELECT rule_id, horizon::BIGINT AS horizon, regime, k AS multiple, n_dates, {r('effect', 'effect')}, {r(f'effect - {c.Z95} * se', 'ci_lower')} FROM hac"))
def stressed_hac_tests(spark, sf):
    h = rc.stressed_tests(stats.daily_effects(_oos(spark, sf)), STUDY)
    return c.publish(h.select("rule_id", "horizon", "regime", "multiple", "n_dates", "effect", "ci_lower"))


@query(with_bars(*_cmp, _daily, select=f"SELECT rule_id, horizon::BIGINT AS horizon, regime, year(session) AS year, {r('avg(effect)', 'year_effect')} FROM day GROUP BY 1, 2, 3, 4"))
def yearly_effects(spark, sf):
    return c.publish(stats.yearly(stats.daily_effects(_oos(spark, sf))))


@query(with_bars(*_cmp, _daily, "yy AS (SELECT rule_id, horizon, regime, year(session) AS y, avg(effect) AS e FROM day GROUP BY 1, 2, 3, 4)",
    select=f"SELECT rule_id, horizon::BIGINT AS horizon, regime, {r('avg(CASE WHEN e > 0 THEN 1.0 ELSE 0.0 END)', 'positive_year_fraction')}, count(*) AS years FROM yy GROUP BY 1, 2, 3"))
def positive_years(spark, sf):
    return c.publish(stats.positive_year_share(stats.daily_effects(_oos(spark, sf))))


_groups = [*_cmp, _daily, f"grp AS (SELECT rule_id, horizon::BIGINT AS horizon, regime, count(*) AS n, avg(net_excess_return) AS m, CASE WHEN count(*) >= 2 THEN stddev_samp(net_excess_return) END AS sd FROM oo GROUP BY 1, 2, 3)"]
_mult2 = _mult.replace("SELECT rule, horizon, regime, any_value", "SELECT rule_id, horizon, regime, any_value").replace("per AS (", "per AS (")
_LOWEST = replace(STUDY, min_observations=2, min_horizons=1)
_mult3 = _mult2.replace("n >= 30 AND mk > 0 AND mk - 1.959963984540054 * se > 0 AND adj <= 0.05", "n >= 2 AND mk > 0 AND mk - 1.959963984540054 * se > 0 AND adj <= 0.05")


def _judged(spark, sf):
    g = stats.summarize(_oos(spark, sf), ["rule_id", "horizon", "regime"])
    return stats.screen_verdict(g, _LOWEST)[0]


@query(with_bars(*_groups, select=f"SELECT rule_id, max_by(horizon, (m, horizon, regime)) AS horizon, max_by(regime, (m, horizon, regime)) AS regime, {r('max(m)', 'mean_return')} FROM grp GROUP BY rule_id"))
def best_groups(spark, sf):
    return c.publish(stats.best_groups(stats.summarize(_oos(spark, sf), ["rule_id", "horizon", "regime"])))


_ev = f"""SELECT rule_id, horizon, regime, CASE WHEN neg THEN 'significantly_negative' WHEN len(why) = 0 THEN 'candidate' ELSE 'rejected' END AS evidence, CASE WHEN neg THEN '' ELSE array_to_string(why, ',') END AS reasons FROM
 (SELECT *, coalesce(n >= 100 AND mk < 0 AND mk + {c.Z95} * se < 0 AND adj <= 0.05, FALSE) AS neg, list_filter([CASE WHEN n < 100 THEN 'insufficient_sample' END, CASE WHEN mk <= 0 THEN 'non_positive_mean' END,
  CASE WHEN coalesce(mk - {c.Z95} * se <= 0, TRUE) THEN 'confidence_interval_not_above_zero' END, CASE WHEN NOT coalesce(adj <= 0.05, FALSE) THEN 'multiple_testing_not_significant' END], lambda x: x IS NOT NULL) AS why FROM bh WHERE k = 1)"""


@query(with_bars(*_groups, _mult3, select=_ev))
def evidence_table(spark, sf):
    return c.publish(stats.evidence_table(_judged(spark, sf), 100).select("rule_id", "horizon", "regime", "evidence", "reasons"))


@query(with_bars(*_groups, _mult3, f"ws AS (SELECT rule_id, horizon, regime, min(mk - {c.Z95} * se) AS w FROM ok WHERE k > 1 GROUP BY 1, 2, 3)",
    select=f"SELECT rule_id, regime, count(DISTINCT horizon) AS passing_horizons, max_by(horizon, (m, horizon)) AS best_horizon, {r('max(m)', 'best_mean')}, sum(n)::BIGINT AS sample_size, {r('min(w)', 'worst_stress_lower')} FROM per JOIN ws USING (rule_id, horizon, regime) WHERE passes GROUP BY 1, 2"))
def state_evidence(spark, sf):
    return c.publish(stats.state_evidence(_judged(spark, sf), _LOWEST))


@query(with_bars(*_groups, f"cur AS (SELECT rule_id, regime, count(*) AS n, avg(net_excess_return) AS m, stddev_samp(net_excess_return) / sqrt(count(*)) AS se FROM oo WHERE horizon = 5 AND session >= DATE '2001-01-01' GROUP BY 1, 2)",
    "base AS (SELECT rule_id, regime, avg(net_excess_return) AS m FROM oo WHERE horizon = 5 AND session < DATE '2001-01-01' GROUP BY 1, 2)",
    f"tst AS (SELECT *, m / nullif(se, 0) AS t FROM cur), pv AS (SELECT *, {c.p_value_sql('t')} AS p FROM tst), " + "rk AS (SELECT *, row_number() OVER (PARTITION BY p IS NULL ORDER BY p) AS rn, count(*) OVER (PARTITION BY p IS NULL) AS mm FROM pv), bh AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(p * mm / rn) OVER (PARTITION BY p IS NULL ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS adj FROM rk)",
    select=f"""SELECT base.rule_id, base.regime, CASE WHEN base.regime = 'unknown' THEN 'expired' WHEN bh.n IS NULL THEN 'not_revalidated' WHEN bh.n < 30 THEN 'insufficient_sample'
      WHEN bh.m < 0 OR base.m - bh.m > 0.01 OR coalesce(bh.m - {c.Z95} * bh.se <= 0, TRUE) OR NOT coalesce(adj <= 0.05, FALSE) THEN 'drifted' ELSE 'revalidated' END AS verdict FROM base LEFT JOIN bh USING (rule_id, regime)"""))
def drift_check(spark, sf):
    rows = _oos(spark, sf).where("horizon = 5")
    cut = F.lit(dt.date(2001, 1, 1))
    base = rows.where(F.col("session") < cut).groupBy("rule_id", "regime").agg(F.avg("net_excess_return").alias("mean_return"))
    base = base.withColumn("valid_until", F.when(F.col("regime") == "unknown", F.lit(dt.date(2001, 6, 1))).otherwise(F.lit(dt.date(2003, 1, 1))))
    now = stats.false_discovery(stats.summarize(rows.where(F.col("session") >= cut), ["rule_id", "regime"]), skip_null=True)
    now = now.withColumn("validation_end", F.lit(dt.date(2001, 11, 1)))
    return stats.drift_check(base, now, dt.date(2002, 1, 1), min_observations=30).select("rule_id", "regime", "verdict")


@query()
def rule_ranking(spark, sf):
    """Cooldown, overlap, HAC, FDR, stress and years combined: rows only."""
    return c.publish(rc.ranking(c.bars(spark, sf), COMPARE, c.benchmark(spark, sf), STUDY))


@query(with_bars(*study_ctes(), "yr AS (SELECT *, year(session) AS y FROM outc)", "grp AS (SELECT horizon::BIGINT AS horizon, regime, count(*) AS n, avg(net_excess_return) AS m FROM yr WHERE sample_split = 'out_of_sample' AND net_excess_return IS NOT NULL GROUP BY 1, 2)",
    select=f"SELECT horizon, regime, n AS sample_size, {r('m', 'mean_return')}, (SELECT count(DISTINCT y) FROM yr) AS runs, (SELECT count(DISTINCT y % 2) FROM yr) AS snapshots FROM grp"))
def summary_across_runs(spark, sf):
    rows = study_rows(spark, sf).withColumn("run_id", F.year("session").cast("string"))
    runs = rows.select("run_id", "rule_id").distinct().withColumns({"snapshot_id": (F.col("run_id").cast("int") % 2).cast("string"), "qa_status": F.lit("passed")})
    return c.publish(stats.run_summary(rows, runs).select("horizon", "regime", "sample_size", "mean_return", "runs", "snapshots"))

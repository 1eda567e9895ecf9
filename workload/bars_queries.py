"""Bars, scalar metrics, indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import identity, metrics, numeric
from tidemark.operators import indicators as ind
from tidemark.operators import series
from workload import common as c
from workload import sql_rules as sr
from workload.common import query, r, with_bars

_BAR = "symbol, CAST(session AS VARCHAR) AS session, " + ", ".join(r(x, x) for x in ("open", "high", "low", "close", "volume", "amount"))


@query(with_bars(select=f"SELECT {_BAR} FROM rawbars"))
def build_bars(spark, sf):
    return c.publish(series.build_bars(c.ticks(spark, sf)))


@query(with_bars(select=f"SELECT symbol, CAST(session AS VARCHAR) AS session, bar_ix, n_bars, {r('prev_close', 'prev_close')} FROM bars"))
def number_bars(spark, sf):
    return c.publish(c.bars(spark, sf).select("symbol", "session", "bar_ix", "n_bars", "prev_close"))


@query(with_bars(select=f"""SELECT symbol, CAST(session AS VARCHAR) AS session, {r('abs(close - open)', 'body')}, {r('high - low', 'range')},
  {r('high - greatest(open, close)', 'upper_shadow')}, {r('least(open, close) - low', 'lower_shadow')}, close > open AS is_bullish, close < open AS is_bearish FROM rawbars"""))
def bar_metrics(spark, sf):
    return c.publish(c.raw_bars(spark, sf).select("symbol", "session", *[x.alias(n) for n, x in metrics.shape_columns().items()]))


@query(with_bars(select=f"""SELECT symbol, CAST(session AS VARCHAR) AS session,
  {r('CASE WHEN prev_close - open = 0 THEN 0.0 ELSE (close - open) / (prev_close - open) END', 'safe')},
  {r('CASE WHEN high - low <> 0 THEN (close - open) / (high - low) END', 'plain')},
  {r('CASE WHEN greatest(high - low, 0.01) = 0 THEN 0.0 ELSE abs(close - open) / greatest(high - low, 0.01) END', 'shape')},
  {r('open + high + low + close', 'total')}, {r('open * close', 'product')}, {r('least(open, close)', 'lowest')}, {r('greatest(open, close)', 'highest')},
  {r('abs(open - close)', 'distance')} FROM bars WHERE prev_close IS NOT NULL"""))
def arithmetic_nodes(spark, sf):
    o, h, l, cl = (F.col(x) for x in ("open", "high", "low", "close"))
    b = c.bars(spark, sf).where("prev_close is not null")
    return c.publish(
        b.select(
            "symbol", "session",
            numeric.safe_div(cl - o, F.col("prev_close") - o).alias("safe"),
            F.try_divide(cl - o, h - l).alias("plain"),
            numeric.shape_ratio(F.abs(cl - o), h - l).alias("shape"),
            numeric.add(o, h, l, cl).alias("total"),
            numeric.mul(o, cl).alias("product"),
            F.least(o, cl).alias("lowest"),
            F.greatest(o, cl).alias("highest"),
            F.abs(o - cl).alias("distance"),
        )
    )


@query(with_bars(select="""SELECT symbol, CAST(session AS VARCHAR) AS session,
  CASE WHEN is_st THEN 0.05 WHEN symbol LIKE '688%' THEN 0.2 WHEN (symbol LIKE '300%' OR symbol LIKE '301%') AND session >= DATE '2020-08-24' THEN 0.2 ELSE 0.1 END::DOUBLE AS limit_pct FROM rawbars"""))
def limit_pct(spark, sf):
    b = c.raw_bars(spark, sf)
    return c.publish(b.select("symbol", "session", metrics.limit_pct(F.col("symbol"), F.col("session"), F.col("is_st")).alias("limit_pct")))


@query(with_bars(select="""SELECT symbol, CAST(session AS VARCHAR) AS session, 'sha256:' || sha256(concat_ws('|', 'close=' || CAST(CAST(close AS DECIMAL(28,8)) AS VARCHAR),
  'open=' || CAST(CAST(open AS DECIMAL(28,8)) AS VARCHAR), 'session=' || CAST(session AS VARCHAR), 'symbol=' || symbol, 'volume=' || CAST(CAST(volume AS DECIMAL(28,8)) AS VARCHAR))) AS row_hash FROM rawbars"""))
def row_identity(spark, sf):
    b = c.raw_bars(spark, sf)
    return c.publish(b.select("symbol", "session", identity.row_identity(b, ["symbol", "session", "open", "close", "volume"]).alias("row_hash")))


@query(with_bars(select="""SELECT symbol, CAST(session AS VARCHAR) AS session, 'obs_' || left(sha256(concat_ws('|', symbol, CAST(session AS VARCHAR), 'rule@1', 'snap')), 24) AS observation_id FROM rawbars"""))
def observation_id(spark, sf):
    b = c.raw_bars(spark, sf)
    oid = identity.short_id("obs_", F.col("symbol"), F.col("session"), F.lit("rule@1"), F.lit("snap"))
    return c.publish(b.select("symbol", "session", oid.alias("observation_id")))


@query(with_bars(select=f"""SELECT symbol, CAST(session AS VARCHAR) AS session, m AS multiple, {r('(close / prev_close - 1 - 0.0016 * 1.0) - (m - 1.0) * 0.0016', 'net')}
  FROM bars, (VALUES (1.0::DOUBLE), (2.0), (3.0)) v(m) WHERE prev_close IS NOT NULL"""))
def cost_stress(spark, sf):
    b = c.bars(spark, sf).where("prev_close is not null")
    base = metrics.net_of(F.col("close") / F.col("prev_close") - 1, 0.0016)
    rows = b.select("symbol", "session", F.explode(metrics.cost_stress(base, 0.0016, [1.0, 2.0, 3.0])).alias("s"))
    return c.publish(rows.select("symbol", "session", "s.multiple", F.col("s.stressed").alias("net")))


@query(with_bars(select="""SELECT symbol, exchange, CASE WHEN left(symbol, 3) NOT IN ('600','601','603','605','000','001','002','003') THEN 'not_main_board'
  WHEN NOT ((exchange = 'SSE' AND left(symbol, 3) IN ('600','601','603','605')) OR (exchange = 'SZSE' AND left(symbol, 3) IN ('000','001','002','003'))) THEN 'exchange_prefix_mismatch' END AS issue, count(*) AS n
  FROM (SELECT symbol, CASE WHEN l.l_returnflag = 'A' THEN 'SZSE' ELSE 'SSE' END AS exchange FROM lineitem l, LATERAL (SELECT CAST((CASE WHEN l.l_suppkey % 20 < 12 THEN 600000 WHEN l.l_suppkey % 20 < 16 THEN 300000 ELSE 688000 END) + l.l_suppkey % 20 AS VARCHAR) AS symbol)) GROUP BY 1, 2, 3"""))
def main_board(spark, sf):
    li = c.table(spark, sf, "lineitem")
    rows = li.select(
        c.symbol_of((F.col("l_suppkey") % 20).cast("int")).alias("symbol"),
        F.when(F.col("l_returnflag") == "A", "SZSE").otherwise("SSE").alias("exchange"),
    )
    return rows.withColumn("issue", metrics.board_issue(F.col("symbol"), F.col("exchange"))).groupBy("symbol", "exchange", "issue").agg(F.count(F.lit(1)).alias("n"))


@query(with_bars(select="SELECT symbol, CAST(session AS VARCHAR) AS session, bar_ix FROM bars WHERE amount >= 60000"))
def amount_floor(spark, sf):
    return c.publish(c.bars(spark, sf).where(metrics.amount_floor(F.col("amount"), 60000.0)).select("symbol", "session", "bar_ix"))


# ---- rolling indicators -----------------------------------------------------
_ROLL = [("sma", 20), ("sma", 60), ("roc", 10), ("max_high", 20), ("min_low", 20), ("boll_upper", 20), ("boll_lower", 20), ("volume_ratio", 20), ("lower_close_count", 5), ("higher_close_count", 5)]
_roll_steps = f"steps AS (SELECT *, CASE WHEN close < lag(close) OVER {sr.PLAIN} THEN 1 ELSE 0 END AS down, CASE WHEN close > lag(close) OVER {sr.PLAIN} THEN 1 ELSE 0 END AS up FROM bars)"
_roll_cols = ", ".join(
    r(sr.rolling(n, w), f"{n}_{w}", 6) if not n.endswith("count") else f"CAST({sr.rolling(n, w)} AS BIGINT) AS {n}_{w}" for n, w in _ROLL
)


@query(with_bars(_roll_steps, select=f"SELECT symbol, bar_ix, {_roll_cols} FROM steps"))
def rolling_indicators(spark, sf):
    df = ind.add_indicators(c.bars(spark, sf), set(_ROLL))
    return c.publish(df.select("symbol", "bar_ix", *[ind.column_name(k) for k in _ROLL]), 6)


_EWM = [("ema", 12), ("ema", 60), ("rsi", 7), ("rsi", 14), ("macd_dif", 26), ("macd_dea", 26), ("macd_hist", 26)]


@query(with_bars(*sr.recursion({12, 60}, {7, 14}, True), recursive=True,
    select=f"SELECT symbol, bar_ix, {', '.join(r(f'{n}_{w}', f'{n}_{w}', 6) for n, w in _EWM)} FROM ewm"))
def smoothed_indicators(spark, sf):
    df = ind.add_indicators(c.bars(spark, sf), set(_EWM))
    return c.publish(df.select("symbol", "bar_ix", *[ind.column_name(k) for k in _EWM]), 6)


@query(with_bars(f"d AS (SELECT *, close - lag(close) OVER {sr.PLAIN} AS ch, close / lag(close) OVER {sr.PLAIN} - 1 AS ret FROM bars)",
    f"""g AS (SELECT symbol, bar_ix, avg(CASE WHEN ch IS NOT NULL THEN greatest(ch, 0.0) END) OVER {sr.over(14)} AS gain,
       avg(CASE WHEN ch IS NOT NULL THEN greatest(-ch, 0.0) END) OVER {sr.over(14)} AS loss,
       stddev_samp(ret) OVER {sr.over(20)} AS vol FROM d)""",
    select=f"""SELECT symbol, bar_ix, {r(c.settled('CASE WHEN bar_ix >= 14 THEN CASE WHEN loss > 0 THEN 100.0 - 100.0 / (1.0 + gain / loss) WHEN gain > 0 THEN 100.0 ELSE 50.0 END END'), 'simple_rsi_14', 6)},
       {r(c.settled('CASE WHEN bar_ix >= 20 THEN vol END'), 'volatility_20', 6)} FROM g"""))
def mean_rsi_and_volatility(spark, sf):
    df = ind.add_indicators(c.bars(spark, sf), {("simple_rsi", 14), ("volatility", 20)})
    return c.publish(df.select("symbol", "bar_ix", "simple_rsi_14", "volatility_20"), 6)


@query(with_bars(c.BENCH_SQL, f"m AS (SELECT session, row_number() OVER (ORDER BY session) AS n, {c.settled('close')} AS close, {c.settled('avg(close) OVER (ORDER BY session ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)')} AS sma FROM bench)",
    select="""SELECT CAST(session AS VARCHAR) AS session, CASE WHEN n < 60 THEN 'unknown' WHEN close >= sma THEN 'bullish' ELSE 'bearish' END AS regime,
      CASE WHEN n < 60 THEN NULL WHEN close > sma THEN 'above_sma' WHEN close < sma THEN 'below_sma' END AS context FROM m"""))
def market_regime(spark, sf):
    return c.publish(ind.market_regime(c.benchmark(spark, sf)).select("session", "regime", "context"))


@query(with_bars(c.BENCH_SQL, "j AS (SELECT b.*, n.close AS bc FROM bars b LEFT JOIN bench n USING (session) )",
    f"k AS (SELECT symbol, bar_ix, close / lag(close, 20) OVER {sr.PLAIN} - 1 - (bc / lag(bc, 20) OVER {sr.PLAIN} - 1) AS rs, count(bc) OVER {sr.over(21)} AS n FROM j)",
    select=f"SELECT symbol, bar_ix, {r(c.settled('CASE WHEN n = 21 THEN rs END'), 'relative_strength_20', 6)} FROM k"))
def relative_strength(spark, sf):
    df = ind.relative_strength(c.bars(spark, sf), c.benchmark(spark, sf), 20)
    return c.publish(df.select("symbol", "bar_ix", "relative_strength_20"), 6)


@query(with_bars(f"v AS (SELECT symbol, bar_ix, CASE WHEN bar_ix >= 19 THEN {c.settled(f'volume / avg(volume) OVER {sr.over(20)}')} END AS vr FROM bars)",
    select="SELECT symbol, bar_ix, coalesce(vr >= 1.2, FALSE) AS busy FROM v"))
def volume_category(spark, sf):
    df = ind.add_indicators(c.bars(spark, sf), {("volume_ratio", 20)})
    return c.publish(df.select("symbol", "bar_ix", F.coalesce(F.col("volume_ratio_20") >= 1.2, F.lit(False)).alias("busy")))


_SMA = {n: f"CASE WHEN bar_ix >= {n - 1} THEN {c.settled(f'avg(close) OVER {sr.over(n)}')} END" for n in (10, 30)}


@query(with_bars(f"a AS (SELECT *, {_SMA[10]} AS f, {_SMA[30]} AS s FROM bars)",
    f"b2 AS (SELECT symbol, bar_ix, f, s, lag(f) OVER {sr.PLAIN} AS pf, lag(s) OVER {sr.PLAIN} AS ps FROM a)",
    select="SELECT symbol, bar_ix, coalesce(f > s AND pf <= ps, FALSE) AS up, coalesce(f < s AND pf >= ps, FALSE) AS down FROM b2"))
def average_cross(spark, sf):
    df = ind.add_indicators(c.bars(spark, sf), {("sma", 10), ("sma", 30)})
    return c.publish(df.select("symbol", "bar_ix", ind.cross_up("sma_10", "sma_30").alias("up"), ind.cross_down("sma_10", "sma_30").alias("down")))


@query(with_bars(select=f"""SELECT symbol, bar_ix, coalesce(bar_ix >= 20 AND close > mx, FALSE) AS up, coalesce(bar_ix >= 20 AND close < mn, FALSE) AS down FROM
  (SELECT symbol, bar_ix, close, max(close) OVER {sr.over(20, 20, 1)} AS mx, min(close) OVER {sr.over(20, 20, 1)} AS mn FROM bars)"""))
def close_breakout(spark, sf):
    df = ind.add_indicators(c.bars(spark, sf), {("max_close", 20), ("min_close", 20)})
    up, down = F.col("close") > F.col("max_close_20"), F.col("close") < F.col("min_close_20")
    return c.publish(df.select("symbol", "bar_ix", F.coalesce(up, F.lit(False)).alias("up"), F.coalesce(down, F.lit(False)).alias("down")))


@query(with_bars(select=f"SELECT symbol, bar_ix, {r(f'lag(close, 5) OVER {sr.PLAIN}', 'close_5_ago')}, {r(f'lag(high, 1) OVER {sr.PLAIN}', 'high_1_ago')} FROM bars"))
def offset_reference(spark, sf):
    b = c.bars(spark, sf)
    return c.publish(b.select("symbol", "bar_ix", ind.at_offset("close", -5).alias("close_5_ago"), ind.at_offset("high", -1).alias("high_1_ago")))

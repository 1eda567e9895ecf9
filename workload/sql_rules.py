"""The same condition trees as SQL text, for the side-by-side check."""

from __future__ import annotations

from tidemark.operators.rules import Rule
from tidemark.operators.signals import lookback
from workload.common import settled

W = "(PARTITION BY symbol ORDER BY session{frame})"


def over(n: int, start: int | None = None, stop: int = 0) -> str:
    first = n - 1 if start is None else start
    last = "CURRENT ROW" if stop == 0 else f"{stop} PRECEDING"
    return W.format(frame=f" ROWS BETWEEN {first} PRECEDING AND {last}")


PLAIN = W.format(frame="")

SHAPES = (
    "abs(close - open) AS body, high - low AS range, high - greatest(open, close) AS upper_shadow, "
    "least(open, close) - low AS lower_shadow, close > open AS is_bullish, close < open AS is_bearish"
)


def rolling(name: str, n: int) -> str:
    g = f"CASE WHEN bar_ix >= {n - 1} THEN {{}} END"
    if name == "sma":
        return g.format(settled(f"avg(close) OVER {over(n)}"))
    if name == "roc":
        return f"close / lag(close, {n}) OVER {PLAIN} - 1.0"
    if name == "max_high":
        return g.format(f"max(high) OVER {over(n)}")
    if name == "min_low":
        return g.format(f"min(low) OVER {over(n)}")
    if name in ("boll_upper", "boll_lower"):
        sign = "+" if name == "boll_upper" else "-"
        return g.format(settled(f"avg(close) OVER {over(n)} {sign} 2.0 * stddev_pop(close) OVER {over(n)}"))
    if name == "volume_ratio":
        return g.format(settled(f"volume / avg(volume) OVER {over(n)}"))
    if name in ("lower_close_count", "higher_close_count"):
        flag = "down" if name.startswith("lower") else "up"
        return g.format(f"sum({flag}) OVER {over(n, n - 1, 1)}")
    raise ValueError(name)


def recursion(spans: set[int], rsis: set[int], macd: bool) -> list[str]:
    """CTEs giving ema_n, rsi_n and the three convergence columns per bar."""
    alpha = {n: f"(2.0 / {n + 1})" for n in spans | ({12, 26} if macd else set())}
    cols, seed, step = ["symbol", "bar_ix", "px"], ["symbol", "bar_ix", "close"], ["b.symbol", "b.bar_ix", "b.close"]
    for n, a in sorted(alpha.items()):
        cols.append(f"e{n}")
        seed.append("close")
        step.append(f"{a} * b.close + (1 - {a}) * r.e{n}")
    if macd:
        cols.append("dea")
        seed.append("0.0::DOUBLE")
        dif = f"(({alpha[12]} * b.close + (1 - {alpha[12]}) * r.e12) - ({alpha[26]} * b.close + (1 - {alpha[26]}) * r.e26))"
        step.append(f"0.2 * {dif} + 0.8 * r.dea")
    for n in sorted(rsis):
        for side, d in (("g", "b.close - r.px"), ("l", "r.px - b.close")):
            cols.append(f"{side}{n}")
            seed.append("NULL::DOUBLE")
            now = f"greatest({d}, 0.0)"
            step.append(f"CASE WHEN b.bar_ix = 1 THEN {now} ELSE {now} / {n}.0 + (1 - 1.0 / {n}) * r.{side}{n} END")
    walk = (
        f"walk({', '.join(cols)}) AS (SELECT {', '.join(seed)} FROM bars WHERE bar_ix = 0 UNION ALL "
        f"SELECT {', '.join(step)} FROM walk r JOIN bars b ON b.symbol = r.symbol AND b.bar_ix = r.bar_ix + 1)"
    )
    out = [f"{settled(f'e{n}')} AS ema_{n}" for n in sorted(spans)]
    if macd:
        out += [f"{settled('e12 - e26')} AS macd_dif_26", f"{settled('dea')} AS macd_dea_26", f"{settled('e12 - e26 - dea')} AS macd_hist_26"]
    out += [
        f"{settled(f'CASE WHEN l{n} > 0 THEN 100.0 - 100.0 / (1.0 + g{n} / l{n}) WHEN g{n} > 0 THEN 100.0 ELSE 50.0 END')} AS rsi_{n}"
        for n in sorted(rsis)
    ]
    return [walk, f"ewm AS (SELECT symbol, bar_ix, {', '.join(out)} FROM walk)"]


def metric_name(body: dict) -> str:
    name = f"{body['name']}_{body['window']}" if "window" in body else body["name"]
    off = body.get("offset", 0)
    return name if off == 0 else f"{name}__{-off}"


def collect(tree, found: list) -> list:
    if isinstance(tree, list):
        for c in tree:
            collect(c, found)
    elif isinstance(tree, dict):
        for op, body in tree.items():
            if op in ("metric", "context"):
                found.append((op, body))
            elif op != "param":
                collect(body, found)
    return found


def prepared(rules: list[Rule], source: str = "bars") -> tuple[list[str], bool]:
    """CTEs ending in ``prep``: bars with every column the rules use."""
    nodes = [x for rule in rules for x in collect(rule.condition, [])]
    roll, spans, rsis, macd, shifted = {}, set(), set(), False, {}
    for op, body in nodes:
        name = body["name"]
        if name.startswith("macd"):
            macd = True
        elif name == "ema":
            spans.add(body["window"])
        elif name == "rsi":
            rsis.add(body["window"])
        elif "window" in body:
            roll[f"{name}_{body['window']}"] = rolling(name, body["window"])
        if op == "metric" and body.get("offset", 0):
            base = metric_name({**body, "offset": 0})
            shifted[metric_name(body)] = f"lag({base}, {-body['offset']}) OVER {PLAIN}"
    ctes = [
        f"steps AS (SELECT *, CASE WHEN close < lag(close) OVER {PLAIN} THEN 1 ELSE 0 END AS down, "
        f"CASE WHEN close > lag(close) OVER {PLAIN} THEN 1 ELSE 0 END AS up FROM {source})"
    ]
    rec = bool(spans or rsis or macd)
    extra = ""
    if rec:
        ctes += recursion(spans, rsis, macd)
        extra = " JOIN ewm USING (symbol, bar_ix)"
    rolls = "".join(f", {e} AS {n}" for n, e in sorted(roll.items()))
    ctes.append(f"ind AS (SELECT *, {SHAPES}{rolls} FROM steps{extra})")
    lags = "".join(f", {e} AS {n}" for n, e in sorted(shifted.items()))
    ctes.append(f"prep AS (SELECT *{lags} FROM ind)")
    return ctes, rec


_OPS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "="}


def sql(node, params: dict[str, float]) -> str:
    if isinstance(node, bool):
        return "TRUE" if node else "FALSE"
    if isinstance(node, (int, float)):
        return f"CAST({node!r} AS DOUBLE)"
    (op, body), = node.items()
    if op == "param":
        return f"CAST({params[body]!r} AS DOUBLE)"
    if op == "metric":
        return metric_name(body)
    if op == "context":
        return f"coalesce({body['name']}_{body['window']} >= {body['min_count']}, FALSE)"
    kids = [sql(c, params) for c in (body if isinstance(body, list) else [body])]
    if op in _OPS:
        return f"coalesce({kids[0]} {_OPS[op]} {kids[1]}, FALSE)"
    if op == "all":
        return "(" + " AND ".join(f"coalesce({k}, FALSE)" for k in kids) + ")"
    if op == "any":
        return "(" + " OR ".join(f"coalesce({k}, FALSE)" for k in kids) + ")"
    if op == "not":
        return f"(NOT coalesce({kids[0]}, FALSE))"
    if op in ("add", "mul", "sub"):
        return "(" + {"add": " + ", "mul": " * ", "sub": " - "}[op].join(kids) + ")"
    if op == "safe_div":
        return f"(CASE WHEN {kids[1]} = 0 THEN 0.0 ELSE {kids[0]} / {kids[1]} END)"
    if op == "div":
        return f"(CASE WHEN {kids[1]} <> 0 THEN {kids[0]} / {kids[1]} END)"
    if op == "abs":
        return f"abs({kids[0]})"
    if op in ("min", "max"):
        return f"{'least' if op == 'min' else 'greatest'}({', '.join(kids)})"
    raise ValueError(op)


def matches(rule: Rule) -> str:
    return f"(bar_ix >= {lookback(rule)} AND {sql(rule.condition, rule.params)})"


def matched_list(rules: list[Rule]) -> str:
    inner = ", ".join(f"CASE WHEN {matches(rule)} THEN {i} END" for i, rule in enumerate(rules))
    return f"list_filter([{inner}], lambda x: x IS NOT NULL)"

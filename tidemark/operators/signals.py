"""Condition trees to boolean columns, and scans of many rules in one pass."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.metrics import shape_columns
from tidemark.operators.indicators import (
    COUNTS,
    MACD,
    MACD_SIGNAL,
    MACD_SLOW,
    WINDOWED,
    Key,
    add_indicators,
    at_offset,
    column_name,
    cross_down,
    cross_up,
    relative_strength,
)
from tidemark.operators.rules import CONTEXT_PROFILES, ENTRY_EXIT, Rule
from tidemark.operators.series import by_symbol

BASE = ("open", "high", "low", "close", "body", "range", "upper_shadow", "lower_shadow", "is_bullish", "is_bearish")
_COMPARE = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "="}
_JOIN = {"all": " AND ", "any": " OR ", "add": " + ", "sub": " - ", "mul": " * "}


def leaves(tree: Any):
    """The metric and context nodes of a tree."""
    if isinstance(tree, list):
        for child in tree:
            yield from leaves(child)
    elif isinstance(tree, dict):
        for op, body in tree.items():
            if op in ("metric", "context"):
                yield op, body
            elif op != "param":
                yield from leaves(body)


def lookback(rule: Rule) -> int:
    """Bars that must lie before a bar for the rule to be judged on it."""
    need = rule.warmup
    for op, body in leaves(rule.condition):
        if op == "context":
            reach = body["window"]
        elif body["name"] in MACD:
            reach = MACD_SLOW + MACD_SIGNAL - body["offset"]
        else:
            reach = body.get("window", 1) - 1 - body["offset"]
        need = max(need, reach)
    return need


def _reference(body: dict) -> tuple[str, int]:
    name, offset = body["name"], body.get("offset", 0)
    if offset > 0:
        raise ValueError("an offset must not look ahead")
    if name in WINDOWED:
        if not isinstance(body.get("window"), int) or body["window"] < 2:
            raise ValueError(f"{name} needs a window of at least 2")
        return column_name((name, body["window"])), offset
    if name not in BASE:
        raise ValueError(f"unknown metric {name}")
    return name, offset


def _shifted(name: str, offset: int) -> str:
    return name if offset == 0 else f"{name}__{-offset}"


def prepare(bars: DataFrame, rules: list[Rule]) -> DataFrame:
    """Numbered bars plus every metric, indicator and offset the rules name.

    Each distinct column is built once however many rules use it.
    """
    keys: set[Key] = set()
    refs: set[tuple[str, int]] = set()
    for rule in rules:
        for op, body in leaves(rule.condition):
            if op == "context":
                if body["name"] not in COUNTS:
                    raise ValueError(f"unknown context {body['name']}")
                keys.add((body["name"], body["window"]))
            else:
                refs.add(_reference(body))
                if body["name"] in WINDOWED:
                    keys.add((body["name"], body["window"]))
    df = add_indicators(bars, keys)
    df = df.withColumns(shape_columns())
    lagged = {_shifted(n, o): at_offset(n, o) for n, o in sorted(refs) if o}
    return df.withColumns(lagged) if lagged else df


def text(node: Any, params: dict[str, float]) -> str:
    """One node as a Spark SQL expression over prepared bars.

    Text rather than Column calls: a scan of hundreds of rules then costs one
    call into the JVM per rule instead of one per node.
    """
    if isinstance(node, bool):
        return str(node).lower()
    if isinstance(node, (int, float)):
        return f"{float(node)!r}D"
    (op, body), = node.items()
    if op == "param":
        return f"{float(params[body])!r}D"
    if op == "metric":
        return f"`{_shifted(*_reference(body))}`"
    if op == "context":
        return f"coalesce(`{column_name((body['name'], body['window']))}` >= {int(body['min_count'])}, false)"
    parts = [text(child, params) for child in (body if isinstance(body, list) else [body])]
    if op in _COMPARE:
        return f"coalesce({parts[0]} {_COMPARE[op]} {parts[1]}, false)"
    if op in ("all", "any"):
        return "(" + _JOIN[op].join(f"coalesce({p}, false)" for p in parts) + ")"
    if op == "not":
        return f"(NOT coalesce({parts[0]}, false))"
    if op in _JOIN:
        return "(" + _JOIN[op].join(parts) + ")"
    if op == "div":
        return f"try_divide({parts[0]}, {parts[1]})"
    if op == "safe_div":
        return f"CASE WHEN {parts[1]} = 0D THEN 0D ELSE try_divide({parts[0]}, {parts[1]}) END"
    if op == "abs":
        return f"abs({parts[0]})"
    if op in ("min", "max"):
        return parts[0] if len(parts) == 1 else f"{'least' if op == 'min' else 'greatest'}({', '.join(parts)})"
    raise ValueError(f"unknown node {op}")


def value(node: Any, params: dict[str, float]) -> Column:
    return F.expr(text(node, params))


def _truth(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


def match_text(rule: Rule) -> str:
    return f"(bar_ix >= {lookback(rule)} AND coalesce({text(rule.condition, rule.params)}, false))"


def matches(rule: Rule) -> Column:
    """True where the rule holds; never before its look-back is complete."""
    return F.expr(match_text(rule))


def visible(back: int, observed: Column, available: str = "available_at") -> Column:
    """Every bar of the look-back was known when the decision was taken."""
    return F.max(available).over(by_symbol().rowsBetween(-back, 0)) <= observed


def _divisions(tree: Any, params: dict[str, float]):
    if isinstance(tree, list):
        for child in tree:
            yield from _divisions(child, params)
    elif isinstance(tree, dict):
        for op, body in tree.items():
            if op == "div":
                yield value(tree, params)
            if op not in ("metric", "context", "param"):
                yield from _divisions(body, params)


def status(rule: Rule, seen: Column | None = None) -> Column:
    """matched / not_matched / insufficient_data / data_error.

    A plain ``div`` by zero leaves the bar without enough data; ``seen`` is the
    visibility test (see ``visible``) and comes before the condition.
    """
    chain = F.when(F.col("bar_ix") < lookback(rule), "insufficient_data")
    if seen is not None:
        chain = chain.when(~F.coalesce(seen, F.lit(False)), "data_error")
    for quotient in _divisions(rule.condition, rule.params):
        chain = chain.when(quotient.isNull(), "insufficient_data")
    return chain.when(value(rule.condition, rule.params), "matched").otherwise("not_matched")


def explanation(rule: Rule) -> Column:
    """One struct per condition under the leading ``all``s."""

    def walk(node: dict, path: str):
        (op, body), = node.items()
        if op == "all":
            for i, child in enumerate(body):
                yield from walk(child, f"{path}.all[{i}]")
        elif op in _COMPARE:
            yield path, op, value(body[0], rule.params).cast("double"), value(body[1], rule.params).cast("double"), value(node, rule.params)
        else:
            hit = _truth(value(node, rule.params))
            yield path, op, hit.cast("double"), F.lit(1.0), hit

    return F.array(
        *[
            F.struct(
                F.lit(path).alias("path"), F.lit(op).alias("operator"), actual.alias("actual"), limit.alias("threshold"), ok.alias("passed")
            )
            for path, op, actual, limit, ok in walk(rule.condition, "expression")
        ]
    )


def matched_rules(rules: list[Rule]) -> Column:
    """Positions (in ``rules``) of all rules that hold on the bar."""
    flags = ", ".join(f"CASE WHEN {match_text(rule)} THEN {i} END" for i, rule in enumerate(rules))
    return F.expr(f"array_compact(array({flags}))")


def scan(bars: DataFrame, rules: list[Rule]) -> DataFrame:
    """All bars with the array ``matched`` of the rules that hold (may be empty).

    One pass whatever the number of rules: a single exchange on symbol, every
    indicator once, one boolean per rule.  There is no filter on the array here:
    pushed below the projection it would evaluate every rule twice, and an
    explode drops the empty arrays anyway.
    """
    keep = bars.columns
    return prepare(bars, rules).withColumn("matched", matched_rules(rules)).select(*keep, "matched")


def each_match(scanned: DataFrame) -> DataFrame:
    """One row per matched rule, its position in column ``rule``.

    ``explode_outer`` with a later filter: a plain explode makes Catalyst infer
    a filter on the array and push it below, where all rules run again.
    """
    keep = [c for c in scanned.columns if c != "matched"]
    return scanned.select(*keep, F.explode_outer("matched").alias("rule")).where(F.col("rule").isNotNull())


def signals(bars: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per (rule, bar) that matches."""
    names = F.array(*[F.lit(r.id) for r in rules])
    versions = F.array(*[F.lit(r.version) for r in rules])
    return (
        each_match(scan(bars, rules))
        .withColumns({"rule_id": F.element_at(names, F.col("rule") + 1), "rule_version": F.element_at(versions, F.col("rule") + 1)})
        .drop("rule")
    )


def signal(bars: DataFrame, condition: Column | dict, params: dict[str, float] | None = None) -> DataFrame:
    """Bars on which a condition holds: a tree, or any boolean Column.

    The Column form is the extension point: it may come from a UDF.
    """
    if isinstance(condition, Column):
        return bars.where(F.coalesce(condition, F.lit(False)))
    rule = Rule("adhoc", "0", condition, params or {})
    return prepare(bars, [rule]).where(matches(rule)).select(*bars.columns)


# ---- context profiles -------------------------------------------------------
def context_flags(bars: DataFrame, benchmark: DataFrame, profiles: list[str] | None = None) -> DataFrame:
    """One boolean column per profile; any missing history is False."""
    chosen = {name: CONTEXT_PROFILES[name] for name in (profiles or list(CONTEXT_PROFILES))}
    keys: set[Key] = set()
    strengths: set[int] = set()
    regimes: set[int] = set()
    for filters in chosen.values():
        for f in filters:
            if f[0] == "realized_volatility":
                keys.add(("volatility", f[1]))
            elif f[0] == "volume_category":
                keys.add(("volume_ratio", f[1]))
            elif f[0] == "relative_strength":
                strengths.add(f[1])
            else:
                regimes.add(f[2])
    keep = bars.columns
    df = add_indicators(bars, keys)
    for n in sorted(strengths):
        df = relative_strength(df, benchmark, n)
    aligned = F.broadcast(benchmark.select("session", F.col("close").alias("__index")))
    df = df.join(aligned, "session", "left")
    for n in sorted(regimes):
        frame = by_symbol().rowsBetween(-(n - 1), 0)
        mean = F.when(F.count("__index").over(frame) == n, F.rint(F.avg("__index").over(frame) * 1e10) / 1e10)
        df = df.withColumn(f"__mean_{n}", mean)

    def hit(f: tuple) -> Column:
        if f[0] == "market_regime":
            level, mean = F.rint(F.col("__index") * 1e10) / 1e10, F.col(f"__mean_{f[2]}")
            test = level > mean if f[1] == "above_sma" else level < mean
        elif f[0] == "volume_category":
            test = F.col(f"volume_ratio_{f[1]}") >= f[2]
        else:
            prefix = "relative_strength" if f[0] == "relative_strength" else "volatility"
            level = F.col(f"{prefix}_{f[1]}")
            test = level >= f[3] if f[2] == "gte" else level <= f[3]
        return F.coalesce(test, F.lit(False))

    flags = {name: reduce(lambda a, b: a & b, [hit(f) for f in filters]) for name, filters in chosen.items()}
    return df.withColumns(flags).select(*keep, *flags)


# ---- entry/exit pairs -------------------------------------------------------
def entry_exit(bars: DataFrame, pairs=ENTRY_EXIT) -> DataFrame:
    """``<id>_entry`` and ``<id>_exit`` booleans; no bar may carry both."""
    keys: set[Key] = set()
    need = {
        "sma_cross": lambda p: {("sma", p[0]), ("sma", p[1])},
        "ema_cross": lambda p: {("ema", p[0]), ("ema", p[1])},
        "rsi": lambda p: {("simple_rsi", p[0])},
        "momentum": lambda p: {("roc", p[0])},
        "breakout": lambda p: {("max_close", p[0]), ("min_close", p[0])},
        "boll_reversion": lambda p: {("sma", p[0]), ("boll_sample", p[0])},
        "volume_price": lambda p: {("mean_volume", p[0]), ("roc", 1)},
    }
    for _, family, p in pairs:
        keys |= need[family](p)
    keep = bars.columns
    df = add_indicators(bars, keys)
    spans = sorted({n for name, n in keys if name == "ema"})
    if spans:  # an average counts only once its span is complete
        df = df.withColumns({f"ema_{n}": F.when(F.col("bar_ix") >= n - 1, F.col(f"ema_{n}")) for n in spans})
    flags: dict[str, Column] = {}
    for name, family, p in pairs:
        if family in ("sma_cross", "ema_cross"):
            a, b = f"{family[:3]}_{p[0]}", f"{family[:3]}_{p[1]}"
            enter, leave = cross_up(a, b), cross_down(a, b)
        elif family == "rsi":
            r = F.col(f"simple_rsi_{p[0]}")
            enter, leave = r < p[1], r > p[2]
        elif family == "momentum":
            m = F.col(f"roc_{p[0]}")
            enter, leave = m > 0, m < 0
        elif family == "breakout":
            enter, leave = F.col("close") > F.col(f"max_close_{p[0]}"), F.col("close") < F.col(f"min_close_{p[0]}")
        elif family == "boll_reversion":
            mid = F.col(f"sma_{p[0]}")
            low = F.rint((mid - F.col(f"boll_sample_{p[0]}") * p[1]) * 1e10) / 1e10
            enter, leave = F.col("close") < low, F.col("close") > mid
        else:
            m, usual = F.col("roc_1"), F.col(f"mean_volume_{p[0]}")
            enter = (m > 0) & (F.col("volume") > usual * p[1])
            leave = (m < 0) | (F.col("volume") < usual)
        flags[f"{name}_entry"], flags[f"{name}_exit"] = _truth(enter), _truth(leave)
    return df.withColumns(flags).select(*keep, *flags)


def both_sides(flagged: DataFrame, pairs=ENTRY_EXIT) -> DataFrame:
    """Counts of bars that would enter and leave at once (all must be 0)."""
    return flagged.agg(*[F.count_if(F.col(f"{n}_entry") & F.col(f"{n}_exit")).alias(n) for n, _, _ in pairs])


def delay_to_eligible(planned: DataFrame) -> DataFrame:
    """Move each planned event to the next eligible bar; repeats merge.

    Input has booleans ``planned`` and ``eligible``.  A run is the stretch up to
    and including an eligible bar; the bar fires when its run planned anything.
    """
    runs = planned.withColumn(
        "__run",
        F.coalesce(
            F.sum(F.col("eligible").cast("int")).over(by_symbol().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    any_planned = F.max(F.col("planned").cast("int")).over(Window.partitionBy("symbol", "__run"))
    return runs.withColumn("fires", F.col("eligible") & (any_planned == 1)).drop("__run")



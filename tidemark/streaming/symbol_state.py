"""The streamed study with its state per symbol in a state store.

``FutureRun`` rewrites tables with every batch and keeps whole series for
recursive indicators.  Here a stateful operator keyed by symbol holds, in the
store that the query checkpoints:

* ``held``: bars whose session the event-time watermark has not passed yet,
* ``recent``: a fixed number of released bars, each with the running means of
  the rule's recursive indicators and the values the rule refers to.

So neither state nor work of a batch grows with the number of batches, also for
rules on recursive indicators.  The watermark on ``available_at`` says when a
session is closed; an event-time timer then releases its bars in order.  How
files fall into batches, and in which order they come, changes nothing as long
as no bar comes later than the delay.  A bar for a session its symbol has already
passed is turned away and put out with the reason.

The operator emits one row per released bar and horizon reached; rule, gates and
returns are the expressions of the batch study, evaluated on those rows.  The file
sink commits each batch once, so a batch run again after a failure adds nothing.
The benchmark is joined when outcomes are read: one that is not known yet leaves
its outcomes ``waiting``.

Defined cases: a NULL ``available_at`` counts as 15:00 of the session; rows without
symbol or session are turned away (``missing_key``), except heartbeats, which hold
nothing but ``available_at`` and only move the watermark; of several bars for one
session the first to arrive stays (inside a batch the least one); NULL prices and
volumes give NULL indicators; symbols without membership emit no outcome.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidemark.functions.metrics import shape_columns
from tidemark.operators import indicators as ind
from tidemark.operators import outcomes as oc
from tidemark.operators.intervals import covered
from tidemark.operators.rules import Rule
from tidemark.operators.signals import _reference, _shifted, leaves, lookback, matches

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = dt.date(1970, 1, 1)

_NUMBERS = ("open", "high", "low", "close", "volume", "amount")
_HELD = "at long, open double, high double, low double, close double, volume double, amount double, is_st boolean, is_member boolean, given array<double>"
_KEPT = f"ix long, day int, {_HELD[9:]}, means array<double>, seen array<double>"
_EMITTED = (
    "kind string, symbol string, session date, reason string, rows long, bar_ix long, horizon int, is_last boolean, "
    "entry_at date, entry_open double, entry_before double, entry_st boolean, "
    "exit_at date, exit_close double, exit_before double, exit_volume double, exit_amount double, exit_st boolean, refs array<double>"
)


@dataclass(frozen=True)
class Needs:
    """What a rule refers to: columns of the bar, indicators, running means, bars back."""

    given: tuple[str, ...]
    keys: tuple[ind.Key, ...]
    means: tuple[tuple[str, str, float, int], ...]
    refs: tuple[tuple[str, int], ...]

    @property
    def seen(self) -> tuple[str, ...]:
        return self.given + tuple(ind.column_name(k) for k in self.keys)


def needs(rule: Rule) -> Needs:
    keys, refs = set(), set()
    for op, body in leaves(rule.condition):
        if op == "context":
            keys.add((body["name"], body["window"]))
            refs.add((ind.column_name((body["name"], body["window"])), 0))
        else:
            refs.add(_reference(body))
            if body["name"] in ind.WINDOWED:
                keys.add((body["name"], body["window"]))
    named = {ind.column_name(k) for k in keys}
    means = [(f"ema_{n}", "close", ind.span_alpha(n), 0) for name, n in sorted(keys) if name == "ema"]
    if {name for name, _ in keys} & ind.MACD:
        means += [("fast", "close", ind.span_alpha(ind.MACD_FAST), 0), ("slow", "close", ind.span_alpha(ind.MACD_SLOW), 0), ("dea", "dif", ind.span_alpha(ind.MACD_SIGNAL), 0)]
    for n in sorted({n for name, n in keys if name == "rsi"}):
        means += [(f"gain_{n}", "gain", 1.0 / n, 1), (f"loss_{n}", "loss", 1.0 / n, 1)]
    return Needs(tuple(sorted({n for n, _ in refs} - named)), tuple(sorted(keys)), tuple(means), tuple(sorted(refs)))


def _settle(x: float) -> float:
    return float(np.rint(x * 1e10) / 1e10)


def _strength(gain: float, loss: float) -> float:
    if loss > 0:
        return 100.0 - 100.0 / (1.0 + gain / loss)
    return 100.0 if gain > 0 else 50.0


def _window_value(key: ind.Key, x: dict[str, np.ndarray]) -> float:
    """One rolling indicator on the newest bar; NaN where its frame is not full.

    ``x`` holds the series up to that bar, newest last, at least n + 1 bars or all there are.
    """
    name, n = key
    close = x["close"]
    if name == "roc":
        return close[-1] / close[-1 - n] - 1.0 if len(close) > n and close[-1 - n] else np.nan
    if name in ("max_close", "min_close"):
        return (np.nanmax if name == "max_close" else np.nanmin)(close[-1 - n : -1]) if len(close) > n else np.nan
    if len(close) < n:
        return np.nan
    if name in ind.COUNTS:
        step = np.diff(close)[-n:-1] if n > 1 else close[:0]
        return float(np.sum(step < 0 if name == "lower_close_count" else step > 0))
    if name in ("simple_rsi", "volatility"):
        if len(close) <= n:
            return np.nan
        step = np.diff(close[-n - 1 :])
        if name == "volatility":
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(close[-n - 1 : -1] != 0, step / close[-n - 1 : -1], np.nan)
            return _settle(np.std(step, ddof=1))
        return np.nan if np.isnan(step).any() else _settle(_strength(np.maximum(step, 0).mean(), np.maximum(-step, 0).mean()))
    if name in ("max_high", "min_low"):
        part = x["high" if name == "max_high" else "low"][-n:]
        return np.nan if np.isnan(part).all() else (np.nanmax if name == "max_high" else np.nanmin)(part)
    if name in ("mean_volume", "volume_ratio"):
        mean = x["volume"][-n:].mean()
        return _settle(mean) if name == "mean_volume" else _settle(x["volume"][-1] / mean) if mean else np.nan
    part = close[-n:][~np.isnan(close[-n:])]
    if not len(part):
        return np.nan
    if name == "sma":
        return _settle(part.mean())
    if name == "boll_sample":
        return _settle(np.std(part, ddof=1)) if len(part) > 1 else np.nan
    width = ind.BAND_WIDTH * np.std(part)
    return _settle(part.mean() + width if name == "boll_upper" else part.mean() - width)


class SymbolState(StatefulProcessor):
    """Holds bars until their session closes, then numbers, measures and emits them."""

    def __init__(self, rule: Rule, horizons: tuple[int, ...]):
        self.needs = needs(rule)
        self.horizons = horizons
        back = max([0, *(o for _, o in self.needs.refs)], key=abs)
        reach = max([1, *(n for _, n in self.needs.keys)])
        self.keep = max(reach, max(horizons) - back, lookback(rule)) + 1

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "day int", _HELD)
        self.recent = handle.getListState("recent", _KEPT)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        symbol = key[0]
        kept = {r[1] for r in self.recent.get()} if symbol is not None else set()
        waiting = {k[0] for k in self.held.keys()} if symbol is not None else set()
        last = max(kept, default=None)
        turned: dict[tuple, int] = {}
        fresh: dict[int, tuple] = {}
        for part in rows:
            for row in part.itertuples(index=False):
                if symbol is None or pd.isna(row.day):
                    if not row.heartbeat:
                        day = None if pd.isna(row.day) else int(row.day)
                        turned[day, "missing_key"] = turned.get((day, "missing_key"), 0) + 1
                    continue
                day = int(row.day)
                reason = "repeated_session"
                if last is not None and day <= last:
                    reason = "repeated_session" if day in kept else "out_of_order" if day > min(kept) else "before_kept_bars"
                elif day not in fresh and day not in waiting:
                    fresh[day] = self._stored(row)
                    continue
                elif day in fresh:
                    fresh[day] = min(fresh[day], self._stored(row), key=_order)
                turned[day, reason] = turned.get((day, reason), 0) + 1
        for day, bar in fresh.items():
            self.held.updateValue((day,), bar)
        if fresh:
            self.handle.registerTimer(min(b[0] for b in fresh.values()))
        if turned:
            yield self._frame([{"kind": "reject", "symbol": symbol, "session": _date(d), "reason": why, "rows": n} for (d, why), n in turned.items()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((k[0], tuple(v)) for k, v in self.held.iterator())
        newest = max((day for day, bar in waiting if bar[0] <= now), default=None)
        # bars of earlier sessions go first, also one that says it was available later
        ripe = [] if newest is None else [(day, bar) for day, bar in waiting if day <= newest]
        if len(ripe) < len(waiting):
            self.handle.registerTimer(min(bar[0] for _, bar in waiting[len(ripe) :]))
        if not ripe:
            return
        series = [tuple(r) for r in self.recent.get()]
        out = []
        for day, bar in ripe:
            series = [*series[-self.keep + 1 :], self._measured(series, day, bar)]
            out += self._reached(key[0], series)
            self.held.removeKey((day,))
        self.recent.put(series)
        if out:
            yield self._frame(out)

    # -- one bar ----------------------------------------------------------------
    @staticmethod
    def _stored(row) -> tuple:
        numbers = [None if pd.isna(getattr(row, n)) else float(getattr(row, n)) for n in _NUMBERS]
        given = [None if v is None or pd.isna(v) else float(v) for v in row.given]
        return (int(row.at), *numbers, bool(row.is_st) if not pd.isna(row.is_st) else False, bool(row.is_member), given)

    def _measured(self, series: list[tuple], day: int, bar: tuple) -> tuple:
        """The bar with its number, running means and the values rules refer to."""
        before = series[-1] if series else None
        ix = before[0] + 1 if before else 0
        closes = [r[5] for r in series] + [bar[4]]
        x = {n: np.array([np.nan if r[i + 2] is None else r[i + 2] for r in series] + [np.nan if bar[i + 1] is None else bar[i + 1]]) for i, n in enumerate(_NUMBERS)}
        known = before is not None and closes[-1] is not None and closes[-2] is not None
        change = closes[-1] - closes[-2] if known else np.nan
        source = {"close": x["close"][-1], "gain": max(change, 0.0) if known else np.nan, "loss": max(-change, 0.0) if known else np.nan}
        means: dict[str, float] = {}
        for i, (name, value, alpha, first) in enumerate(self.needs.means):
            if value == "dif":
                source["dif"] = means["fast"] - means["slow"]
            held = before[11][i] if before else None
            held = np.nan if held is None else held
            now = source[value]
            if ix <= first:
                means[name] = now if ix == first else np.nan
            else:  # a missing value adds nothing, the rest decays
                grown = (0.0 if np.isnan(held) else held) * (1.0 - alpha) + (0.0 if np.isnan(now) else alpha * now)
                means[name] = np.nan if np.isnan(held) and np.isnan(now) else grown
        values = [np.nan if v is None else v for v in bar[9]]
        for key in self.needs.keys:
            name, n = key
            if name == "rsi":
                gain, loss = means[f"gain_{n}"], means[f"loss_{n}"]
                values.append(np.nan if ix < 1 else _settle(_strength(gain, loss)))
            elif name == "ema":
                values.append(_settle(means[f"ema_{n}"]))
            elif name in ind.MACD:
                dif, dea = means["fast"] - means["slow"], means["dea"]
                values.append(_settle({"macd_dif": dif, "macd_dea": dea, "macd_hist": dif - dea}[name]))
            else:
                values.append(_window_value(key, x))
        as_list = lambda xs: [None if np.isnan(v) else float(v) for v in xs]
        return (ix, day, *bar[1:], as_list(means.values()), as_list(values))

    def _reached(self, symbol: str, series: list[tuple]) -> list[dict]:
        """Rows of the earlier bars whose horizon ends on the newest one, and the newest bar itself."""
        rows, last = [], series[-1]
        position = {name: i for i, name in enumerate(self.needs.seen)}

        def refs(at: int) -> list[float | None]:
            return [series[at + o][12][position[name]] if at + o >= 0 else None for name, o in self.needs.refs]

        for h in self.horizons:
            at = len(series) - 1 - h
            if at < 0 or not series[at][9]:
                continue
            bar, entry = series[at], series[at + 1]
            rows.append({
                "kind": "matured", "symbol": symbol, "session": _date(bar[1]), "bar_ix": bar[0], "horizon": h, "refs": refs(at),
                "entry_at": _date(entry[1]), "entry_open": entry[2], "entry_before": bar[5], "entry_st": entry[8],
                "exit_at": _date(last[1]), "exit_close": last[5], "exit_before": series[-2][5], "exit_volume": last[6], "exit_amount": last[7], "exit_st": last[8],
            })
        if last[9]:
            rows.append({"kind": "released", "symbol": symbol, "session": _date(last[1]), "bar_ix": last[0], "refs": refs(len(series) - 1)})
        return rows

    @staticmethod
    def _frame(rows: list[dict]) -> pd.DataFrame:
        names = [f.split()[0] for f in _EMITTED.split(", ")]
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def _order(bar: tuple) -> tuple:
    return tuple((v is None, 0 if v is None else v) for v in bar[:9])


def _date(day: int | None) -> dt.date | None:
    return None if day is None else EPOCH + dt.timedelta(days=day)


@dataclass
class SymbolRun:
    """One rule followed through incoming bars, its state in the store of the query."""

    rule: Rule
    memberships: DataFrame
    root: str
    study: oc.Study = field(default_factory=oc.Study)
    delay: str = "40 days"

    def emitted(self, bars: DataFrame) -> DataFrame:
        """The stateful part: rows of released bars, reached horizons and rejects."""
        spans = covered(self.memberships)
        spans = spans.groupBy("symbol").agg(F.collect_list(F.struct("active_from", "active_to")).alias("__spans"))
        inside = F.exists("__spans", lambda s: (F.col("session") >= s["active_from"]) & (s["active_to"].isNull() | (F.col("session") <= s["active_to"])))
        shapes = shape_columns()
        given = [(shapes[n] if n in shapes else F.col(n)).cast("double") for n in needs(self.rule).given]
        at = F.coalesce("available_at", F.col("session").cast("timestamp") + F.expr("INTERVAL 15 HOURS"))
        rows = bars.withColumn("available_at", at).withWatermark("available_at", self.delay).join(spans, "symbol", "left")
        asked = rows.select(
            F.when(F.col("session").isNotNull(), F.col("symbol")).alias("symbol"),
            F.date_diff(F.col("session"), F.lit(EPOCH)).alias("day"),
            # a plain number: the operator must see late rows to report them
            F.unix_millis("available_at").alias("at"),
            *_NUMBERS, "is_st",
            F.coalesce(inside, F.lit(False)).alias("is_member"),
            F.array(*given).cast("array<double>").alias("given"),
            (F.col("symbol").isNull() & F.col("session").isNull()).alias("heartbeat"),
        )
        return asked.groupBy("symbol").transformWithStateInPandas(SymbolState(self.rule, self.study.horizons), _EMITTED, "Append", "EventTime")

    def start(self, bars: DataFrame) -> StreamingQuery:
        """Consume what is there and stop; call again for what comes later."""
        conf = bars.sparkSession.conf
        before = conf.get("spark.sql.streaming.stateStore.providerClass", None)
        conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
        try:
            return (
                self._judged(self.emitted(bars)).writeStream.format("parquet").partitionBy("kind")
                .option("path", f"{self.root}/emitted").option("checkpointLocation", f"{self.root}/checkpoint")
                .trigger(availableNow=True).outputMode("append").start()
            )
        finally:
            if before is None:
                conf.unset("spark.sql.streaming.stateStore.providerClass")
            else:
                conf.set("spark.sql.streaming.stateStore.providerClass", before)

    def _judged(self, rows: DataFrame) -> DataFrame:
        """Signals and filled outcomes alone go on; rule and gates as in the batch study."""
        refs = needs(self.rule).refs
        named = rows.withColumns({_shifted(n, o): F.element_at("refs", i + 1) for i, (n, o) in enumerate(refs)})
        for n, o in refs:
            if n in ("is_bullish", "is_bearish"):
                named = named.withColumn(_shifted(n, o), F.col(_shifted(n, o)) > 0)
        named = named.withColumn("is_signal", matches(self.rule)).where((F.col("kind") == "reject") | F.col("is_signal"))
        bought = self._gate(named, "entry_at", {"open": "entry_open", "prev_close": "entry_before", "is_st": "entry_st"}, "buy_flags")
        sold = self._gate(bought, "exit_at", {"close": "exit_close", "prev_close": "exit_before", "is_st": "exit_st", "volume": "exit_volume", "amount": "exit_amount"}, "sell_flags")
        matured = F.col("kind") == "matured"
        filled = F.col("entry_open") > 0
        if self.study.skip_untradeable:
            filled = filled & (F.col("buy_flags") == 0) & (F.col("sell_flags") == 0)
        net = F.col("exit_close") / F.col("entry_open") - 1.0 - F.lit(self.study.round_trip)
        return sold.where(~matured | filled).select(
            "kind", "symbol", "session", "bar_ix", "horizon", "entry_at", "exit_at", F.when(matured, net).alias("net_return"), "reason", "rows"
        )

    @staticmethod
    def _gate(rows: DataFrame, day: str, columns: dict[str, str], flag: str) -> DataFrame:
        """The gate of one leg: its bar under the names the gates know."""
        blank = F.lit(None).cast("double")
        names = {n: F.col(columns[n]) if n in columns else blank for n in ("open", "close", "prev_close", "volume", "amount", "is_st")}
        bar = F.struct("symbol", F.col(day).alias("session"), *[v.alias(n) for n, v in names.items()]).alias("bar")
        held = F.struct(*rows.columns).alias("rest")
        return oc.gate_flags(rows.select(bar, held).select("bar.*", "rest")).select("rest.*", flag)

    # -- results ----------------------------------------------------------------
    def _rows(self, spark: SparkSession, kind: str) -> DataFrame:
        schema = "kind string, symbol string, session date, bar_ix long, horizon int, entry_at date, exit_at date, net_return double, reason string, rows long"
        return spark.read.schema(schema).parquet(f"{self.root}/emitted").where(F.col("kind") == kind).drop("kind")

    def outcomes(self, spark: SparkSession, benchmark: DataFrame) -> DataFrame:
        """Outcomes so far; ``waiting`` where the benchmark of entry or exit is not known yet."""
        rows = oc.benchmark_return(self._rows(spark, "matured").drop("reason", "rows"), benchmark)
        return rows.select(
            F.lit(self.rule.id).alias("rule_id"), "*", (F.col("net_return") - F.col("benchmark_return")).alias("excess_return"),
            F.when(F.col("benchmark_return").isNull(), "waiting").otherwise("completed").alias("status"),
        )

    def rejects(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, "reject").groupBy("symbol", "session", "reason").agg(F.sum("rows").alias("rows"))

    def signals(self, spark: SparkSession) -> DataFrame:
        """Every released bar on which the rule held, its exits reached or not."""
        return self._rows(spark, "released").select("symbol", "session", "bar_ix")


def heartbeat(spark: SparkSession, path: str, at: dt.datetime, schema: str) -> None:
    """A row without a bar that moves event time on; far enough ahead it releases all that is held."""
    names = [f.split()[0] for f in schema.split(", ")]
    spark.createDataFrame([tuple(at if n == "available_at" else None for n in names)], schema).coalesce(1).write.mode("append").parquet(path)


def state_rows(progress: dict) -> int:
    """Rows in the state store by a query's progress report."""
    return sum(op["numRowsTotal"] for op in progress.get("stateOperators", []))

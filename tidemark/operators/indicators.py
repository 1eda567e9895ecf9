"""Technical indicators as window expressions.

An indicator is named by a tuple such as ``("sma", 20)`` and lives in the column
``sma_20``.  ``add_indicators`` computes each requested one once; all rolling
frames share the (symbol, session) ordering and therefore one sort.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import settle
from tidemark.operators.series import by_symbol, trailing

Key = tuple[str, int]

# Fixed values of the moving-average convergence indicator and the bands.
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
BAND_WIDTH = 2.0

COUNTS = {"lower_close_count", "higher_close_count"}
MACD = {"macd_dif", "macd_dea", "macd_hist"}
ROLLING = {"sma", "roc", "max_high", "min_low", "boll_upper", "boll_lower", "volume_ratio", "simple_rsi", "volatility", "max_close", "min_close", "mean_volume", "boll_sample"} | COUNTS
RECURSIVE = {"ema", "rsi"} | MACD
WINDOWED = ROLLING | RECURSIVE

_TINY = 46.0      # exp(-46) = 1e-20, under one unit in the last place
_RANGE = 600.0    # exp(600) still fits a double with room for prices


def column_name(key: Key) -> str:
    return f"{key[0]}_{key[1]}"


@dataclass(frozen=True)
class Scan:
    """y[t] = (1-alpha) * y[t-1] + alpha * x[t], started at bar ``first``."""

    out: str
    value: str
    alpha: float
    first: int = 0

    @property
    def rate(self) -> float:
        return -math.log(1.0 - self.alpha)


def decayed_scans(df: DataFrame, scans: list[Scan]) -> DataFrame:
    """Exponentially weighted means without Python and without recursion.

    A series is cut into blocks of B bars.  Inside a block the mean is a running
    sum of x * q^-pos scaled by q^pos; across blocks the ends of all blocks before
    are folded and carried in, however little they weigh: after a long flat
    stretch nothing else is left.  B keeps the list of ends short (about eighty
    for the longest series) and q^-B a double.  Scans whose rates fit
    the same B share one window.
    """
    groups: list[list[Scan]] = []
    for scan in sorted(scans, key=lambda s: s.rate):
        for group in groups:
            if _block(group[0]) * scan.rate <= _RANGE:
                group.append(scan)
                break
        else:
            groups.append([scan])
    for group in groups:
        size = _block(group[0])
        pos = F.col("bar_ix") % size
        inside = Window.partitionBy("symbol", F.floor(F.col("bar_ix") / size)).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
        before = by_symbol().rowsBetween(Window.unboundedPreceding, -1)
        local, merged = {}, {}
        for s in group:
            q = 1.0 - s.alpha
            weight = F.when(F.col("bar_ix") == s.first, F.col(s.value)).when(F.col("bar_ix") > s.first, F.col(s.value) * s.alpha)
            part = f"__{s.out}"
            local[part] = F.pow(F.lit(q), pos) * F.sum(weight * F.pow(F.lit(q), -pos)).over(inside)
            ends = F.collect_list(F.when(pos == size - 1, F.col(part))).over(before)
            merged[s.out] = F.col(part) + _folded(ends, q**size) * F.pow(F.lit(q), pos + 1)
        df = df.withColumns(local).withColumns(merged).drop(*local)
    return df


def _folded(ends: Column, decay: float) -> Column:
    """What the ends of earlier blocks come to at the end of the last of them."""
    return F.aggregate(ends, F.lit(0.0), lambda held, end: held * decay + end)


def _block(scan: Scan) -> int:
    return max(2, math.ceil(_TINY / scan.rate))


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def _guard(n: int, value: Column) -> Column:
    """NULL until the frame holds n bars."""
    return F.when(F.col("bar_ix") >= n - 1, value)


def _rolling(key: Key) -> Column:
    name, n = key
    frame = trailing(n)
    if name == "sma":
        return _guard(n, settle(F.avg("close").over(frame)))
    if name == "roc":
        return F.try_divide(F.col("close"), F.lag("close", n).over(by_symbol())) - 1.0
    if name == "max_high":
        return _guard(n, F.max("high").over(frame))
    if name == "min_low":
        return _guard(n, F.min("low").over(frame))
    if name in ("max_close", "min_close"):
        pick = F.max if name == "max_close" else F.min
        return F.when(F.col("bar_ix") >= n, pick("close").over(by_symbol().rowsBetween(-n, -1)))
    if name in ("boll_upper", "boll_lower"):
        width = F.stddev_pop("close").over(frame) * BAND_WIDTH
        mean = F.avg("close").over(frame)
        return _guard(n, settle(mean + width if name == "boll_upper" else mean - width))
    if name == "boll_sample":
        return _guard(n, settle(F.stddev_samp("close").over(frame)))
    if name == "mean_volume":
        return F.when(F.count("volume").over(frame) == n, settle(F.avg("volume").over(frame)))
    if name == "volume_ratio":
        ratio = F.try_divide(F.col("volume"), F.avg("volume").over(frame))
        return F.when(F.count("volume").over(frame) == n, settle(ratio))
    if name == "volatility":
        return F.when(F.count("__ret").over(frame) == n, settle(F.stddev_samp("__ret").over(frame)))
    if name in COUNTS:
        step = "__down" if name == "lower_close_count" else "__up"
        return F.when(F.col("bar_ix") >= n - 1, F.sum(step).over(by_symbol().rowsBetween(-(n - 1), -1)))
    if name == "simple_rsi":
        gain, loss = F.avg("__gain").over(frame), F.avg("__loss").over(frame)
        return F.when(F.count("__gain").over(frame) == n, settle(_rsi(gain, loss)))
    raise ValueError(f"unknown indicator {key}")


def _rsi(gain: Column, loss: Column) -> Column:
    """100 when only gains remain, 50 when neither side moved."""
    value = 100.0 - 100.0 / (1.0 + F.try_divide(gain, loss))
    return F.when(loss > 0, value).when(gain > 0, 100.0).otherwise(50.0)


def add_indicators(bars: DataFrame, keys: set[Key]) -> DataFrame:
    """Add the requested columns to numbered bars."""
    unknown = {k for k in keys if k[0] not in WINDOWED}
    if unknown:
        raise ValueError(f"unknown indicators {sorted(unknown)}")
    names = {k[0] for k in keys}
    bars_in = bars.columns
    previous = F.lag("close").over(by_symbol())
    change = F.col("close") - previous
    steps: dict[str, Column] = {}
    if names & COUNTS:
        steps["__down"] = (F.col("close") < previous).cast("int")
        steps["__up"] = (F.col("close") > previous).cast("int")
    if names & {"rsi", "simple_rsi"}:
        steps["__gain"] = F.greatest(change, F.lit(0.0)) + 0.0 * change
        steps["__loss"] = F.greatest(-change, F.lit(0.0)) + 0.0 * change
    if "volatility" in names:
        steps["__ret"] = F.try_divide(F.col("close"), previous) - 1.0
    df = bars.withColumns(steps) if steps else bars

    rolling = {column_name(k): _rolling(k) for k in sorted(keys) if k[0] in ROLLING}
    if rolling:
        df = df.withColumns(rolling)

    scans = [Scan(f"__ema_{n}", "close", span_alpha(n)) for name, n in sorted(keys) if name == "ema"]
    if names & MACD:
        scans += [Scan("__fast", "close", span_alpha(MACD_FAST)), Scan("__slow", "close", span_alpha(MACD_SLOW))]
    for n in sorted({n for name, n in keys if name == "rsi"}):
        scans += [Scan(f"__gain_{n}", "__gain", 1.0 / n, 1), Scan(f"__loss_{n}", "__loss", 1.0 / n, 1)]
    if scans:
        df = decayed_scans(df, scans)
    final: dict[str, Column] = {}
    if names & MACD:
        df = df.withColumn("__dif", F.col("__fast") - F.col("__slow"))
        df = decayed_scans(df, [Scan("__dea", "__dif", span_alpha(MACD_SIGNAL))])
        parts = {"macd_dif": F.col("__dif"), "macd_dea": F.col("__dea"), "macd_hist": F.col("__dif") - F.col("__dea")}
        final |= {column_name(k): settle(parts[k[0]]) for k in sorted(keys) if k[0] in MACD}
    for name, n in sorted(keys):
        if name == "ema":
            final[column_name((name, n))] = settle(F.col(f"__ema_{n}"))
        elif name == "rsi":
            final[column_name((name, n))] = settle(_rsi(F.col(f"__gain_{n}"), F.col(f"__loss_{n}")))
    if final:
        df = df.withColumns(final)
    return df.select(*bars_in, *[column_name(k) for k in sorted(keys)])


def market_regime(benchmark: DataFrame, window: int = 60) -> DataFrame:
    """Per benchmark session: the event-study regime and the context form.

    ``regime`` calls equality with the average bullish and the first window-1
    sessions unknown; ``context`` is strict on both sides and NULL otherwise.
    The window has no partition: one row per session, at most MAX_SESSIONS.
    """
    order = Window.orderBy("session")
    frame = order.rowsBetween(-(window - 1), 0)
    mean = F.when(F.row_number().over(order) >= window, settle(F.avg("close").over(frame)))
    close = settle(F.col("close"))
    return benchmark.withColumn("__mean", mean).select(
        "*",
        F.when(F.col("__mean").isNull(), "unknown").when(close >= F.col("__mean"), "bullish").otherwise("bearish").alias("regime"),
        F.when(close > F.col("__mean"), "above_sma").when(close < F.col("__mean"), "below_sma").alias("context"),
    ).drop("__mean")


def relative_strength(bars: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """n-bar return minus the benchmark's over the same exact sessions.

    NULL unless the benchmark has every session of the n+1-bar window; nothing
    is filled forward.  The benchmark has one row per day, so it is broadcast.
    """
    quotes = F.broadcast(benchmark.select("session", F.col("close").alias("__bench")))
    own = F.try_divide(F.col("close"), F.lag("close", window).over(by_symbol())) - 1.0
    theirs = F.try_divide(F.col("__bench"), F.lag("__bench", window).over(by_symbol())) - 1.0
    complete = F.count("__bench").over(trailing(window + 1)) == window + 1
    return (
        bars.join(quotes, "session", "left")
        .withColumn(f"relative_strength_{window}", F.when(complete, settle(own - theirs)))
        .drop("__bench")
    )


def cross_up(a: str, b: str) -> Column:
    """a above b now, not above it one bar ago."""
    before = (F.lag(a).over(by_symbol()) <= F.lag(b).over(by_symbol()))
    return F.coalesce((F.col(a) > F.col(b)) & before, F.lit(False))


def cross_down(a: str, b: str) -> Column:
    before = (F.lag(a).over(by_symbol()) >= F.lag(b).over(by_symbol()))
    return F.coalesce((F.col(a) < F.col(b)) & before, F.lit(False))


def at_offset(name: str, offset: int) -> Column:
    """A column some bars ago; looking ahead is refused."""
    if offset > 0:
        raise ValueError("an offset must not look ahead")
    return F.col(name) if offset == 0 else F.lag(name, -offset).over(by_symbol())

"""The per-symbol series every window operator runs on.

Size of a window group.  A series holds at most one bar per calendar day:
``build_bars`` groups by (symbol, session), ``normalize_bars`` rejects repeated
sessions, and both fail on sessions outside FIRST_DAY..LAST_DAY.  A group is
therefore at most MAX_SESSIONS short rows whatever the number of raw rows
behind it, so one hot symbol costs one task a few megabytes, never a share of
the table.  The raw side (ticks, file rows, overlay batches), where a symbol
may hold a third of all rows, is only ever met by aggregates with map-side
partials.  All windows of a plan share one hash exchange on ``symbol``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

FIRST_DAY = dt.date(1970, 1, 1)
LAST_DAY = dt.date(2099, 12, 31)
MAX_SESSIONS = (LAST_DAY - FIRST_DAY).days + 1


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("session")


def trailing(n: int) -> WindowSpec:
    """The current bar and the n-1 bars before it."""
    return by_symbol().rowsBetween(-(n - 1), 0)


def whole() -> WindowSpec:
    return Window.partitionBy("symbol")


def in_calendar(session: Column) -> Column:
    return session.between(F.lit(FIRST_DAY), F.lit(LAST_DAY))


def checked_session(session: Column, given: Column) -> Column:
    """The session, or a failed job with the value that is no date of the calendar."""
    bad = F.concat(F.lit("not a session of the calendar: "), F.coalesce(given.cast("string"), F.lit("NULL")))
    return F.when(in_calendar(session), session).otherwise(F.raise_error(bad).cast("date"))


def build_bars(ticks: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Ticks (symbol, session, seq, price, volume, amount) to daily bars.

    Only mutable-width aggregates, so the partial step is a hash aggregate and
    the shuffle carries one row per (map task, symbol, session).
    """
    aggregates = {
        "open": F.min_by("price", "seq"),
        "high": F.max("price"),
        "low": F.min("price"),
        "close": F.max_by("price", "seq"),
        "volume": F.sum("volume"),
        "amount": F.sum("amount"),
        **(extra or {}),
    }
    return (
        ticks.withColumn("session", checked_session(F.col("session"), F.col("session")))
        .groupBy("symbol", "session")
        .agg(*[c.alias(n) for n, c in aggregates.items()])
    )


def number_bars(bars: DataFrame) -> DataFrame:
    """Add position, series length and the previous close."""
    return bars.withColumns(
        {
            "bar_ix": (F.row_number().over(by_symbol()) - 1).cast("long"),
            "n_bars": F.count(F.lit(1)).over(whole()),
            "prev_close": F.lag("close").over(by_symbol()),
        }
    )


def calendar_of(bars: DataFrame) -> DataFrame:
    """Union of the observed sessions, numbered from 0.

    The unpartitioned window runs over at most MAX_SESSIONS dates.
    """
    days = bars.select("session").distinct()
    return days.withColumn("session_ix", (F.row_number().over(Window.orderBy("session")) - 1).cast("long"))


def equal_weight_benchmark(bars: DataFrame) -> DataFrame:
    """One open and close per session: the mean over the symbols."""
    return bars.groupBy("session").agg(F.avg("open").alias("open"), F.avg("close").alias("close"))


def grid(bars: DataFrame) -> DataFrame:
    """Calendar x symbols with raw values and, apart, a forward-filled close.

    The calendar travels as one array value (bounded by MAX_SESSIONS) and is
    unfolded next to each symbol, so no cross join is planned.
    """
    sessions = bars.select("session").agg(F.sort_array(F.collect_set("session")).alias("a"))
    cells = bars.select("symbol").distinct().select("symbol", F.explode(sessions.scalar()).alias("session"))
    filled = F.last("close", ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return cells.join(bars, ["symbol", "session"], "left").withColumns(
        {"observed": F.col("close").isNotNull(), "valuation_close": filled}
    )

"""Scalar metrics of one bar."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exchange limit rules and the main-board prefixes per exchange.
ST_LIMIT = 0.05
STAR_LIMIT = 0.20
CHINEXT_LIMIT = 0.20
DEFAULT_LIMIT = 0.10
LIMIT_TOLERANCE = 0.001
CHINEXT_WIDE_FROM = dt.date(2020, 8, 24)
MAIN_BOARD = {"SSE": ("600", "601", "603", "605"), "SZSE": ("000", "001", "002", "003")}


def shape_columns() -> dict[str, Column]:
    """Body, range, shadows and colour of the candle."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {
        "body": F.abs(c - o),
        "range": h - l,
        "upper_shadow": h - F.greatest(o, c),
        "lower_shadow": F.least(o, c) - l,
        "is_bullish": c > o,
        "is_bearish": c < o,
    }


def limit_pct(symbol: Column, session: Column, is_st: Column) -> Column:
    """Daily price limit; special treatment is looked at before the board."""
    board = F.substring(symbol, 1, 3)
    wide_chinext = board.isin("300", "301") & (session.isNull() | (session >= F.lit(CHINEXT_WIDE_FROM)))
    return (
        F.when(F.coalesce(is_st, F.lit(False)), ST_LIMIT)
        .when(board == "688", STAR_LIMIT)
        .when(wide_chinext, CHINEXT_LIMIT)
        .otherwise(DEFAULT_LIMIT)
    )


def board_issue(symbol: Column, exchange: Column) -> Column:
    """NULL for a main-board symbol on its own exchange, else the reason."""
    prefix = F.substring(symbol, 1, 3)
    own = F.lit(False)
    known = [p for group in MAIN_BOARD.values() for p in group]
    for name, prefixes in MAIN_BOARD.items():
        own = own | ((exchange == name) & prefix.isin(*prefixes))
    return (
        F.when(~symbol.rlike("^[0-9]{6}$"), "invalid_symbol")
        .when(~prefix.isin(*known), "not_main_board")
        .when(~own, "exchange_prefix_mismatch")
    )


def cost_stress(base_return: Column, round_trip: float, multiples: list[float]) -> Column:
    """Array of (multiple, stressed return): the base already carries cost 1x."""
    return F.array(
        *[
            F.struct(F.lit(float(m)).alias("multiple"), (base_return - F.lit((m - 1.0) * round_trip)).alias("stressed"))
            for m in multiples
        ]
    )


def net_of(raw: Column, round_trip: float, multiple: float = 1.0) -> Column:
    return raw - F.lit(round_trip * multiple)


def amount_floor(amount: Column, least: float) -> Column:
    """A missing amount fails the floor."""
    return F.coalesce(amount >= F.lit(least), F.lit(False))

"""What happened after a signal: entry at the next open, exit h bars on.

Everything that looks ahead is a ``lead`` or a forward frame over the complete
series, computed before rows are filtered down to signals.  Apply an end date
to the bars first, so that no frame can read past it.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.metrics import LIMIT_TOLERANCE, limit_pct
from tidemark.operators.intervals import members_only
from tidemark.operators.series import by_symbol

# Reasons an order cannot be filled, by bit.
BUY_REASONS = ("missing_or_invalid_price", "limit_up_buy_unavailable")
SELL_REASONS = (
    "missing_or_invalid_price",
    "zero_or_invalid_volume",
    "zero_or_invalid_amount",
    "limit_down_sell_unavailable",
)


@dataclass(frozen=True)
class Study:
    """Settings of one event study."""

    horizons: tuple[int, ...] = (1, 3, 5, 10, 20)
    commission_bps: float = 3.0
    slippage_bps: float = 5.0
    oos_start: dt.date | None = None
    skip_untradeable: bool = True
    regime_window: int = 60
    min_signal_amount: float | None = None
    stress: tuple[float, ...] = (2.0, 3.0)
    min_observations: int = 300
    min_horizons: int = 2
    both_regimes: bool = False
    alpha: float = 0.05
    duplicate_jaccard: float = 0.85

    def __post_init__(self) -> None:
        if not self.horizons or any(h < 1 for h in self.horizons) or len(set(self.horizons)) != len(self.horizons):
            raise ValueError("horizons must be distinct positive bar counts")
        if self.commission_bps < 0 or self.slippage_bps < 0:
            raise ValueError("costs must not be negative")

    @property
    def round_trip(self) -> float:
        return 2.0 * (self.commission_bps + self.slippage_bps) / 10_000.0


def _positive(col: Column) -> Column:
    return F.coalesce(col > 0, F.lit(False))


def gate_flags(bars: DataFrame, blank_volume_blocks: bool = False) -> DataFrame:
    """Add ``buy_flags`` (at the open) and ``sell_flags`` (at the close) as bits.

    The buy side sees the open and the previous close only.  A missing volume
    or amount is no obstacle unless ``blank_volume_blocks``; zero is.
    """
    limit = limit_pct(F.col("symbol"), F.col("session"), F.col("is_st"))
    prior_ok = _positive(F.col("prev_close"))
    up = _positive(F.col("open")) & prior_ok & (F.try_divide(F.col("open"), F.col("prev_close")) - 1.0 >= limit - LIMIT_TOLERANCE)
    down = _positive(F.col("close")) & prior_ok & (F.try_divide(F.col("close"), F.col("prev_close")) - 1.0 <= -limit + LIMIT_TOLERANCE)

    def dry(name: str) -> Column:
        bad = F.col(name) <= 0
        return (F.col(name).isNull() | bad) if blank_volume_blocks else F.coalesce(bad, F.lit(False))

    def bits(*conditions: Column) -> Column:
        total = F.lit(0)
        for i, c in enumerate(conditions):
            total = total + F.when(c, F.lit(1 << i)).otherwise(F.lit(0))
        return total

    return bars.withColumns(
        {
            "buy_flags": bits(~_positive(F.col("open")), F.coalesce(up, F.lit(False))),
            "sell_flags": bits(~_positive(F.col("close")), dry("volume"), dry("amount"), F.coalesce(down, F.lit(False))),
        }
    )


def reasons(flags: Column, names: tuple[str, ...], prefix: str = "") -> Column:
    return F.array_compact(F.array(*[F.when(flags.bitwiseAND(F.lit(1 << i)) != 0, F.lit(prefix + n)) for i, n in enumerate(names)]))


def look_ahead(bars: DataFrame, horizons: tuple[int, ...], excursions: bool = True) -> DataFrame:
    """Add entry columns and one struct per horizon, all from one window sort."""
    w = by_symbol()
    columns = {
        "entry_at": F.lead("session", 1).over(w),
        "entry_price": F.lead("open", 1).over(w),
        "__buy": F.lead("buy_flags", 1).over(w),
    }
    for h in horizons:
        columns |= {
            f"__exit_at_{h}": F.lead("session", h).over(w),
            f"__exit_{h}": F.lead("close", h).over(w),
            f"__sell_{h}": F.lead("sell_flags", h).over(w),
        }
        if excursions:
            columns |= {f"__high_{h}": F.max("high").over(w.rowsBetween(1, h)), f"__low_{h}": F.min("low").over(w.rowsBetween(1, h))}
    return bars.withColumns(columns)


def stack_horizons(df: DataFrame, horizons: tuple[int, ...], excursions: bool = True) -> DataFrame:
    """One row per horizon; rows whose exit lies past the series are left out."""

    def leg(h: int) -> Column:
        fields = [
            F.lit(h).alias("horizon"),
            F.col(f"__exit_at_{h}").alias("exit_at"),
            F.col(f"__exit_{h}").alias("exit_price"),
            F.col(f"__sell_{h}").alias("__sell"),
        ]
        if excursions:
            fields += [F.col(f"__high_{h}").alias("__high"), F.col(f"__low_{h}").alias("__low")]
        return F.struct(*fields)

    keep = [c for c in df.columns if not c.startswith(("__exit_", "__sell_", "__high_", "__low_"))]
    return (
        df.withColumn("__leg", F.explode(F.array(*[leg(h) for h in horizons])))
        .select(*keep, "__leg.*")
        .where(F.col("exit_at").isNotNull() & (F.col("entry_price") > 0))
    )


def benchmark_return(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Exact-date benchmark return: open on entry, close on exit, no filling.

    The benchmark has one row per calendar day (at most MAX_SESSIONS), which is
    what makes the broadcast safe at any data size.
    """
    opens = F.broadcast(benchmark.select(F.col("session").alias("entry_at"), F.col("open").alias("__b_open")))
    closes = F.broadcast(benchmark.select(F.col("session").alias("exit_at"), F.col("close").alias("__b_close")))
    joined = df.join(opens, "entry_at", "left").join(closes, "exit_at", "left")
    return joined.withColumn(
        "benchmark_return", F.when(F.col("__b_open") > 0, F.col("__b_close") / F.col("__b_open") - 1.0)
    ).drop("__b_open", "__b_close")


def returns(df: DataFrame, study: Study) -> DataFrame:
    """Raw, net and excess returns, split and gate columns."""
    raw = F.col("exit_price") / F.col("entry_price") - 1.0
    net = raw - F.lit(study.round_trip)
    split = F.lit("in_sample") if study.oos_start is None else F.when(F.col("entry_at") >= F.lit(study.oos_start), "out_of_sample").otherwise("in_sample")
    columns = {
        "raw_return": raw,
        "net_return": net,
        "excess_return": raw - F.col("benchmark_return"),
        "net_excess_return": net - F.col("benchmark_return"),
        "sample_split": split,
        "entry_executable": F.col("__buy") == 0,
        "exit_executable": F.col("__sell") == 0,
    }
    if "__high" in df.columns:
        columns |= {"mfe": F.col("__high") / F.col("entry_price") - 1.0, "mae": F.col("__low") / F.col("entry_price") - 1.0}
    out = df.withColumns(columns)
    if study.skip_untradeable:
        out = out.where(F.col("entry_executable") & F.col("exit_executable"))
    else:
        out = out.withColumn(
            "reason_codes", F.concat(reasons(F.col("__buy"), BUY_REASONS, "entry:"), reasons(F.col("__sell"), SELL_REASONS, "exit:"))
        )
    return out.drop("__buy", "__sell", "__high", "__low")


def outcomes(
    flagged: DataFrame,
    benchmark: DataFrame | None,
    study: Study,
    where: Column | None = None,
    memberships: DataFrame | None = None,
) -> DataFrame:
    """Outcomes of the bars selected by ``where`` (default: column ``is_signal``).

    ``flagged`` must still hold all bars of each series; memberships are asked
    on the signal date, after the bars have shrunk to signals.
    """
    ahead = look_ahead(gate_flags(flagged), study.horizons)
    picked = ahead.where(F.col("is_signal") if where is None else where)
    if memberships is not None:
        picked = members_only(picked, memberships)
    legs = stack_horizons(picked, study.horizons)
    if benchmark is None:
        legs = legs.withColumn("benchmark_return", F.lit(None).cast("double"))
    else:
        legs = benchmark_return(legs, benchmark)
    return returns(legs, study)


def one_bar_backtest(flagged: DataFrame, round_trip: float, where: Column | None = None) -> DataFrame:
    """Buy the next open, sell that day's close; no gates, opens <= 0 skipped."""
    w = by_symbol()
    legs = flagged.withColumns({"__in": F.lead("open", 1).over(w), "__out": F.lead("close", 1).over(w)})
    legs = legs.where((F.col("is_signal") if where is None else where) & (F.col("__in") > 0))
    gross = F.col("__out") / F.col("__in") - 1.0
    return legs.agg(F.count(F.lit(1)).alias("trades"), F.sum(gross).alias("gross_sum"), F.sum(gross - F.lit(round_trip)).alias("net_sum"))


def maturity(flagged: DataFrame, horizons: tuple[int, ...], delay: int = 0) -> DataFrame:
    """Each signal and horizon as completed or tail_purged, by position only."""
    rows = flagged.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    left = F.col("n_bars") - 1 - F.col("bar_ix")
    return rows.withColumn("status", F.when(left >= F.col("horizon") + delay, "completed").otherwise("tail_purged"))


def execution_panel(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars with tradeable flags and reasons, and apart the bars without a previous close."""
    flagged = gate_flags(bars, blank_volume_blocks=True)
    panel = flagged.where(F.col("prev_close").isNotNull()).withColumns(
        {
            "tradeable_open": F.col("buy_flags") == 0,
            "tradeable_close": F.col("sell_flags") == 0,
            "open_reason_codes": reasons(F.col("buy_flags"), BUY_REASONS),
            "close_reason_codes": reasons(F.col("sell_flags"), SELL_REASONS),
        }
    ).drop("buy_flags", "sell_flags")
    aside = bars.where(F.col("prev_close").isNull()).select(
        "symbol", "session", F.lit("missing_prev_close_first_available_bar").alias("reason"), F.col("close").alias("close_reference")
    )
    return panel, aside


def approximate_trades(cells: DataFrame) -> DataFrame:
    """Approximate buy and sell resolution on the calendar grid.

    ``cells`` is ``series.grid``.  A buy fails for the first reason that holds; a
    sell moves to the first later session that is eligible.
    """
    one_price = (F.col("open") == F.col("high")) & (F.col("open") == F.col("low")) & (F.col("open") == F.col("close"))
    buy = (
        F.when(~F.col("observed"), "no_observed_row")
        .when(F.coalesce(F.col("is_st"), F.lit(False)), "st_excluded")
        .when(F.coalesce(F.col("volume") <= 0, F.lit(True)), "nonpositive_volume")
        .when(one_price, "suspected_one_price_board")
        .otherwise("approximate_observed_row")
    )
    w = by_symbol()
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    step = cells.withColumns({"buy_resolution": buy, "__pos": F.row_number().over(w)})
    ok = F.col("buy_resolution") == "approximate_observed_row"
    step = step.withColumns(
        {
            "sell_session": F.first(F.when(ok, F.col("session")), ignorenulls=True).over(ahead),
            "__sell_pos": F.first(F.when(ok, F.col("__pos")), ignorenulls=True).over(ahead),
            "__last": F.max("__pos").over(Window.partitionBy("symbol")),
        }
    )
    return step.withColumns(
        {
            "sell_resolution": F.when(F.col("sell_session").isNull(), "unresolved_no_eligible_observation").otherwise("delayed_approximate_observed_row"),
            "sell_delay": F.coalesce(F.col("__sell_pos"), F.col("__last")) - F.col("__pos"),
        }
    ).drop("__pos", "__sell_pos", "__last")


def observed_gates(bars: DataFrame) -> DataFrame:
    """Blocked flag and change against the previous observed close."""
    one_price = (F.col("open") == F.col("high")) & (F.col("open") == F.col("low")) & (F.col("open") == F.col("close"))
    blocked = F.coalesce(F.col("volume") <= 0, F.lit(True)) | F.coalesce(F.col("is_st"), F.lit(False)) | one_price
    previous = F.lag("close").over(by_symbol())
    return bars.withColumns({"blocked": blocked, "change": F.try_divide(F.col("close"), previous) - 1.0})


def trade_plans(events: DataFrame, series: DataFrame, horizons: tuple[int, ...], delay: int, seed: int) -> DataFrame:
    """Entry, scheduled exit, deadline and selection rank per event and horizon.

    ``series`` holds all bars with ``tradeable_open``; ``events`` are
    (rule_id, symbol, session).  Plans whose deadline lies past the series are
    marked ``tail_purged`` and carry no later date.
    """
    w = by_symbol()
    ahead = {"entry_at": F.lead("session", 1).over(w), "entry_open": F.lead("open", 1).over(w), "entry_tradeable": F.lead("tradeable_open", 1).over(w)}
    for h in horizons:
        ahead |= {f"__exit_{h}": F.lead("session", h).over(w), f"__dead_{h}": F.lead("session", h + delay).over(w)}
    legs = [
        F.struct(F.lit(h).alias("horizon"), F.col(f"__exit_{h}").alias("scheduled_exit"), F.col(f"__dead_{h}").alias("deadline"))
        for h in horizons
    ]
    rank = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("rule_id"), F.col("symbol"), F.col("session").cast("string")), 256)
    planned = (
        series.withColumns(ahead)
        .join(events.select("rule_id", "symbol", "session"), ["symbol", "session"])
        .withColumn("__leg", F.explode(F.array(*legs)))
        .select("rule_id", "symbol", F.col("session").alias("signal_at"), "entry_at", "entry_open", "entry_tradeable", "__leg.*", rank.alias("selection_rank"))
    )
    late = F.col("deadline").isNull()
    return planned.withColumns(
        {"tail_purged": late, "scheduled_exit": F.when(~late, F.col("scheduled_exit"))}
    )

"""Row checks, issue codes, admission and time boundaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.identity import row_identity
from tidemark.functions.numeric import finite

PRICES = ("open", "high", "low", "close")
#: Days whose rows share one digest in a content entry.
STRETCH_DAYS = 256


def _first(*cases: tuple[Column, str]) -> Column:
    chain = None
    for condition, code in cases:
        condition = F.coalesce(condition, F.lit(False))
        chain = F.when(condition, code) if chain is None else chain.when(condition, code)
    return chain


def _bounds_broken() -> Column:
    return (F.col("high") < F.greatest("open", "low", "close")) | (F.col("low") > F.least("open", "high", "close"))


# The issue codes and their priority, here and in ``row_issues``.
def numeric_issue() -> Column:
    """Column by column null / non_finite first, then signs, then bounds."""
    cases: list[tuple[Column, str]] = []
    for name in (*PRICES, "volume"):
        cases.append((F.col(name).isNull(), "null"))
        cases.append((finite(F.col(name)).isNull(), "non_finite"))
    cases += [(F.col(name) <= 0, "non_positive_price") for name in PRICES]
    cases += [(F.col("volume") < 0, "negative_volume"), (_bounds_broken(), "ohlc_bounds")]
    return _first(*cases)


def row_issues(rows: DataFrame, file: str = "symbol", row: str = "row_number") -> DataFrame:
    """One issue per row, by priority; NULL means clean.

    Order matters: a session is compared with that of the last earlier row of
    the file that had one.  A file may hold a third of all rows, so no window
    spans a whole file: rows fall into stretches of 65,536 row numbers, a
    window runs inside a stretch, and the last session of earlier stretches is
    looked up from a table of one row per stretch.  The input must carry a row
    number, as file order is not otherwise kept.
    """
    size = 1 << 16
    cut = rows.withColumn("__part", F.floor(F.col(row) / size))
    inside = Window.partitionBy(file, "__part").orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy(file, "__part").agg(F.max_by("session", F.when(F.col("session").isNotNull(), F.col(row))).alias("__end"))
    earlier = Window.partitionBy(file).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carries = ends.select(file, "__part", F.last("__end", ignorenulls=True).over(earlier).alias("__carry"))
    joined = cut.join(carries, [file, "__part"], "left")
    previous = F.coalesce(F.last("session", ignorenulls=True).over(inside), F.col("__carry"))
    joined = joined.withColumn("__previous", previous)
    code = (
        F.when(F.col("session").isNull(), "null")
        .when(F.col("session") == F.col("__previous"), "duplicate_session")
        .when(F.col("session") < F.col("__previous"), "non_monotonic_session")
        .otherwise(numeric_issue())
    )
    return joined.withColumn("issue_code", code).drop("__part", "__carry", "__previous")


def clean(audited: DataFrame) -> DataFrame:
    return audited.where(F.col("issue_code").isNull()).drop("issue_code")


def quarantine(audited: DataFrame) -> DataFrame:
    return audited.where(F.col("issue_code").isNotNull())


def campaign(audited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts per issue code, totals with the admission verdict)."""
    codes = quarantine(audited).groupBy("issue_code").agg(F.count(F.lit(1)).alias("issues"))
    totals = audited.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("symbol").alias("files"),
        F.count("issue_code").alias("issues"),
        F.coalesce(F.bool_and(F.col("issue_code").isNull()), F.lit(False)).alias("admitted"),
    )
    return codes, totals


def window_admission(audited: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Issues inside the window block; earlier ones are only excluded."""
    dirty = F.col("issue_code").isNotNull()
    inside = F.coalesce(F.col("session") >= F.lit(start), F.lit(True))
    chosen = ~dirty & F.col("session").between(F.lit(start), F.lit(end))
    out = audited.agg(
        F.count_if(dirty & inside).alias("blocking_issues"),
        F.count_if(dirty & ~inside).alias("excluded_issues"),
        F.count_if(chosen).alias("research_rows"),
        F.count_distinct(F.when(chosen, F.col("symbol"))).alias("research_files"),
    )
    ok = (F.col("blocking_issues") == 0) & (F.col("research_rows") > 0)
    return out.withColumn("status", F.when(ok, "eligible_for_content_snapshot").otherwise("blocked"))


def content_entries(rows: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Per symbol: selected rows, first and last session, content digest.

    The digest is a tree of two levels: the row hashes of a fixed stretch of days
    in session order, then the stretches in order.  With one clean row per session
    no list is longer than a stretch, nor than the stretches of the calendar.
    """
    chosen = rows.where(F.col("session").between(F.lit(start), F.lit(end)))
    hashed = chosen.withColumn("__hash", row_identity(chosen, ["symbol", "session", *PRICES, "volume"]))
    folded = lambda key, digest: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, digest))), lambda x: x[digest]), ","), 256)
    stretches = hashed.groupBy("symbol", F.floor(F.unix_date("session") / STRETCH_DAYS).alias("__stretch")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("session").alias("__first"), F.max("session").alias("__last"), folded("session", "__hash").alias("__part")
    )
    return stretches.groupBy("symbol").agg(
        F.sum("__n").alias("selected_rows"),
        F.min("__first").alias("min_session"),
        F.max("__last").alias("max_session"),
        F.concat(F.lit("sha256:"), folded("__stretch", "__part")).alias("content_hash"),
    )


# ---- domain checks ----------------------------------------------------------
def _codes(*cases: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), code) for c, code in cases]))


def tradability_issues() -> Column:
    f = F.col
    return _codes(
        (f("is_suspended") & (f("can_buy") | f("can_sell")), "suspended_but_tradable"),
        (f("is_limit_up") & f("can_buy"), "limit_up_but_buyable"),
        (f("is_limit_down") & f("can_sell"), "limit_down_but_sellable"),
        (f("is_limit_up") & f("is_limit_down"), "both_limits"),
        (f("is_suspended") & (f("is_limit_up") | f("is_limit_down")), "suspended_with_limit"),
    )


def constituent_issues() -> Column:
    f = F.col
    return _codes(
        (F.trim(f("index_symbol")) == "", "empty_index_symbol"),
        (F.trim(f("constituent_symbol")) == "", "empty_constituent_symbol"),
        (f("effective_from").isNull(), "missing_effective_from"),
        (f("effective_to") < f("effective_from"), "interval_reversed"),
    )


def market_issues() -> Column:
    return _codes(
        *[(F.col(n).isNull() | (F.col(n) <= 0), f"invalid_{n}") for n in PRICES],
        (F.col("volume").isNull() | (F.col("volume") < 0), "invalid_volume"),
        (_bounds_broken(), "ohlc_bounds"),
    )


def text_issues(*names: str) -> Column:
    return _codes(*[(F.col(n).isNull() | (F.trim(F.col(n)) == ""), f"empty_{n}") for n in names])


def pit_issues(zone: str = "Asia/Shanghai") -> Column:
    """Knowledge order and "effective only after the local knowledge date"."""
    f = F.col
    known = F.to_date(F.from_utc_timestamp(F.greatest("published_at", "available_at"), zone))
    return _codes(
        (f("published_at") > f("available_at"), "available_before_published"),
        (f("available_at") > f("ingested_at"), "ingested_before_available"),
        (f("effective_session") <= known, "effective_not_after_knowledge_date"),
    )


def previous_close_issues(rows: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Rows whose stated ``prev_close`` disagrees with the close before them."""
    w = Window.partitionBy("symbol").orderBy("session")
    before = F.lag("close").over(w)
    bound = F.greatest(F.lit(tolerance), F.abs(before) * tolerance)
    issue = (
        F.when(F.lag("session").over(w) == F.col("session"), "session_not_increasing")
        .when(before.isNotNull() & F.col("prev_close").isNull(), "prev_close_missing")
        .when(F.abs(F.col("prev_close") - before) > bound, "prev_close_inconsistent")
    )
    return rows.withColumn("issue", issue).where(F.col("issue").isNotNull())


def outcome_issues(rows: DataFrame, lockbox: dt.date, cost: float | None = None) -> DataFrame:
    """Order of dates, arithmetic and lockbox of each completed outcome row."""
    f = F.col
    cases = [
        (~((f("session") < f("entry_at")) & (f("entry_at") <= f("exit_at"))), "date_order"),
        (F.abs(f("net_excess_return") - (f("net_return") - f("benchmark_return"))) > 1e-12, "excess_arithmetic"),
        (F.greatest("session", "entry_at", "exit_at") >= F.lit(lockbox), "past_lockbox"),
    ]
    if cost is not None:
        cases.append((F.abs(f("raw_return") - f("net_return") - cost) > 1e-12, "cost_arithmetic"))
    return rows.withColumn("issues", _codes(*cases))


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Logical keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


# ---- strict contract --------------------------------------------------------
def strict_contract(rows: DataFrame) -> DataFrame:
    """Symbols that break the bar contract anywhere, with what they break.

    Every test is an aggregate with a partial step, repeated sessions included,
    so copies of one bar or one symbol never gather in a task.
    """
    bad_price = F.lit(False)
    for n in (*PRICES, "prev_close"):
        v = finite(F.col(n))
        bad_price = bad_price | v.isNull() | (v <= 0)
    bad_size = F.lit(False)
    for n in ("volume", "amount"):
        v = finite(F.col(n))
        bad_size = bad_size | v.isNull() | (v < 0)
    per_day = rows.groupBy("symbol", "session").agg(
        F.count(F.lit(1)).alias("__n"),
        F.bool_or(F.coalesce(bad_price, F.lit(True))).alias("__price"),
        F.bool_or(F.coalesce(bad_size, F.lit(True))).alias("__size"),
        F.bool_or(F.coalesce(_bounds_broken(), F.lit(False))).alias("__bounds"),
        F.bool_or(F.col("is_st").isNull()).alias("__st"),
    )
    out = per_day.groupBy("symbol").agg(
        F.bool_or(F.col("__n") > 1).alias("repeated_session"),
        F.bool_or("__price").alias("bad_price"),
        F.bool_or("__size").alias("bad_size"),
        F.bool_or("__bounds").alias("bad_bounds"),
        F.bool_or("__st").alias("bad_st"),
    )
    return out.where(F.col("repeated_session") | F.col("bad_price") | F.col("bad_size") | F.col("bad_bounds") | F.col("bad_st"))


def accepted(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    return rows.join(rejected.select("symbol"), "symbol", "left_anti")


# ---- time boundaries --------------------------------------------------------
def check_boundaries(start: dt.date, oos_start: dt.date, end: dt.date, lockbox: dt.date) -> None:
    if not start < oos_start <= end < lockbox:
        raise ValueError("dates must satisfy start < out-of-sample start <= end < lockbox")


def lockbox_status(rows: DataFrame, lockbox: dt.date | None, day: str = "session") -> DataFrame:
    """exploratory without a lockbox; contaminated once a row lies inside it."""
    if lockbox is None:
        return rows.agg(F.max(day).alias("last_session"), F.lit("exploratory").alias("status"))
    out = rows.agg(F.max(day).alias("last_session"))
    return out.withColumn("status", F.when(F.col("last_session") >= F.lit(lockbox), "contaminated").otherwise("sealed"))


def walk_forward(dates: DataFrame, train: int, test: int, purge: int, expanding: bool = True) -> DataFrame:
    """Fold bounds over sorted distinct dates; the last test part may be short.

    Fold i tests positions [train+purge+i*test, ...+test) and trains on
    [0, test start - purge), or on the last ``train`` of it when not expanding.
    Too few dates give no fold.  Dates are calendar days, so the ranking and the
    lookups stay small.
    """
    ranked = dates.select(F.col(dates.columns[0]).alias("day")).distinct().withColumn("ix", (F.row_number().over(Window.orderBy("day")) - 1).cast("long"))
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    last = F.col("n") - (train + purge)
    folds = n.where(F.col("n") >= train + purge + test).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((last - 1) / test))).alias("fold_id"), "n"
    )
    start = F.lit(train + purge) + F.col("fold_id") * test
    bounds = folds.select(
        "fold_id",
        # least() keeps the key an expression: a constant would plan a nested loop
        (F.least(F.lit(0).cast("long"), F.col("fold_id")) if expanding else start - purge - train).alias("train_from"),
        (start - purge - 1).alias("train_to"),
        start.alias("test_from"),
        (F.least(start + test, F.col("n")) - 1).alias("test_to"),
    )
    out = bounds
    for edge in ("train_from", "train_to", "test_from", "test_to"):
        day = edge.replace("_from", "_start").replace("_to", "_end")
        out = out.join(F.broadcast(ranked.select(F.col("ix").alias(edge), F.col("day").alias(day))), edge)
    return out.select("fold_id", "train_from", "train_to", "test_from", "test_to", "train_start", "train_end", "test_start", "test_end")


def label_folds(events: DataFrame, folds: DataFrame, day: str = "session") -> DataFrame:
    """Each event once per fold it belongs to, as train or test.

    The fold table (at most one row per test block of the calendar) rides along
    as one array value and is filtered per row; no range join is planned.
    """
    packed = folds.agg(F.array_sort(F.collect_list(F.struct("fold_id", "train_start", "train_end", "test_start", "test_end"))).alias("f"))
    d = F.col(day)
    both = F.filter(
        F.col("__folds"),
        lambda f: d.between(f["train_start"], f["train_end"]) | d.between(f["test_start"], f["test_end"]),
    )
    return (
        events.withColumn("__folds", packed.scalar())
        .withColumn("__fold", F.explode(both))
        .withColumns({"fold_id": F.col("__fold.fold_id"), "role": F.when(d.between(F.col("__fold.test_start"), F.col("__fold.test_end")), "test").otherwise("train")})
        .drop("__folds", "__fold")
    )

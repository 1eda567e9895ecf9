"""Point-in-time records: effective sessions, revisions, daily tradability."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKET_ZONE = "Asia/Shanghai"
PARTITIONS = 200  # up to this number Spark's shuffle writes rows without holding them
PARTITION_ROWS = 250_000
SPREAD = 16


def next_session_table(calendar: DataFrame) -> DataFrame:
    """(day, next_session) for every calendar day up to the last session.

    Turns "first session strictly after a day" into an equi join.  One row per
    calendar day, so the table is bounded whatever the data.
    """
    days = calendar.select("session").distinct()
    upcoming = F.lead("session").over(Window.orderBy("session"))
    spans = days.select("session", upcoming.alias("next_session")).where(F.col("next_session").isNotNull())
    return spans.select(F.explode(F.sequence("session", F.date_sub("next_session", 1))).alias("day"), "next_session")


def effective_session(records: DataFrame, calendar: DataFrame, zone: str = MARKET_ZONE) -> DataFrame:
    """First session strictly after the local date of max(published, available).

    Knowledge before the first session maps to that session; NULL when the
    calendar ends first.
    """
    first = calendar.agg(F.min("session").alias("s"))
    known = F.to_date(F.from_utc_timestamp(F.greatest("published_at", "available_at"), zone))
    table = next_session_table(calendar)
    marked = records.withColumns({"__known": known, "__first": first.scalar()})
    joined = marked.join(F.broadcast(table), F.col("__known") == F.col("day"), "left")
    return joined.withColumn(
        "effective_session", F.when(F.col("__known") < F.col("__first"), F.col("__first")).otherwise(F.col("next_session"))
    ).drop("__known", "__first", "day", "next_session")


def _copies_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of an Arrow batch as one, with their number; holds one batch at a time."""
    for batch in batches:
        counted = pa.Table.from_batches([batch]).group_by(batch.schema.names, use_threads=False).aggregate([([], "count_all")])
        yield from counted.rename_columns([*batch.schema.names, "copies"]).to_batches()


def revision_conflicts(records: DataFrame) -> DataFrame:
    """Revisions with several contents, and identities that occur twice.

    Nearly every identity stands once, so a map-side aggregate would hold a whole
    split: copies are folded inside Arrow batches instead. Contents are counted in
    ``SPREAD`` parts of a revision, so one that holds most rows is spread over tasks
    and reaches the second exchange as ``SPREAD`` rows at most. The number of
    partitions follows from a count of the rows, because partitions joined by their
    compressed bytes hold many times as much in memory.
    """
    key = ["source", "source_record_id", "revision_id"]
    rows = records.select(*key, "content_hash")
    folded = rows.mapInArrow(_copies_of_batch, T.StructType([*rows.schema.fields, T.StructField("copies", T.LongType())]))
    tasks = min(PARTITIONS, 1 + rows.count() // PARTITION_ROWS)
    spread = folded.withColumn("part", F.pmod(F.xxhash64("content_hash"), F.lit(SPREAD))).repartition(tasks, *key, "part")
    contents = spread.groupBy(*key, "part", "content_hash").agg(F.sum("copies").alias("copies"))
    parts = contents.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("contents"), F.max("copies").alias("most_copies"))
    out = parts.repartition(tasks, *key).groupBy(*key).agg(F.sum("contents").alias("contents"), F.max("most_copies").alias("most_copies"))
    issue = F.when(F.col("contents") > 1, "conflicting_content").when(F.col("most_copies") > 1, "duplicate_identity")
    return out.withColumn("issue", issue).where(F.col("issue").isNotNull())


def latest_visible(records: DataFrame, as_of, key: tuple[str, ...] = ("source", "source_record_id")) -> DataFrame:
    """The newest revision known at ``as_of`` for each record.

    An aggregate by (available_at, revision_id), so revisions of one record are
    folded in the map tasks and never sorted together.
    """
    seen = records.where(F.col("available_at") <= as_of)
    rest = [c for c in records.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct("available_at", "revision_id"))
    return seen.groupBy(*key).agg(newest.alias("r")).select(*key, "r.*")


def daily_tradability(
    calendar: DataFrame,
    suspension: DataFrame,
    st: DataFrame,
    listing: DataFrame,
    observation: DataFrame,
    limits: DataFrame,
    zone: str = MARKET_ZONE,
) -> DataFrame:
    """Six evidence domains per (symbol, session) to buy/sell flags and reasons.

    Every input carries ``available_at``; a row counts only if known by 09:30
    local time of the session.  All six must be present.  Sessions are read as
    UTC dates (the session time zone every plan assumes).
    """
    cut = F.to_utc_timestamp(F.col("session").cast("timestamp") + F.expr("INTERVAL 570 MINUTES"), zone)

    def known(df: DataFrame, *values: str) -> DataFrame:
        keys = [k for k in ("symbol", "session") if k in df.columns]
        return df.where(F.col("available_at") <= cut).select(*keys, *values)

    rows = known(observation, "open_price")
    for df, values in ((limits, ["up_limit", "down_limit"]), (suspension, ["is_suspended"]), (st, ["is_st"]), (listing, ["is_listed"])):
        rows = rows.join(known(df, *values), ["symbol", "session"])
    rows = rows.join(F.broadcast(known(calendar, "is_open")), "session")  # one row per day
    live = F.col("is_open") & F.col("is_listed") & ~F.col("is_suspended")
    why = F.array_sort(
        F.array_compact(
            F.array(
                F.when(F.col("is_listed"), "listed").otherwise("not_listed"),
                F.when(F.col("is_st"), "st"),
                F.when(F.col("is_suspended"), "suspended"),
                F.when(~F.col("is_open"), "market_closed"),
                F.when(live & (F.col("open_price") == F.col("up_limit")), "at_up_limit"),
                F.when(live & (F.col("open_price") == F.col("down_limit")), "at_down_limit"),
            )
        )
    )
    return rows.withColumns(
        {
            "can_buy_open": live & (F.col("open_price") < F.col("up_limit")),
            "can_sell_open": live & (F.col("open_price") > F.col("down_limit")),
            "reason_codes": why,
        }
    )


def replacements(issues: DataFrame, rows: DataFrame) -> DataFrame:
    """Clean rows of a different source for the symbol and session of an issue."""
    other = rows.select("symbol", "session", F.col("source_id").alias("replacement_source"), F.col("row_hash").alias("replacement_hash"))
    dated = issues.where(F.col("session").isNotNull())
    return dated.join(other, ["symbol", "session"]).where(F.col("replacement_source") != F.col("source_id"))


def known_logic(candidates: DataFrame, history: DataFrame, key: str = "logic_hash") -> tuple[DataFrame, DataFrame]:
    """(candidates whose logic is new, candidates already on record)."""
    known = history.select(key).distinct()
    return candidates.join(known, key, "left_anti"), candidates.join(known, key, "left_semi")

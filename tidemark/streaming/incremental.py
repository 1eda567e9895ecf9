"""The event study on bars that keep arriving.

Arrived bars are held until the newest session seen is ``late_days`` past
theirs; only then do they join their symbols' series, in session order.  So how
files fall into batches, and in which order they come, changes nothing within
that time.  Released bars run through the same operators as the batch study, and
the outcomes whose exit bar was released are appended once their benchmark is
known.  Everything the next batch needs lives in tables under one folder of
shared storage::

    clock/batch=<id>     newest session seen
    held/batch=<id>      bars that wait for their session to close
    tail/batch=<id>      last released bars of every symbol (the state)
    arrived, work, matured/batch=<id>  what a batch reads more than once
    waiting/batch=<id>   matured outcomes whose benchmark isn't known yet
    outcomes/batch=<id>  outcomes that matured in the batch
    rejects/batch=<id>   late or repeated bars with the reason

A batch only reads the state of the batch before it and overwrites its own
folders, so a batch replayed after a failure gives the same tables: every
(rule, symbol, date, horizon) is emitted once.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import outcomes as oc
from tidemark.operators import stats
from tidemark.operators.events import unite
from tidemark.operators.indicators import RECURSIVE
from tidemark.operators.intervals import active
from tidemark.operators.rules import Rule
from tidemark.operators.series import by_symbol
from tidemark.operators.signals import leaves, lookback, matches, prepare

BAR_SCHEMA = (
    "symbol string, session date, open double, high double, low double, close double, volume double, amount double, is_st boolean, available_at timestamp"
)
KEY = ["rule_id", "symbol", "session", "horizon"]
MIN_EVENTS = 100


@dataclass
class FutureRun:
    """One rule followed through incoming bars."""

    rule: Rule
    benchmark: DataFrame
    memberships: DataFrame
    root: str
    study: oc.Study = field(default_factory=oc.Study)
    late_days: int = 40

    @property
    def tail_bars(self) -> int | None:
        """Bars to keep per symbol; None (all) for indicators that never forget."""
        if any(op == "metric" and body["name"] in RECURSIVE for op, body in leaves(self.rule.condition)):
            return None
        return lookback(self.rule) + max(self.study.horizons) + 1

    def start(self, bars: DataFrame, checkpoint: str) -> StreamingQuery:
        """Consume what is there and stop; call again for what comes later."""
        return (
            bars.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    # -- one micro-batch ------------------------------------------------------
    def process(self, batch: DataFrame, batch_id: int) -> None:
        self._step(batch, batch_id, final=False)

    def finish(self, spark: SparkSession) -> None:
        """No more bars will come: release what is held."""
        newest = spark.read.parquet(f"{self.root}/clock").agg(F.max("batch")).first()[0]
        self._step(spark.createDataFrame([], BAR_SCHEMA), newest + 1, final=True)

    def _step(self, batch: DataFrame, batch_id: int, final: bool) -> None:
        spark = batch.sparkSession
        old = self._read(spark, "tail", batch_id - 1)
        arrived, rejects = self._arrive(batch, old, self._read(spark, "held", batch_id - 1))
        self._write(rejects, "rejects", batch_id)
        self._write(arrived, "arrived", batch_id)
        arrived = self._read(spark, "arrived", batch_id)
        sessions = arrived.select("session") if old is None else arrived.select("session").union(old.select("session"))
        self._write(sessions.agg(F.max("session").alias("seen")), "clock", batch_id)
        seen = self._read(spark, "clock", batch_id)
        open_ = F.lit(False) if final else F.col("session") > F.date_sub(seen.scalar(), self.late_days)
        self._write(arrived.where(open_), "held", batch_id)
        fresh = self._release(arrived.where(~open_), old)
        work = fresh if old is None else unite(old.withColumn("is_new", F.lit(False)), fresh)
        self._write(work, "work", batch_id)
        work = self._read(spark, "work", batch_id)
        self._write(self._trim(work), "tail", batch_id)
        matured = self._matured(work)
        waiting = self._read(spark, "waiting", batch_id - 1)
        if waiting is not None:
            matured = matured.unionByName(oc.benchmark_return(waiting.drop("benchmark_return"), self.benchmark).select(*matured.columns))
        self._write(matured, "matured", batch_id)
        matured = self._read(spark, "matured", batch_id)
        known = F.col("benchmark_return").isNotNull()
        self._write(matured.where(~known), "waiting", batch_id)
        self._write(self._completed(matured.where(known)), "outcomes", batch_id)

    def _arrive(self, batch: DataFrame, old: DataFrame | None, held: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Bars that wait or may be released, and the bars turned away.

        Copies fold in an aggregate; what was held before wins over what comes
        now.  A bar at or before its symbol's last released session is late.
        """
        rest = [c for c in batch.columns if c not in ("symbol", "session")]
        rows = batch.withColumn("__new", F.lit(1))
        if held is not None:
            rows = rows.unionByName(held.withColumn("__new", F.lit(0)))
        once = rows.groupBy("symbol", "session").agg(
            F.min_by(F.struct(*rest), F.struct("__new", *rest)).alias("r"), F.sum("__new").alias("came"), F.min("__new").alias("__new")
        )
        once = once.select("symbol", "session", "r.*", "came", "__new")
        if old is None:
            joined = once.withColumns({"__last": F.lit(None).cast("date"), "__known": F.lit(False)})
        else:
            heads = old.groupBy("symbol").agg(F.max("session").alias("__last"))
            known = old.select("symbol", "session", F.lit(True).alias("__known"))
            joined = once.join(heads, "symbol", "left").join(known, ["symbol", "session"], "left")
        late = F.coalesce(F.col("session") <= F.col("__last"), F.lit(False))
        extra = F.col("came") - F.when(late, 0).otherwise(F.col("__new"))
        reason = F.when(late & ~F.coalesce("__known", F.lit(False)), "out_of_order").otherwise("repeated_session")
        turned = joined.withColumn("rows", extra).where("rows > 0").select("symbol", "session", reason.alias("reason"), "rows")
        return joined.where(~late).select(*batch.columns), turned

    def _release(self, bars: DataFrame, old: DataFrame | None) -> DataFrame:
        """Closed bars numbered on from the state.

        Membership is asked once, when the bar joins its series, and stays with it.
        """
        if old is None:
            joined = bars.withColumns({"__ix": F.lit(-1).cast("long"), "__close": F.lit(None).cast("double")})
        else:
            heads = old.groupBy("symbol").agg(F.max(F.struct("bar_ix", "close")).alias("h"))
            heads = heads.select("symbol", F.col("h.bar_ix").alias("__ix"), F.col("h.close").alias("__close"))
            joined = bars.join(heads, "symbol", "left").withColumn("__ix", F.coalesce("__ix", F.lit(-1)))
        order = by_symbol()
        fresh = joined.withColumns(
            {
                "bar_ix": F.col("__ix") + F.row_number().over(order),
                "prev_close": F.coalesce(F.lag("close").over(order), F.col("__close")),
                "is_new": F.lit(True),
            }
        )
        return active(fresh.drop("__ix", "__close"), self.memberships)

    def _trim(self, work: DataFrame) -> DataFrame:
        rows = work.drop("is_new")
        if self.tail_bars is None:
            return rows
        last = F.max("bar_ix").over(Window.partitionBy("symbol"))
        return rows.withColumn("__last", last).where(F.col("bar_ix") > F.col("__last") - self.tail_bars).drop("__last")

    def _matured(self, work: DataFrame) -> DataFrame:
        """Outcomes whose exit bar is one of the new bars, with or without benchmark."""
        keep = work.columns
        flagged = prepare(work, [self.rule]).withColumn("is_signal", matches(self.rule)).select(*keep, "is_signal")
        first_new = F.min(F.when(F.col("is_new"), F.col("bar_ix"))).over(Window.partitionBy("symbol"))
        flagged = flagged.withColumn("first_new", first_new)
        rows = oc.outcomes(flagged, self.benchmark, self.study, where=F.col("is_signal") & F.col("is_member"))
        matured = rows.where(F.col("bar_ix") + F.col("horizon") >= F.col("first_new"))
        return matured.select("symbol", "session", "bar_ix", "entry_at", "exit_at", "horizon", "net_return", "benchmark_return")

    def _completed(self, matured: DataFrame) -> DataFrame:
        return matured.select(
            F.lit(self.rule.id).alias("rule_id"), "symbol", "session", "bar_ix", "entry_at", "exit_at", "horizon", F.lit("completed").alias("status"),
            "net_return", "benchmark_return", (F.col("net_return") - F.col("benchmark_return")).alias("excess_return"), F.lit(self.study.round_trip).alias("cost_round_trip"),
        )

    # -- tables ---------------------------------------------------------------
    def _write(self, df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={batch_id}")

    def _read(self, spark: SparkSession, table: str, batch_id: int) -> DataFrame | None:
        return None if batch_id < 0 else spark.read.parquet(f"{self.root}/{table}/batch={batch_id}")

    def outcomes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/outcomes")

    def rejects(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/rejects")

    def last_tail(self, spark: SparkSession) -> DataFrame:
        """State after the newest batch (the highest batch folder)."""
        tails = spark.read.parquet(f"{self.root}/tail")
        newest = tails.agg(F.max("batch").alias("b"))
        return tails.where(F.col("batch") == newest.scalar()).drop("batch")

    def tail_purged(self, spark: SparkSession) -> DataFrame:
        """End of the window: signals whose exit never came, per horizon.

        The kept tail reaches back over the longest horizon, so every immature
        signal is in it.
        """
        tail = self.last_tail(spark)
        last = F.max("bar_ix").over(Window.partitionBy("symbol"))
        flagged = prepare(tail, [self.rule]).withColumns({"is_signal": matches(self.rule), "__last": last})
        legs = flagged.where("is_signal and is_member").withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in self.study.horizons])))
        return legs.where(F.col("bar_ix") + F.col("horizon") > F.col("__last")).select(
            F.lit(self.rule.id).alias("rule_id"), "symbol", "session", "horizon", F.lit("tail_purged").alias("status")
        )


def read_bar_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Bar files as a stream.  What is late is decided by ``FutureRun``, against its own tables."""
    return spark.readStream.schema(BAR_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_once(existing: DataFrame, rows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Rows whose logical key is not committed yet, each key once.

    Copies of a key fold in an aggregate before the anti join.
    """
    rest = [c for c in rows.columns if c not in key]
    once = rows.groupBy(*key).agg(F.any_value(F.struct(*rest)).alias("r")).select(*key, "r.*")
    return once.join(existing.select(*key), key, "left_anti")


def run_status(committed: DataFrame, calendar: DataFrame, start: dt.date, end: dt.date, as_of: dt.date, horizon: int) -> DataFrame:
    """waiting / accumulating_not_adjudicable / eligible_for_adjudication.

    A date of the window counts as committed once ``horizon`` further sessions
    exist, or when the window is over.
    """
    days = calendar.select("session").distinct()
    known = days.where(F.col("session") <= F.lit(min(as_of, end)))
    order = Window.orderBy("session")  # one row per session
    numbered = known.withColumns({"later": F.count(F.lit(1)).over(order.rowsBetween(1, Window.unboundedFollowing))})
    inside = numbered.where(F.col("session") >= F.lit(start))
    over = F.lit(as_of >= end)
    counts = inside.agg(
        F.count(F.lit(1)).alias("window_dates"), F.count_if((F.col("later") >= horizon) | over).alias("committed_dates")
    )
    events = committed.where(F.col("session").between(F.lit(start), F.lit(end))).agg(F.count(F.lit(1)).alias("n"))
    status = (
        F.when(F.lit(as_of < start), "waiting")
        .when(over & (F.col("committed_dates") == F.col("window_dates")), "eligible_for_adjudication")
        .otherwise("accumulating_not_adjudicable")
    )
    return counts.withColumns({"events": events.scalar(), "status": status})


def adjudicate(committed: DataFrame, horizons: tuple[int, ...], multiple: float = 2.0, alpha: float = 0.05) -> DataFrame:
    """Dated tests of the accumulated events, and the same under doubled cost.

    Groups under MIN_EVENTS events stay in both families with p = 1.
    """
    by = ["rule_id", "horizon"]

    def tests(rows: DataFrame, value: str, prefix: str) -> DataFrame:
        sized = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("events"))
        daily = stats.daily_effects(rows, by=by, value=value)
        h = stats.hac(daily, by=by, max_lag=max(horizons))
        out = sized.join(h, by)
        few = F.col("events") < MIN_EVENTS
        for name in ("effect", "standard_error", "ci_lower", "ci_upper"):
            out = out.withColumn(name, F.when(~few, F.col(name)))
        out = out.withColumns(
            {
                "evidence_status": F.when(few, "insufficient_events").otherwise(F.col("evidence_status")),
                "raw_p_value": F.when(few, 1.0).otherwise(F.col("raw_p_value")),
            }
        )
        out = stats.false_discovery(out, alpha=alpha)
        return out if not prefix else out.select(*by, *[F.col(c).alias(prefix + c) for c in ("effect", "raw_p_value", "adjusted_p_value", "multiple_testing_reject")])

    stressed = committed.withColumn("__stressed", F.col("excess_return") - (multiple - 1.0) * F.col("cost_round_trip"))
    return tests(committed, "excess_return", "").join(tests(stressed, "__stressed", "stress_"), by)

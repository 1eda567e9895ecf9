"""Operators on sets of events: rows (rule_id, symbol, session, bar_ix)."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import stage


def cooldown(events: DataFrame, bars: int = 20, by: tuple[str, ...] = ("rule_id", "symbol")) -> DataFrame:
    """Keep an event only if it lies ``bars`` or more after the last kept one.

    The greedy choice folds over the sorted distinct positions of one rule and
    symbol.  Positions are bars of one daily series, so the set is at most
    MAX_SESSIONS longs however often an event is repeated in the input.
    """
    kept = F.aggregate(
        F.array_sort(F.collect_set("bar_ix")),
        F.array().cast("array<bigint>"),
        lambda acc, x: F.when(F.try_element_at(acc, F.lit(-1)).isNull(), F.array(x)).when(
            x - F.try_element_at(acc, F.lit(-1)) >= bars, F.concat(acc, F.array(x))
        ).otherwise(acc),
    )
    return events.groupBy(*by).agg(kept.alias("k")).select(*by, F.explode("k").alias("bar_ix"))


def wide(events: DataFrame, rules: list[str]) -> DataFrame:
    """One row per (symbol, bar_ix) with a 0/1 column ``m_<i>`` per rule."""
    marks = [F.max(F.when(F.col("rule_id") == r, 1).otherwise(0)).alias(f"m_{i}") for i, r in enumerate(rules)]
    return events.groupBy("symbol", "bar_ix").agg(*marks)


def overlap(events: DataFrame, rules: list[str], proximity: int = 5) -> DataFrame:
    """Overlap of every pair of the given rules, exact and within some bars.

    No self join and no pairs of events: rules become columns, one range window
    marks nearby events, and a single aggregation counts every pair.  Meant for
    a short list of rules (the columns grow with its square).
    """
    near = Window.partitionBy("symbol").orderBy("bar_ix").rangeBetween(-proximity, proximity)
    table = wide(events, rules)
    table = table.withColumns({f"n_{i}": F.max(f"m_{i}").over(near) for i in range(len(rules))})
    sums: list[Column] = [F.sum(f"m_{i}").alias(f"c_{i}") for i in range(len(rules))]
    pairs = list(combinations(range(len(rules)), 2))
    for i, j in pairs:
        sums += [
            F.sum(F.col(f"m_{i}") * F.col(f"m_{j}")).alias(f"both_{i}_{j}"),
            F.sum(F.col(f"m_{i}") * F.col(f"n_{j}")).alias(f"near_{i}_{j}"),
            F.sum(F.col(f"m_{j}") * F.col(f"n_{i}")).alias(f"near_{j}_{i}"),
        ]
    totals = table.agg(*sums)

    def entry(i: int, j: int) -> Column:
        zero = F.lit(0).cast("long")
        get = lambda name: F.coalesce(F.col(name), zero)
        return F.struct(
            F.lit(rules[i]).alias("left_rule"), F.lit(rules[j]).alias("right_rule"),
            get(f"c_{i}").alias("left_events"), get(f"c_{j}").alias("right_events"), get(f"both_{i}_{j}").alias("shared"),
            get(f"near_{i}_{j}").alias("__nl"), get(f"near_{j}_{i}").alias("__nr"),
        )

    rows = totals.select(F.explode(F.array(*[entry(i, j) for i, j in pairs])).alias("p")).select("p.*")
    l, r, s = F.col("left_events"), F.col("right_events"), F.col("shared")
    union = l + r - s
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return rows.select(
        "left_rule", "right_rule", "left_events", "right_events", "shared",
        F.when(union > 0, s / union).otherwise(1.0).alias("jaccard"),
        share(s, l).alias("left_contained"), share(s, r).alias("right_contained"),
        share(l - s, l).alias("left_unique"), share(r - s, r).alias("right_unique"),
        share(F.col("__nl"), l).alias("left_near"), share(F.col("__nr"), r).alias("right_near"),
    )


def mean_uniqueness(overlaps: DataFrame) -> DataFrame:
    """Average unique share of each rule over all its pairs."""
    sides = F.array(
        F.struct(F.col("left_rule").alias("rule_id"), F.col("left_unique").alias("u")),
        F.struct(F.col("right_rule").alias("rule_id"), F.col("right_unique").alias("u")),
    )
    return overlaps.select(F.explode(sides).alias("s")).groupBy("s.rule_id").agg(F.avg("s.u").alias("mean_unique_event_fraction"))


def near(left: DataFrame, right: DataFrame, proximity: int = 5) -> DataFrame:
    """Left events with a right event of the same symbol within some bars.

    Band join as equi join on (symbol, bucket): each right event is listed in
    its own and the two neighbouring buckets, so a left event meets a bounded
    number of rows and nothing depends on the size of a symbol.
    """
    width = max(proximity, 1)
    bucket = F.floor(F.col("bar_ix") / width)
    l = left.withColumn("__b", bucket)
    r = right.select(
        F.col("symbol").alias("__s"), F.col("bar_ix").alias("__ix"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__rb")
    ).distinct()
    hit = (l["symbol"] == F.col("__s")) & (l["__b"] == F.col("__rb")) & (F.abs(l["bar_ix"] - F.col("__ix")) <= proximity)
    return l.join(r, hit, "left_semi").drop("__b")


# ---- many rules -------------------------------------------------------------
def cooccurrence(scanned: DataFrame, rules: int) -> DataFrame:
    """How often each pair of rules matched the same bar: rows (i, j, n), i <= j.

    ``scanned`` carries ``matched`` arrays.  Each batch becomes a 0/1 matrix X
    and adds X'X to the task's running sum, so a task emits at most rules^2 rows
    however many bars it reads; pairs are never listed per bar.
    """

    def count(batches):
        total = np.zeros((rules, rules))
        for pdf in batches:
            lengths = pdf["matched"].map(len).to_numpy()
            if not lengths.sum():
                continue
            x = np.zeros((len(pdf), rules), dtype=np.float32)
            x[np.repeat(np.arange(len(pdf)), lengths), np.concatenate(pdf["matched"].to_numpy()).astype(int)] = 1.0
            total += x.T @ x
        i, j = np.nonzero(np.triu(total))
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "n": total[i, j].astype("int64")})

    part = scanned.select("matched").mapInPandas(count, "i int, j int, n long")
    return part.groupBy("i", "j").agg(F.sum("n").alias("n"))


def jaccard_pairs(pairs: DataFrame) -> DataFrame:
    """(i, j, jaccard) for the pairs that share at least one bar."""
    own = pairs.where("i = j").select("i", F.col("n").alias("own"))
    a = own.select("i", F.col("own").alias("__a"))
    b = own.select(F.col("i").alias("j"), F.col("own").alias("__b"))
    return (
        pairs.where("i < j").join(a, "i").join(b, "j").select("i", "j", (F.col("n") / (F.col("__a") + F.col("__b") - F.col("n"))).alias("jaccard"))
    )


def drop_near_duplicates(similar: dict[tuple[int, int], float], ranked: list[int], threshold: float = 0.85) -> dict[int, int]:
    """Cluster of each rule, best first; a rule joins its most similar kept one.

    Works on the collected pair table: one entry per pair of rules of the run.
    """
    cluster: dict[int, int] = {}
    kept: list[int] = []
    for rule in ranked:
        scores = [(similar.get((min(rule, k), max(rule, k)), 0.0), -n, k) for n, k in enumerate(kept)]
        best = max(scores, default=(0.0, 0, -1))
        if kept and best[0] >= threshold:
            cluster[rule] = cluster[best[2]]
        else:
            cluster[rule] = len(kept)
            kept.append(rule)
    return cluster


# ---- choices ----------------------------------------------------------------
def audit_sample(rows: DataFrame, identity: Column, k: int, by: list[str] | None = None) -> DataFrame:
    """The k rows with the smallest content hash, overall or per group."""
    hashed = rows.withColumn("row_hash", identity)
    if not by:
        return hashed.orderBy("row_hash").limit(k)
    order = Window.partitionBy(*by).orderBy("row_hash")
    return hashed.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")


def next_symbols(bars: DataFrame, first: Column, last: Column, taken: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(chosen symbols in order, all symbols with their exclusion reason).

    A symbol must reach over [first, last] and not be taken already.
    """
    spans = bars.groupBy("symbol").agg(F.min("session").alias("min_session"), F.max("session").alias("max_session"), F.count(F.lit(1)).alias("bars"))
    marked = spans.join(taken.select("symbol", F.lit(True).alias("__taken")), "symbol", "left")
    reason = (
        F.when(F.col("__taken"), "already_selected")
        .when(F.col("min_session") > first, "starts_late")
        .when(F.col("max_session") < last, "ends_early")
    )
    judged = marked.withColumn("reason", reason).drop("__taken")
    return judged.where(F.col("reason").isNull()).orderBy("symbol").limit(n), judged


def same_day_selection(plans: DataFrame, k: int) -> DataFrame:
    """At most k tradeable plans per rule, horizon and entry date.

    Rejected plans stay with ``entry_untradeable`` or ``max_positions``.  The
    k best come first out of a rank that Spark prunes per task, then mark the
    rest by key, so a day holding most plans is never sorted as a whole.
    """
    key = ["rule_id", "horizon", "entry_at"]
    plans = stage(plans, "plans")  # read twice below
    open_plans = plans.where("entry_tradeable")
    order = Window.partitionBy(*key).orderBy("selection_rank", "symbol")
    best = open_plans.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k)
    cut = best.groupBy(*key).agg(F.max(F.struct("selection_rank", "symbol")).alias("__cut"))
    out = plans.join(cut, key, "left")
    decision = (
        F.when(~F.col("entry_tradeable"), "entry_untradeable")
        .when(F.struct("selection_rank", "symbol") > F.col("__cut"), "max_positions")
        .otherwise("selected")
    )
    return out.withColumn("decision", decision).drop("__cut")


def top_rules(verdict: DataFrame, n: int = 10) -> DataFrame:
    return verdict.where(F.col("status") == "passed_screen").orderBy(F.desc("best_mean"), "rule_id").limit(n)


def weekly_top(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Top-k symbols for the first session of each ISO week, by the scores of
    the session before it.

    The session calendar is one row per day; the rank per session is pruned to
    k rows per task before the exchange.
    """
    days = scores.select("session").distinct()
    order = Window.orderBy("session")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("session")).cast("string"), F.lit("-"), F.lpad(F.weekofyear("session").cast("string"), 2, "0"))
    days = days.withColumns({"iso_week": week, "score_session": F.lag("session").over(order)})
    first = days.groupBy("iso_week").agg(F.min(F.struct("session", "score_session")).alias("f"))
    rebalances = first.select("iso_week", F.col("f.session").alias("trade_session"), F.col("f.score_session").alias("session")).where(F.col("session").isNotNull())
    rank = Window.partitionBy("session").orderBy(F.desc(score), "symbol")
    best = scores.where(F.col(score).isNotNull()).withColumn("position", F.row_number().over(rank)).where(F.col("position") <= k)
    return best.join(F.broadcast(rebalances), "session").select(
        "iso_week", "trade_session", F.col("session").alias("score_session"), "symbol", score, "position"
    )


def unite(*sets: DataFrame) -> DataFrame:
    """Union with missing columns as NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)

"""Places of rows in a global order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import stage

_TIES = 4096


def ordered(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """The rows dealt over tasks and sorted by the columns ``by`` (NULLs first), written once.

    ``__part`` and ``__row`` tell the place: parts ascend, rows ascend inside a
    part. Equal rows may lie in several parts, so a crowd of them is no hot part.
    The table is written before anything counts on the places, so a lost executor
    can't change them.
    """
    tied = df.withColumn("__tie", F.pmod(F.monotonically_increasing_id(), F.lit(_TIES)))
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in [*by, "__tie"]]
    placed = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie").withColumn("__at", F.monotonically_increasing_id())
    placed = placed.withColumns({"__part": F.shiftright("__at", 33).cast("int"), "__row": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    return stage(placed.drop("__at"), label)


def running(rows: DataFrame, group: str, before: dict[str, Column], whole: dict[str, Column]) -> DataFrame:
    """Running sums and whole-group values over rows that ``ordered`` placed.

    ``before``: name -> long column; ``__name`` is its sum over the group's earlier
    rows, ``__total_name`` over the whole group. ``whole``: name -> column, of which
    ``__name`` is the group's largest value. A window covers one group inside one
    part; what other parts add comes from a table of the groups that span several
    parts, at most two rows a part, which is broadcast.
    """
    totals = [F.sum(c).alias(f"__s_{k}") for k, c in before.items()] + [F.max(c).alias(f"__m_{k}") for k, c in whole.items()]
    parts = rows.groupBy(group, "__part").agg(*totals)
    inside = Window.partitionBy(group, "__part")
    earlier = inside.orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"__b_{k}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for k, c in before.items()})
    rows = rows.withColumns({f"__t_{k}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in before.items()} | {f"__w_{k}": F.max(c).over(inside) for k, c in whole.items()})

    all_parts = Window.partitionBy(group)
    up_to = all_parts.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    spans = parts.withColumn("__parts", F.count(F.lit(1)).over(all_parts)).filter("__parts > 1")
    spans = spans.select(
        F.col(group).alias("__g"),
        F.col("__part").alias("__p"),
        *[F.coalesce(F.sum(f"__s_{k}").over(up_to), F.lit(0)).alias(f"__x_{k}") for k in before],
        *[F.max(f"__m_{k}").over(all_parts).alias(f"__y_{k}") for k in whole],
        *[F.sum(f"__s_{k}").over(all_parts).alias(f"__z_{k}") for k in before],
    )
    joined = rows.join(F.broadcast(spans), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")), "left")
    known = F.col("__p").isNotNull()
    out = {k: F.col(f"__b_{k}") + F.coalesce(f"__x_{k}", F.lit(0)) for k in before}
    out |= {f"total_{k}": F.coalesce(f"__z_{k}", f"__t_{k}") for k in before}
    out |= {k: F.when(known, F.col(f"__y_{k}")).otherwise(F.col(f"__w_{k}")) for k in whole}
    kept = [c for c in rows.columns if not c.startswith(("__b_", "__t_", "__w_", "__part", "__row"))]
    return joined.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(f"__{k}") for k, c in out.items()])

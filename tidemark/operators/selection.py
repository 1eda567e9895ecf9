"""Exact order statistics of many groups at once, without listing or sorting a group.

The 64 bits of a double, read as a signed number in which negative values are turned
round, sort as the double does.  The wanted value is found sixteen bits at a time: a
histogram of the next sixteen over the rows that share the group's prefix so far,
folded in the map tasks, tells the next ones and how many rows lie before them.  Four
histograms fix all bits.  A task holds at most one histogram (65,536 rows) of a group,
however large the group is, and the rows are counted by value once: the four rounds
read that one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT, ROUNDS = 16, 4


def sort_key(value: Column) -> Column:
    """A long that orders as the double does: -0.0 equals 0.0, NaN comes last."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return bits.bitwiseXOR(F.shiftright(bits, 63).bitwiseAND(F.lit(2**63 - 1)))


def select_rank(rows: DataFrame, by: list[str], value: str, ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """by, value: the ``rank``-th smallest value of each group of ``ranks`` (by, rank; from 1).

    NULL values are not counted; a group with fewer values, or with a NULL in its
    key, is left out.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")).withColumn("__k", sort_key(F.col(value)))
    state = ranks.select(*by, F.col(rank).cast("long").alias("__left"))
    before = Window.partitionBy(*by).orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    for step in range(ROUNDS):
        shift = 64 - DIGIT * (step + 1)
        live = counted.join(state, by)
        if step:
            live = live.where(F.shiftright("__k", shift + DIGIT) == F.col("__p"))
        histogram = live.groupBy(*by, F.shiftright("__k", shift).alias("__q")).agg(F.sum("__n").alias("__m"), F.max("__left").alias("__left"))
        placed = histogram.withColumn("__before", F.coalesce(F.sum("__m").over(before), F.lit(0)))
        hit = (F.col("__before") < F.col("__left")) & (F.col("__left") <= F.col("__before") + F.col("__m"))
        state = placed.where(hit).select(*by, F.col("__q").alias("__p"), (F.col("__left") - F.col("__before")).alias("__left"))
    return counted.join(state, by).where(F.col("__k") == F.col("__p")).select(*by, value)

"""Merkle manifest of a table: a digest tree per group, a tree of the groups, a path per row.

Rows of a group become leaves in order; while several nodes remain, each run of
``fanout`` neighbours (the last one may be shorter) becomes the digest of their
concatenation. The tops of the groups, in the groups' order, likewise give the
root. A row's path lists, level by level, what its run holds before and after its
node; folding the leaf along the path gives the root again, or shows that a row
was tampered with.

Slot pivot: conditional aggregates spread the children of a parent into slot
columns of one row; concatenating the columns gives the parent's digest, leaving
the own slot out gives the siblings. One pivot covers several levels
(``fanout ** levels`` slots), so a tree of ten thousand million leaves takes nine
passes upward, each a sixteenth of the one before. Paths are handed down the same
pivots, so each leaf row is written once with its whole path. No task holds a
group: leaves are numbered by ``ordering``, and pivots are keyed by (group, parent).

Defined cases: NULL fields are ``-`` in a leaf; NULL groups are one group, first in
order; rows of equal order (NULL comes first) follow the leaf digest, and equal
rows each have a leaf; a single row is its own subroot; the subroot of a single
group is the root, with no siblings; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ordering import ordered, running
from tidemark.runtime import stage

SLOTS = 16


def field(c: Column) -> Column:
    """``-`` for NULL, else byte count, colon, value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _text(nodes: list[str]) -> str:
    return f"concat({', '.join(f"coalesce({x}, '')" for x in nodes)})" if nodes else "''"


class _Tree:
    """Pivots of one fanout. Expressions are SQL text: a pivot has hundreds of small ones, each dear to build as an object."""

    def __init__(self, fanout: int):
        self.fanout = fanout
        self.levels = max(1, int(math.log(SLOTS, fanout) + 1e-9))
        self.slots = fanout**self.levels

    def pivot(self, nodes: DataFrame) -> DataFrame:
        """(g, i, n, node) -> one row a parent (g, i, n) with its slots s0, s1, ..."""
        slots = [F.expr(f"first(CASE WHEN i % {self.slots} = {k} THEN node END, true) AS s{k}") for k in range(self.slots)]
        return nodes.groupBy("g", F.expr(f"i div {self.slots}").alias("i")).agg(F.max("n").alias("n"), *slots)

    def _many(self, level: int) -> str:
        """The group has several nodes at this level of the pivot."""
        return f"n > {self.fanout**level}"

    def grown(self, pivots: DataFrame) -> DataFrame:
        """Adds the digests of each level, ``d<level>_<place>``, the last one being ``top``."""
        out = pivots.selectExpr("*", *[f"s{k}.digest AS d0_{k}" for k in range(self.slots)])
        for level in range(self.levels):
            above = []
            for place in range(self.slots // self.fanout ** (level + 1)):
                children = [f"d{level}_{c}" for c in range(place * self.fanout, (place + 1) * self.fanout)]
                joined = f"CASE WHEN {children[0]} IS NOT NULL THEN sha2({_text(children)}, 256) END"
                above.append(f"CASE WHEN {self._many(level)} THEN {joined} ELSE d{level}_{place} END AS d{level + 1}_{place}")
            out = out.selectExpr("*", *above)
        return out.withColumnRenamed(f"d{self.levels}_0", "top")

    def path(self, slot: int) -> str:
        """Of one slot: (before, after) of its run on each level that has several nodes."""
        steps = []
        for level in range(self.levels):
            place = slot // self.fanout**level
            run = range(place - place % self.fanout, place - place % self.fanout + self.fanout)
            before, after = (_text([f"d{level}_{k}" for k in run if (k < place if first else k > place)]) for first in (True, False))
            steps.append(f"CASE WHEN {self._many(level)} THEN struct({before} AS before, {after} AS after) END")
        return f"array_compact(array({', '.join(steps)}))"

    def up(self, nodes: DataFrame, largest: int, label: str) -> tuple[list[DataFrame], DataFrame]:
        """The pivots of all passes, and the top (g, digest) of each group."""
        passes = []
        while True:
            passes.append(stage(self.pivot(nodes), label))
            tops = self.grown(passes[-1]).select("g", "i", F.expr(f"(n + {self.slots - 1}) div {self.slots} AS n"), F.struct(F.col("top").alias("digest")).alias("node"))
            largest = -(-largest // self.slots)
            if largest <= 1:
                return passes, tops.select("g", F.col("node.digest").alias("digest"))
            nodes = tops

    def down(self, passes: list[DataFrame], tops: DataFrame) -> DataFrame:
        """From (g, i = 0, path, extra...) to every node of the first pass with its path."""
        for pivots in reversed(passes):
            extra = tops.columns[2:]
            here = self.grown(pivots).alias("p").join(tops.alias("t"), F.expr("p.g <=> t.g AND p.i = t.i")).selectExpr("p.*", *[f"t.{c} AS t_{c}" for c in extra])
            slots = [f"CASE WHEN s{k} IS NOT NULL THEN struct(i * {self.slots} + {k} AS i, s{k} AS node, concat({self.path(k)}, t_path) AS path) END" for k in range(self.slots)]
            each = here.selectExpr("g", f"explode(array_compact(array({', '.join(slots)}))) AS x", *[f"t_{c} AS {c}" for c in extra[1:]])
            tops = each.selectExpr("g", "x.i AS i", "x.path AS path", *extra[1:], *(["x.node AS node"] if pivots is passes[0] else []))
        return tops


def _numbered(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """(g, node and ordering columns) -> (g, i, n, node): place in the group and its size."""
    places = running(ordered(rows, ["g", *by], label), "g", {"i": F.lit(1)}, {})
    return places.select("g", F.col("__i").alias("i"), F.col("__total_i").alias("n"), "node")


def manifest(docs: DataFrame, leaf: Column, group: Column, order: Column, keep: list[Column], fanout: int = 2) -> DataFrame:
    """``keep`` (named columns) plus leaf, subroot, root and path, one row for each row of ``docs``."""
    tree = _Tree(fanout)
    node = F.struct(leaf.alias("digest"), F.struct(*keep).alias("row"))
    hashed = stage(docs.select(group.alias("g"), order.alias("o1"), node.alias("node")).withColumn("o2", F.col("node.digest")), "leaves")
    sizes = hashed.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    largest, groups = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    passes, subroots = tree.up(_numbered(hashed, ["o1", "o2"], "leaf-order"), largest, "leaf-slots")

    of_groups = subroots.select(F.lit(0).alias("g"), F.col("g").alias("o1"), F.struct("digest", F.col("g").alias("name")).alias("node"))
    group_passes, roots = tree.up(_numbered(of_groups, ["o1"], "group-order"), groups, "group-slots")
    start = roots.select("g", F.lit(0).cast("long").alias("i"), F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.col("digest").alias("root"))
    tops = tree.down(group_passes, start)
    tops = tops.select(F.col("node.name").alias("g"), F.lit(0).cast("long").alias("i"), "path", "root", F.col("node.digest").alias("subroot"))

    rows = tree.down(passes, stage(tops, "tops"))
    return rows.select("node.row.*", F.col("node.digest").alias("leaf"), "subroot", "root", "path")


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["before"], acc, x["after"]), 256))

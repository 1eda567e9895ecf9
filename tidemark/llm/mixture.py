"""Mixing sources to target weights by hierarchical budgets.

Documents are leaves' rows of a tree domain - language - source. A budget of tokens
is dealt from the root: among siblings in proportion to their weights, but to none
more than it can give (its tokens times ``max_epochs``, summed over what lies below
it). What one sibling can't use goes to the others in proportion, so a shortage is
met inside its parent first; only when the whole parent is short does its parent
spread the rest. Levels are solved in closed form by one window over siblings,
sorted by how soon they are full.

Each leaf then spends its budget in epochs. An epoch is the leaf in an order seeded
by epoch number and id: whole epochs as far as they go, then the longest prefix of
the next epoch that stays within the rest. Prefix sums run over hashed buckets (about
the square root of a leaf's rows each), so no leaf is sorted in one task.

Defined cases: NULL source, language or text count as ''; documents without tokens
cost nothing and come with every epoch begun; a weight of 0 or below gives
nothing; unnamed nodes weigh ``default``, by itself the least that their level names; a budget over what there is takes all
epochs; NULL ids share one place in the order; repeated rows are taken together or
cut between; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import words
from tidemark.runtime import stage

PATH = ["domain", "lang_key", "source_key"]


@dataclass(frozen=True)
class Mixture:
    domains: dict[str, float] = field(default_factory=dict)
    languages: dict[str, float] = field(default_factory=dict)
    sources: dict[str, float] = field(default_factory=dict)
    #: weight of what a level does not name; None: the least positive weight that level names, 1 if it names none
    default: float | None = None
    #: budget as a share of all tokens there are
    share: float = 1.0
    max_epochs: int = 2
    seed: int = 7


def _weight(name: Column, weights: dict[str, float], default: float | None) -> Column:
    if default is None:
        default = min((x for x in weights.values() if x > 0), default=1.0)
    out = F.lit(float(default))
    for key, value in weights.items():
        out = F.when(name == key, F.lit(float(value))).otherwise(out)
    return F.greatest(out, F.lit(0.0))


def _deal(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Add ``budget`` to nodes that have ``weight``, ``capacity`` and their parent's ``given``."""
    name = [c for c in PATH if c in nodes.columns]
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    soon = siblings.orderBy("full_at", *name)
    x = nodes.withColumn("full_at", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
    before = F.coalesce(F.sum("capacity").over(soon.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(soon.rowsBetween(0, Window.unboundedFollowing))
    x = x.withColumn("level", F.when(rest > 0, (F.col("given") - before) / rest).otherwise(F.lit(0.0)))
    x = x.withColumn("filled", F.col("capacity") <= F.col("weight") * F.col("level"))
    level = F.max(F.when(~F.col("filled"), F.col("level"))).over(siblings)
    budget = F.when(F.col("filled"), F.col("capacity")).otherwise(F.col("weight") * F.greatest(F.coalesce(level, F.lit(0.0)), F.lit(0.0)))
    return x.withColumn("budget", F.least("capacity", budget)).drop("full_at", "level", "filled")


def budgets(leaves: DataFrame, mix: Mixture) -> DataFrame:
    """Leaves (domain, lang_key, source_key, tokens, n) with their ``budget`` of tokens."""
    w = {
        "domain": lambda c: _weight(c, mix.domains, mix.default),
        "lang_key": lambda c: _weight(c, mix.languages, mix.default),
        "source_key": lambda c: _weight(c, mix.sources, mix.default),
    }
    alive = F.lit(True)
    for c in PATH:
        alive = alive & (w[c](F.col(c)) > 0)
    leaves = leaves.withColumn("capacity", F.when(alive, F.col("tokens") * F.lit(float(mix.max_epochs))).otherwise(F.lit(0.0)))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0  # one number
    given = None
    for depth in range(1, 4):
        keys, parent = PATH[:depth], PATH[: depth - 1]
        nodes = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("weight", w[keys[-1]](F.col(keys[-1])))
        nodes = nodes.withColumn("given", F.lit(float(total) * mix.share)) if given is None else nodes.join(given, parent)
        given = _deal(nodes, parent).select(*keys, F.col("budget").alias("given"))
    return leaves.join(given, PATH).withColumn("budget", F.floor(F.col("given") + 1e-6).cast("long")).drop("given", "capacity")


def mix(docs: DataFrame, domain: Column, setting: Mixture = Mixture(), tokens: Column | None = None) -> DataFrame:
    """Every chosen row of ``docs`` once per epoch it stands in.

    Adds ``domain``, ``n_tokens`` and ``epoch``; all columns of ``docs`` are kept.
    """
    names = docs.columns
    tokens = F.size(words(F.col("text"))).cast("long") if tokens is None else tokens
    # our columns beside the caller's, whatever those are called
    work = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        domain.alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang_key"),
        F.coalesce("source", F.lit("")).alias("source_key"),
        tokens.alias("n_tokens"),
    )
    key = F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))
    leaves = stage(work.groupBy(*PATH).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "leaves")
    dealt = stage(budgets(leaves, setting), "budgets")
    dealt = dealt.select(
        *PATH,
        F.floor(F.sqrt("n")).cast("long").alias("buckets"),
        F.when(F.col("tokens") > 0, F.least(F.expr("budget div tokens"), F.lit(setting.max_epochs))).otherwise(F.lit(setting.max_epochs)).cast("int").alias("whole"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(F.lit(0)).alias("rest"),
    )
    placed = work.join(dealt, PATH)
    # the order of the epoch that is only begun
    order = F.xxhash64(F.lit(setting.seed), F.col("whole"), key)
    placed = placed.withColumn("order", order)
    placed = placed.withColumn("bucket", F.floor((F.shiftrightunsigned("order", 1).cast("double") / float(2**63)) * F.col("buckets")).cast("long"))
    sums = placed.groupBy(*PATH, "bucket").agg(F.sum("n_tokens").alias("t"))
    earlier = Window.partitionBy(*PATH).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = stage(sums.withColumn("before", F.coalesce(F.sum("t").over(earlier), F.lit(0))).select(*PATH, "bucket", "before"), "bucket-sums")
    inside = Window.partitionBy(*PATH, "bucket").orderBy(F.shiftrightunsigned("order", 1), F.col("order"), F.col("row.doc_id")).rowsBetween(Window.unboundedPreceding, 0)
    chosen = placed.withColumn("__sum", F.sum("n_tokens").over(inside)).join(sums, [*PATH, "bucket"])
    begun = (F.col("before") + F.col("__sum") <= F.col("rest")) & (F.col("whole") < setting.max_epochs) & (F.col("rest") > 0)
    copies = F.col("whole") + begun.cast("int")
    out = chosen.filter(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), copies - 1)))
    return out.select("row.*", F.col("domain").alias("__domain"), F.col("n_tokens").alias("__n_tokens"), F.col("epoch").alias("__epoch"))

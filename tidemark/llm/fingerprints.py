"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

The terms of a text are its words, weighted by how often they stand in it. For
sample k a term of weight w draws, from its hash alone, r and c from Gamma(2, 1)
and b from U(0, 1); with t = floor(ln w / r + b) its place is
ln c - r (t - b + 1), and the text's sample is the smallest place. Two texts have
one sample in common with a probability equal to their generalised Jaccard
similarity sum(min) / sum(max), so the share of equal samples estimates it. The
place itself, a double that only one (term, t) yields, is the sample.

One exchange carries texts: documents are dealt into ranges of ids (about
``MAX_RANGES`` at most, borders by quantiles), a window inside a range gives each its successor, and the
aggregations over terms and samples reuse that partitioning.

Defined cases: a NULL text counts as empty; wordless texts share one fingerprint
and are like each other only; rows with a NULL id come last in the order; repeated
rows follow each other; a single row is its own successor; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import words
from tidemark.runtime import stage

SAMPLES = 32
MAX_RANGES = 65_536
RANGE_ROWS = 256
BORDERS = 64  # quantiles of the ids
SPLITS = 256  # ranges of a crowded id


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """``width`` bits of a hash as a number strictly between 0 and 1."""
    low = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)) if shift + width < 64 else F.shiftrightunsigned(bits, shift)
    return (low.cast("double") + 0.5) / float(1 << width)


def place(term: Column, log_weight: Column, k: int) -> Column:
    """Where a weighted term falls in sample k; the smallest place of a text is its sample."""
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.ln(_uniform(one, 0, 32) * _uniform(one, 32, 32))
    c = F.ln(-F.ln(_uniform(two, 0, 24) * _uniform(two, 24, 24)))
    b = _uniform(two, 48, 16)
    return c - r * (F.floor(log_weight / r + b).cast("double") - b + 1.0)


def samples(term_counts: DataFrame, keys: list[str], n: int = SAMPLES) -> DataFrame:
    """keys, term, weight -> keys and the array ``samples``; a group without terms (NULL) gets zeros."""
    x = term_counts.withColumn("log_weight", F.ln(F.col("weight").cast("double")))
    least = x.groupBy(*keys).agg(*[F.min(place(F.col("term"), F.col("log_weight"), k)).alias(f"s{k}") for k in range(n)])
    return least.select(*keys, F.array(*[F.when(F.col(f"s{k}").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(f"s{k}")) for k in range(n)]).alias("samples"))


def likeness(a: Column, b: Column, n: int = SAMPLES) -> Column:
    """Share of equal samples: the estimate of the generalised Jaccard similarity."""
    return F.size(F.array_remove(F.zip_with(a, b, lambda x, y: x == y), F.lit(False))) / F.lit(float(n))


def as_text(samples: Column, n: int = SAMPLES) -> Column:
    """Eight hexadecimal digits a sample."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.element_at(samples, k + 1).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")) for k in range(n)])


def _ranges(work: DataFrame) -> Column:
    """The range of a row: an ascending number for ascending ids, NULL ids below all others.

    Borders are quantiles of the ids from a mergeable sketch, so an outlying id moves
    few rows. Between two borders lie ranges of equal width. An id that fills more
    than a border's share, and the NULL ids, are split by the text's hash, which is
    also what orders them.
    """
    shares = [k / BORDERS for k in range(1, BORDERS)]
    row = work.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", shares, F.lit(8 * BORDERS))).first()
    n, low, high, borders = row[0], row[1] or 0, row[2] or 0, row[3] or [0] * (BORDERS - 1)
    parts = max(1, min(MAX_RANGES // BORDERS, n // (BORDERS * RANGE_ROWS)))
    edges = F.array(*[F.lit(b).cast("long") for b in borders])
    bounds = F.array(*[F.lit(b).cast("long") for b in [max(low - 1, -(2**63)), *borders, high]])
    below = F.size(F.filter(edges, lambda b: b < F.col("doc_id")))
    heavy = sorted({b for b, c in zip(borders, borders[1:]) if b == c})
    crowded = F.col("doc_id").isin(heavy) if heavy else F.lit(False)
    left, right = F.element_at(bounds, below + 1).cast("double"), F.element_at(bounds, below + 2).cast("double")
    inside = F.floor((F.col("doc_id").cast("double") - left - 1.0) * parts / F.greatest(right - left, F.lit(1.0)))
    inside = F.least(F.greatest(inside, F.lit(0)), F.lit(parts - 1))
    by_hash = F.lit(SPLITS - 1) - (F.shiftright(F.xxhash64("text"), 64 - 8) + F.lit(SPLITS // 2))
    step = max(parts, SPLITS)
    at = (2 * below + F.when(crowded, 1).otherwise(0)) * F.lit(step) + F.when(crowded, by_hash).otherwise(inside)
    return F.when(F.col("doc_id").isNull(), by_hash - F.lit(SPLITS)).otherwise(at).cast("long")


def successors(docs: DataFrame) -> DataFrame:
    """range, place, next_range, next_place, doc_id, text, next_text, by descending id in a circle."""
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    work = work.withColumn("range", _ranges(work))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    w = Window.partitionBy("range").orderBy(*order)
    lined = work.select("range", "doc_id", "text", F.row_number().over(w).alias("place"), F.lead("text").over(w).alias("lead_text"))
    # the last of a range is followed by the first of the next lower one
    first = work.groupBy("range").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), (-F.xxhash64("text").cast("decimal(20,0)")).alias("h"))).alias("top"))
    chain = Window.partitionBy(F.lit(0)).orderBy(F.desc("range"))
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = first.select("range", F.coalesce(F.lead("range").over(chain), F.first("range").over(whole)).alias("next_range"))  # at most MAX_RANGES rows
    tops = work.join(F.broadcast(first.select("range", "top")), "range").filter((F.coalesce("doc_id", F.lit(-(2**63))) == F.col("top.doc_id")) & (-F.xxhash64("text").cast("decimal(20,0)") == F.col("top.h")))
    texts = tops.groupBy("range").agg(F.first("text").alias("head_text"))
    ends = heads.join(texts.withColumnRenamed("range", "next_range"), "next_range").select(F.col("range").alias("end_range"), "next_range", "head_text")
    joined = lined.join(ends, (F.col("range") == F.col("end_range")) & F.col("lead_text").isNull(), "left")
    return joined.select(
        "range",
        "place",
        F.coalesce("next_range", "range").alias("next_range"),
        F.when(F.col("lead_text").isNull(), F.lit(1)).otherwise(F.col("place") + 1).alias("next_place"),
        "doc_id",
        "text",
        F.coalesce("lead_text", "head_text").alias("next_text"),
    )


def edited(text: Column, other: Column) -> Column:
    """The last half of the code points replaced by the first as many of another text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def fingerprint(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    lined = successors(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    both = lined.select("range", "place", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.coalesce("edited", F.lit("")).alias("t")))).alias("x"))
    terms = both.select("range", "place", F.col("x.kind").alias("kind"), F.explode_outer(words(F.col("x.t"))).alias("word"))
    hashed = terms.select("range", "place", "kind", F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term"))
    counts = hashed.groupBy("range", "place", "kind", "term").agg(F.count(F.lit(1)).alias("weight"))
    sampled = samples(counts, ["range", "place", "kind"], n)
    pair = sampled.groupBy("range", "place").agg(F.first(F.when(F.col("kind") == 0, F.col("samples")), ignorenulls=True).alias("own"), F.first(F.when(F.col("kind") == 1, F.col("samples")), ignorenulls=True).alias("new"))
    base = lined.select("range", "place", "next_range", "next_place", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    rows = stage(base.join(pair, ["range", "place"]), "fingerprints")
    others = rows.select(F.col("range").alias("next_range"), F.col("place").alias("next_place"), F.col("own").alias("other"))
    x = rows.join(others, ["next_range", "next_place"])
    return x.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own"), n).alias("fingerprint"),
        as_text(F.col("new"), n).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new"), n).alias("near_edited"),
        likeness(F.col("own"), F.col("other"), n).alias("near_next"),
    )

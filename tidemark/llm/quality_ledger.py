"""Quality rules as a ledger of failure bits, with DataFrame functions only.

Every rule is looked at once per document: its measurement and one failure bit
are stored. A policy is a mask of bits with a version; applying or comparing
policies reads the ledger and never the texts again.

The work is narrow: no exchange, whatever the sizes. Repeated 8-word windows are
found inside the row, in O(n log n): word hashes are folded pairwise (1, 2, 4, 8
words), and only rows whose windows aren't all different sort them.

Defined cases: a NULL text counts as empty (it fails ``few_words``); white space
only likewise; a document of under 8 words has no window; repeated rows and
NULL ids pass through; further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

#: Rule -> (bit, when it fails), over the measurements. Order is the bit order.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "exclamation": "10 * n_double_marks > n_words",
    "repeated_lines": "10 * n_dup_lines > 5 * n_lines",
    "upper_case": "10 * n_upper > 5 * word_chars",
    "word_length": "word_chars > 25 * n_words OR word_chars < 2 * n_words",
    "few_distinct_words": "50 * n_distinct_words < n_words",
    "stutter": "10 * n_stutter > 3 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Version -> the rules whose failure rejects a document.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["exclamation"] | BIT["repeated_lines"],
    "v2": sum(BIT.values()),
}
CURRENT = "v2"


def _occurrences(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _pairs(a: Column, gap: int) -> Column:
    """Combine each element with the one ``gap`` later."""
    n = F.greatest(F.size(a) - gap, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(gap + 1), n), lambda x, y: F.xxhash64(x, y))


def _covered(windows: Column) -> Column:
    """Words that lie in a window which occurs twice or more."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    nothing = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    n = F.size(windows)
    before, after = F.concat(nothing, F.slice(ordered, F.lit(1), n - 1)), F.concat(F.slice(ordered, F.lit(2), n - 1), nothing)
    near = F.zip_with(
        F.zip_with(ordered, before, lambda x, b: F.struct(x.h.alias("h"), x.i.alias("i"), F.coalesce(b.h == x.h, F.lit(False)).alias("twin"))),
        after,
        lambda x, a: F.when(x.twin | F.coalesce(a.h == x.h, F.lit(False)), x.i),
    )
    starts = F.array_sort(F.array_compact(near))
    last = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.lit(None).cast("int")))
    steps = F.zip_with(starts, last, lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def measure(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` plus one column per measurement."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [f.name for f in docs.select(*keep).schema]
    x = docs.select(*keep, text.alias("__text"))
    has_word = lambda line: F.translate(line, SPACES, "") != ""
    x = x.select(*names, "__text", words(F.col("__text")).alias("__words"), F.filter(F.split("__text", "\n"), has_word).alias("__lines"))
    x = x.select(*names, "__text", "__lines", F.size("__words").cast("long").alias("n_words"), F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"))
    n = F.greatest(F.size("__hashes") - 1, F.lit(0))
    twins = F.zip_with(F.slice("__hashes", F.lit(1), n), F.slice("__hashes", F.lit(2), n), lambda a, b: a == b)
    x = x.withColumn("n_stutter", F.size(F.array_remove(twins, F.lit(False))).cast("long"))
    # windows of 2, 4 and 8 words, each from two of half the size
    eight = F.col("__hashes")
    for gap in (1, 2, 4):
        x = x.withColumn("__windows", _pairs(eight, gap))
        eight = F.col("__windows")
    x = x.withColumn("__distinct", F.size(F.array_distinct("__windows")))
    repeated = F.when(F.col("__distinct") < F.size("__windows"), _covered(F.col("__windows"))).otherwise(F.lit(0).cast("long"))
    bare = F.length(F.translate("__text", SPACES, ""))
    return x.select(
        *names,
        "n_words",
        bare.cast("long").alias("word_chars"),
        _occurrences(F.col("__text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.floor((F.length("__text") - F.length(F.replace(F.col("__text"), F.lit("!!"), F.lit("")))) / 2).cast("long").alias("n_double_marks"),
        _occurrences(F.col("__text"), string.ascii_uppercase).cast("long").alias("n_upper"),
        F.size(F.array_distinct("__hashes")).cast("long").alias("n_distinct_words"),
        "n_stutter",
    )


def ledger(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """The measurements plus ``failures``: one bit per rule of ``RULES``."""
    x = measure(docs, keep)
    bits = None
    for name, fails in RULES.items():
        bit = F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return x.withColumn("failures", bits)


def passes(policy: str = CURRENT, failures: str = "failures") -> Column:
    """True where no rule of the policy failed."""
    return F.col(failures).bitwiseAND(F.lit(POLICIES[policy])) == 0


def kept(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Rows of a ledger that pass.

    The row number in the condition keeps the filter where it is: pushed below the
    measurements it would carry a copy of all of them and measure every text twice.
    """
    here = rows.withColumn("__here", F.monotonically_increasing_id())
    return here.filter(passes(policy) & (F.col("__here") >= 0)).drop("__here")


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: documents it fails, and those only it rejects.

    One aggregation over the stored bits; an empty ledger gives zeros.
    """
    mask = POLICIES[policy]
    used = [n for n in RULES if BIT[n] & mask]
    seen = F.col("failures").bitwiseAND(F.lit(mask))
    counts = [F.count(F.when(seen.bitwiseAND(F.lit(BIT[n])) != 0, 1)).alias(f"f_{n}") for n in used]
    alone = [F.count(F.when(seen == BIT[n], 1)).alias(f"a_{n}") for n in used]
    one = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.count(F.when(seen != 0, 1)).alias("n_rejected"), F.bit_or(seen).alias("any_bits"), *counts, *alone)
    cases = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"a_{n}").alias("n_only_this")) for n in used])).alias("r")
    return one.select(F.lit(policy).alias("policy"), "n_docs", "n_rejected", cases).select("policy", "n_docs", "n_rejected", "r.*")

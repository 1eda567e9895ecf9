"""URL filter: allow and block rules, and two character models for the rest.

The longest rule that fits decides. Where none fits, the url is scored under two
variable-order Markov models of characters, one of the urls that rules accept and
one of those that they reject; the verdict is by their length-normalised
log-likelihood difference, against a threshold calibrated on the accepted ones.

A model is a table of n-grams (1 to 3 characters over an alphabet of 34, hence
under 41,000 rows whatever the input). Counts are smoothed by shrinking each order
towards the next shorter one; n-grams seen under ``MIN_COUNT`` times are left to
the shorter order. The table holds, for each n-gram, what its score adds to that of
its own tail, so that a url's score is one plain sum over all n-grams it has, which
folds in the map task: a page is one row in the only exchange.

DataFrame functions only.

Defined cases: a NULL url or one without ``://`` has an empty host and path and is
scored as the empty string; without accepted and rejected urls to learn from,
what no rule fits is allowed; NULL ids and repeated rows pass through; further
columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import stage

ORDER = 3
ALPHABET = 34
SMOOTHING = 2.0
MIN_COUNT = 3
DIGITS = 4
#: share of accepted urls that the threshold may turn away
MISSED = 0.01


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _first_fit(rules: list[Rule], value) -> Column:
    ordered = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name))
    host, path = F.col("host"), F.col("path")
    out = None
    for r in ordered:
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))) if out is None else out.when(fits, F.lit(value(r)))
    return F.lit(None).cast("string") if out is None else out


def _symbols() -> Column:
    """The url as the models see it: small letters, one digit, few signs, marked ends."""
    x = F.translate(F.concat("host", "path"), string.digits + string.ascii_uppercase, "0" * 10 + string.ascii_lowercase)
    return F.concat(F.lit("^"), F.regexp_replace(x, "[^a-z0./_-]", "~"), F.lit("$"))


def _grams(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per n-gram that ends at a character after the start mark."""
    n = F.length("symbols")
    ends = F.sequence(F.lit(2), n)
    per_end = F.flatten(F.transform(ends, lambda e: F.transform(F.sequence(F.lit(1), F.least(F.lit(ORDER), e)), lambda k: F.substring(F.col("symbols"), e - k + 1, k))))
    return rows.select(*keys, F.explode(per_end).alias("gram"))


def model(ruled: DataFrame) -> DataFrame:
    """(gram, delta) from rows (symbols, accepted): at most 34 + 34^2 + 34^3 rows."""
    a = F.count(F.when(F.col("accepted"), 1))
    seen = _grams(ruled, ["accepted"]).groupBy("gram").agg(a.alias("na"), (F.count(F.lit(1)) - a).alias("nr")).filter(F.col("na") + F.col("nr") >= F.when(F.length("gram") == 1, 1).otherwise(MIN_COUNT))
    # counts of what may follow the same context, and of the tail one shorter
    seen = seen.withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)"))
    totals = seen.groupBy(F.length("gram").alias("k"), "context").agg(F.sum("na").alias("ta"), F.sum("nr").alias("tr"))
    table = stage(seen.withColumn("k", F.length("gram")).join(totals, ["k", "context"]).select("k", "gram", "na", "nr", "ta", "tr"), "gram-counts")
    smooth = lambda n, t, below: (n + SMOOTHING * below) / (t + SMOOTHING)
    whole = None
    for k in range(1, ORDER + 1):
        level = table.filter(F.col("k") == k)
        if whole is None:
            p = level.select("gram", smooth(F.col("na"), F.col("ta"), F.lit(1.0 / ALPHABET)).alias("pa"), smooth(F.col("nr"), F.col("tr"), F.lit(1.0 / ALPHABET)).alias("pr"), F.lit(0.0).alias("tail_score"))
        else:
            tails = below.select(F.col("gram").alias("tail"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
            level = level.withColumn("tail", F.expr("substring(gram, 2)")).join(tails, "tail")
            p = level.select("gram", smooth(F.col("na"), F.col("ta"), F.col("qa")).alias("pa"), smooth(F.col("nr"), F.col("tr"), F.col("qr")).alias("pr"), F.ln(F.col("qa") / F.col("qr")).alias("tail_score"))
        below = p
        whole = p if whole is None else whole.union(p)
    return stage(whole.select("gram", (F.ln(F.col("pa") / F.col("pr")) - F.col("tail_score")).alias("delta")), "gram-scores")


def score(rows: DataFrame, keys: list[str], deltas: DataFrame) -> DataFrame:
    """keys plus ``score``: mean over a url's characters of the difference of log-likelihoods."""
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    found = _grams(numbered, [*keys, "__row", "symbols"]).join(F.broadcast(deltas), "gram", "left")  # bounded by the alphabet
    total = found.groupBy("__row", *keys, "symbols").agg(F.sum(F.coalesce("delta", F.lit(0.0))).alias("total"))
    return total.select(*keys, F.round(F.col("total") / (F.length("symbols") - 1), DIGITS).alias("score"))


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every page (page_id, url)."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": _first_fit(rules, lambda r: r.name), "ruled": _first_fit(rules, lambda r: r.verdict), "symbols": _symbols()})
    ruled = rows.filter(F.col("ruled").isNotNull()).select("symbols", (F.col("ruled") == "allow").alias("accepted"))
    kinds = {r["accepted"] for r in ruled.select("accepted").distinct().collect()}
    keys = ["page_id", "host", "path", "rule", "ruled"]
    if len(kinds) < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    scored = stage(score(rows.select(*keys, "symbols"), keys, model(ruled)), "url-scores")
    # scores are rounded, so that this is a short histogram and the threshold is exact
    bins = scored.filter("ruled = 'allow'").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    threshold = bins.agg(F.expr(f"percentile(score, {MISSED}, n)")).first()[0]
    verdict = F.coalesce("ruled", F.when(F.col("score") >= F.lit(threshold), "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")

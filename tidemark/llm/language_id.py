"""Language identification by words first, then by shorter and shorter character n-grams.

A word seen in training scores by its log frequency in each language. An unseen
word is spelt out: at each position the longest known n-gram scores, so unseen
long n-grams fall back to shorter ones. Every piece of evidence is normalised
over the languages before it is added, which keeps rare and common words on one
scale.

Training uses a sample of at most about ``max_docs`` labelled documents; the
tables are cut to the ``max_words`` and ``max_grams`` commonest entries, each with
all its languages, which bounds what is broadcast (a few megabytes).

Defined cases: a NULL text or one without a letter gives ``und`` and score 0; no
labelled document at all gives ``und`` everywhere; ties go to the language that
sorts first; repeated rows are scored alike; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, slices
from tidemark.runtime import stage

UNDETERMINED = "und"
LETTERS = re.compile(r"[^\W\d_]+")
LONGEST_GRAM = 5
UNSEEN_WEIGHT = 0.5


def letter_runs(text: str) -> list[str]:
    """Whole runs of letters, lower case. The pattern lets numeric signs such as one half pass; they end a run."""
    found = LETTERS.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [run for x in found for run in "".join(c if c.isalpha() else " " for c in x).split()]


@dataclass
class LanguageModel:
    """Languages, and per known word or n-gram one row of log shares over them."""

    languages: list[str]
    words: dict[str, np.ndarray] = field(repr=False)
    grams: dict[str, np.ndarray] = field(repr=False)

    def evidence(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return known
        marked = f"^{word}$"
        total, at, n = np.zeros(len(self.languages)), 0, len(marked)
        while at < n:
            for size in range(min(LONGEST_GRAM, n - at), 0, -1):
                row = self.grams.get(marked[at : at + size])
                if row is not None:
                    total += row
                    break
            at += 1
        return UNSEEN_WEIGHT * total / max(1, n - 2)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in slices(batches):
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
            for word, n in Counter(letter_runs(text)).items():
                counts[lang, word] += n
    yield pa.RecordBatch.from_pydict(
        {"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())},
        schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]),
    )


def _commonest(counts: DataFrame, item: str, most: int, least: int = 1) -> list:
    """(item, each (lang, n)) of the commonest items over all languages, each with every language that has it."""
    whole = counts.groupBy(F.col(item).alias("item")).agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("each"))  # an entry a language
    return whole.filter(F.col("total") >= least).orderBy(F.desc("total"), "item").limit(most).select("item", "each").collect()


def _shares(rows: list, index: dict[str, int], smoothing: float) -> dict[str, np.ndarray]:
    """log p(item | language), normalised over the languages."""
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        own = counts[r["item"]] = np.zeros(len(index))
        for x in r["each"]:
            own[index[x["lang"]]] += x["n"]
    if not counts:
        return {}
    totals = np.maximum(sum(counts.values()), 1.0)
    out = {}
    for item, c in counts.items():
        p = np.log((c + smoothing) / (totals + smoothing * len(counts)))
        out[item] = p - np.logaddexp.reduce(p)
    return out


def fit(labelled: DataFrame, max_docs: int = 6_000, max_words: int = 40_000, max_grams: int = 40_000) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of the given rows (rows with a NULL in either are left out).

    ``doc_id`` only chooses the sample.
    """
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sample = bounded_sample(rows, F.col("doc_id"), max_docs)
    counted = sample.select("text", "lang").mapInArrow(_count_words, "lang string, word string, n long")
    counts = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = stage(counts, "language-words")
    top = _commonest(counts, "word", max_words)
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.length(marked)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(LONGEST_GRAM)), lambda k: F.when(i + k - 1 <= F.length(marked), F.substring(marked, i, k)))))
    grams = counts.select("lang", "n", F.explode(F.array_compact(pieces)).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    gram_rows = _commonest(grams, "gram", max_grams, least=2)
    languages = sorted({x["lang"] for r in [*top, *gram_rows] for x in r["each"]})
    index = {x: i for i, x in enumerate(languages)}
    return LanguageModel(languages, _shares(top, index, 0.1), _shares(gram_rows, index, 0.1))


class _Rows(dict):
    """Word -> row of the evidence matrix; unseen words are worked out once per worker."""

    LIMIT = 200_000

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model, self.matrix = model, np.zeros((1024, max(1, len(model.languages))))

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[at] = self.model.evidence(word)
        self[word] = at
        return at


def predict(docs: DataFrame, model: LanguageModel, keep: list[Column]) -> DataFrame:
    """``keep`` plus ``lang_pred`` and ``score`` for every row; only ``text`` is looked at."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    work = docs.select(*keep, F.col("text").alias("__text"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in work.schema[:-1])}, lang_pred string, score double"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        rows = _Rows(m)
        for batch in slices(batches):
            langs, scores = [], []
            for text in batch["__text"].to_pylist():
                found = letter_runs(text) if text and m.languages else None
                if not found:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                if len(rows) > _Rows.LIMIT:
                    rows = _Rows(m)
                at = np.fromiter(map(rows.__getitem__, found), np.int64, len(found))
                z = rows.matrix[at].sum(axis=0) / np.sqrt(len(found))
                best = int(z.argmax())
                langs.append(m.languages[best])
                scores.append(float(1.0 / np.exp(z - z[best]).sum()))
            kept = batch.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept.schema.names, "lang_pred", "score"])

    return work.mapInArrow(label, schema)

"""Token counts by a two-tier table of pre-token lengths.

Tier one is a compact table of the most frequent pre-tokens and their token
counts, broadcast (at most ``table_size`` entries of at most 32 characters, a few
megabytes). Tier two is a cache in each Python worker, filled by encoding what
the table lacks. Counting is map-side; no pre-token is shuffled, whatever the
input. Which pre-tokens are in the table changes the speed, never a count.

The table is filled from at most about ``sample_docs`` documents. Texts with
characters that ``pretokens.UNUSUAL`` names are encoded whole by the library, so
counts always equal the library's.

Defined cases: a NULL text counts as empty (0 tokens); special strings inside a
text are matched as the library does by default; repeated rows and NULL ids pass
through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, slices
from tidemark.llm.pretokens import BYTE_PIECES, UNUSUAL, Cache, tokenizer

_CACHES: dict[str, Cache] = {}


def _count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in slices(batches):
        for text in batch["text"].to_pylist():
            counts.update(p for p in BYTE_PIECES.findall(text) if len(p) <= 32)
    yield pa.RecordBatch.from_pydict({"piece": list(counts), "n": list(counts.values())}, schema=pa.schema([("piece", pa.string()), ("n", pa.int64())]))


def frequent_lengths(docs: DataFrame, path: str, sample_docs: int = 2_000, table_size: int = 50_000) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of a sample."""
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    sample = bounded_sample(rows, F.col("doc_id"), sample_docs).select("text")
    counts = sample.mapInArrow(_count_pieces, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    top = [r["piece"] for r in counts.orderBy(F.desc("n"), "piece").limit(table_size).select("piece").collect()]
    t = tokenizer(path)
    return {p: len(t.encode(p, add_special_tokens=False).ids) for p in top if not UNUSUAL.search(p)}


def count(docs: DataFrame, path: str, keep: list[Column], sample_docs: int = 2_000, table_size: int = 50_000) -> DataFrame:
    """``keep`` plus ``n_bytes`` and ``n_tokens`` of every whole text."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, sample_docs, table_size))
    work = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in work.schema[:-1])}, n_bytes long, n_tokens long"

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        cache = _CACHES.get(path)  # a count doesn't depend on the table it started from
        if cache is None:
            cache = _CACHES[path] = Cache(lambda p: len(t.encode(p, add_special_tokens=False).ids), table.value)
        get = cache.__getitem__
        for batch in slices(batches):
            sizes, tokens = [], []
            for text in batch["__text"].to_pylist():
                sizes.append(len(text.encode()))
                if UNUSUAL.search(text):
                    tokens.append(len(t.encode(text, add_special_tokens=False).ids))
                else:
                    tokens.append(sum(map(get, BYTE_PIECES.findall(text))))
            kept = batch.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=[*kept.schema.names, "n_bytes", "n_tokens"])

    return work.mapInArrow(lengths, schema)

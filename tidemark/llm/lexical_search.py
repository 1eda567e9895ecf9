"""Ranked lexical search: exact top k of every query over range-maximum tables.

Terms are runs of ASCII letters, digits and all other non-ASCII characters, with
A-Z folded. One pass over the texts keeps, per document, its length and how often
it holds each term of the query set; totals over that table give the statistics of
the corpus. The kept postings are then searched shard by shard:

* A shard is a stretch of documents of one task, ordered by length, of bounded
  postings. Its posting lists lie behind one another in one array, each with the
  impact of its term in its document, and one sparse table holds the place of the
  largest impact of every stretch of 1, 2, 4, ... postings.
* A query starts with the interval of all documents. Summed range maxima of its
  terms bound every score inside an interval from above. The intervals with the
  highest bounds are split at a document of maximum impact, which is scored
  exactly; the two rests become intervals. Splitting ends when no interval can
  reach the k-th best score; that score goes on to the task's next shard.
* Intervals are taken a batch at a time, so that the tables answer in arrays.

Each task emits k rows a query; ranks come from those. Queries are taken in blocks
whose vocabulary has a fixed bound, the only thing that is broadcast.

Defined cases: NULL and termless texts hold no term and count in no statistic; a
query without terms, or whose terms occur nowhere, has no rows; a document under a
NULL id is ranked before others of the same score; repeated documents and queries
are ranked each; empty tables give an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.runtime import stage

BLOCK_TERMS = 50_000
BLOCK_QUERIES = 2_000
SHARD_POSTINGS = 1_000_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_NO_ID = np.iinfo(np.int64).min
_POSTINGS = "doc_id long, n long, terms binary, tfs binary"
_HITS = "query long, doc_id long, score long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


# ---- postings and statistics ---------------------------------------------------
def postings(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """Per document with a term: its length and the terms of the query set it holds (int32) with counts (int64)."""
    shared = docs.sparkSession.sparkContext.broadcast(ids)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tfs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                found = terms_of(text) if text else ()
                if found:
                    held = Counter(filter(known.__contains__, found))
                    out.append((doc, len(found), np.fromiter(map(known.__getitem__, held), np.int32, len(held)).tobytes(), np.fromiter(held.values(), np.int64, len(held)).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _POSTINGS)


def _document_frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in slices(batches, 1024):
            held = np.frombuffer(b"".join(batch["terms"].to_pylist()), np.int32)
            df += np.bincount(held, minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    return run


def term_weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    m = 50 + 50 * n * documents // terms
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))


# ---- one shard -----------------------------------------------------------------
class Shard:
    """Posting lists of some documents behind one another, with one sparse table of range maxima."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impact: np.ndarray, documents: int, size: int):
        by = np.lexsort((docs, terms))
        self.doc, self.impact, self.documents = docs[by].astype(np.int64), impact[by], documents
        self.start = np.searchsorted(terms[by], np.arange(size + 1))
        self.key = terms[by].astype(np.int64) * documents + self.doc  # ascending over all lists
        # best[j][p]: place of the largest impact among postings p ... p + 2^j - 1
        self.best = [np.arange(len(docs), dtype=np.int32)]
        longest = int(np.diff(self.start).max(initial=0))
        while 2 << len(self.best) - 1 <= longest:
            last, step = self.best[-1], 1 << len(self.best) - 1
            left, right = last[:-step], last[step:]
            self.best.append(np.where(self.impact[right] > self.impact[left], right, left))

    def largest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of the largest impact in each stretch a ... b - 1 (none is empty)."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for j in np.unique(level):
            at = np.flatnonzero(level == j)
            left, right = self.best[j][a[at]], self.best[j][b[at] - (1 << int(j))]
            out[at] = np.where(self.impact[right] > self.impact[left], right, left)
        return out

    def search(self, terms: np.ndarray, ids: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best (score, id) among ``best`` and the shard's documents; terms are distinct."""
        a, b = self.start[terms], self.start[terms + 1]
        t = terms[b > a].astype(np.int64)
        a, b = a[b > a], b[b > a]
        if not len(t):
            return best
        score = np.array([s for s, _ in best], np.int64)
        doc = np.array([d for _, d in best], np.int64)
        floor = int(score[-1]) if len(best) >= k else 1
        # an interval is a run of entries (term, a, b), one for each term with postings inside
        part = np.zeros(len(t), np.int64)
        bound, split = self._bounds(part, a, b, 1)
        taken = 4
        while len(bound):
            live = bound >= floor
            order = np.argsort(-bound, kind="stable")
            now = np.zeros(len(bound), bool)
            now[order[:taken]] = True
            now &= live
            if not now.any():
                break
            later = live & ~now
            place = np.cumsum(now) - 1
            mine = now[part]
            p, tt, aa, bb = place[part[mine]], t[mine], a[mine], b[mine]
            at = split[now]
            cut = np.searchsorted(self.key, tt * self.documents + at[p])
            hit = (cut < bb) & (self.doc[np.minimum(cut, len(self.doc) - 1)] == at[p])
            exact = np.zeros(len(at), np.int64)
            np.add.at(exact, p[hit], self.impact[cut[hit]])
            good = exact >= floor
            if good.any():
                score, doc = np.concatenate([score, exact[good]]), np.concatenate([doc, ids[at[good]]])
                first = np.lexsort((doc, -score))[:k]
                score, doc = score[first], doc[first]
                if len(score) >= k:
                    floor = max(floor, int(score[-1]))
            # what stays: intervals not looked at, then left and right rests of those that were
            wait = later[part]
            n_later = int(later.sum())
            left, right = cut > aa, bb > cut + hit
            part = np.concatenate([(np.cumsum(later) - 1)[part[wait]], n_later + 2 * p[left], n_later + 2 * p[right] + 1])
            t = np.concatenate([t[wait], tt[left], tt[right]])
            a = np.concatenate([a[wait], aa[left], (cut + hit)[right]])
            b = np.concatenate([b[wait], cut[left], bb[right]])
            fresh = len(part) - int(wait.sum())
            of_rest, split_rest = self._bounds(part[-fresh:] - n_later, a[-fresh:], b[-fresh:], 2 * len(at)) if fresh else (np.zeros(2 * len(at), np.int64), np.zeros(2 * len(at), np.int64))
            bound = np.concatenate([bound[later], of_rest])
            split = np.concatenate([split[later], split_rest])
            keep = bound >= floor
            if not keep.all():
                mine = keep[part]
                part, t, a, b = (np.cumsum(keep) - 1)[part[mine]], t[mine], a[mine], b[mine]
                bound, split = bound[keep], split[keep]
            taken = min(2 * taken, 4096)
        return list(zip(score.tolist(), doc.tolist()))

    def _bounds(self, part: np.ndarray, a: np.ndarray, b: np.ndarray, intervals: int) -> tuple[np.ndarray, np.ndarray]:
        """Per interval: the sum of its terms' largest impacts, and the document of the largest of them."""
        top = self.largest(a, b)
        value = self.impact[top]
        bound = np.bincount(part, value, intervals).astype(np.int64)  # sums stay far below 2^53
        split = np.zeros(intervals, np.int64)
        by = np.argsort(value, kind="stable")
        split[part[by]] = self.doc[top[by]]  # the last one written is the largest
        return bound, split


def _search(queries: list[np.ndarray], weights: np.ndarray, documents: int, total: int, k: int):
    """Task over postings -> its k best documents of each query."""
    schema = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        held: list[tuple] = []
        size = 0

        def settle():
            held.sort(key=lambda r: r[1])  # by length: impacts of neighbours are alike
            ids = np.array([_NO_ID if r[0] is None else r[0] for r in held], np.int64)
            n = np.array([r[1] for r in held], np.int64)
            counts = [len(r[2]) // 4 for r in held]
            terms = np.frombuffer(b"".join(r[2] for r in held), np.int32)
            tfs = np.frombuffer(b"".join(r[3] for r in held), np.int64)
            docs = np.repeat(np.arange(len(held)), counts)
            impact = impacts(weights[terms], tfs, n[docs], documents, total)
            some = impact > 0  # a term without weight adds nothing
            shard = Shard(terms[some], docs[some], impact[some], len(held), len(weights))
            for q, wanted in enumerate(queries):
                best[q] = shard.search(wanted, ids, k, best[q])

        for batch in slices(batches, 4096):
            for row in zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "terms", "tfs"))):
                held.append(row)
                size += len(row[2]) // 4
                if size >= SHARD_POSTINGS:
                    settle()
                    held, size = [], 0
        if held:
            settle()
        out = [(q, None if d == _NO_ID else d, s) for q, hits in enumerate(best) for s, d in hits]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(schema)], schema=schema)

    return run


# ---- the operator --------------------------------------------------------------
def _blocks(queries: DataFrame) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Blocks of queries (ids, distinct terms) of bounded vocabulary; one query is never cut."""
    ids, terms, seen = [], [], set()
    for row in queries.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        own = sorted(set(terms_of(bytes(row["text"])))) if row["text"] else []
        if ids and (len(ids) >= BLOCK_QUERIES or len(seen) + len(own) > BLOCK_TERMS):
            yield ids, terms
            ids, terms, seen = [], [], set()
        ids.append(row["item_id"])
        terms.append(own)
        seen.update(own)
    if ids:
        yield ids, terms


def _block_hits(docs: DataFrame, items: list, terms: list[list[bytes]], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted(set().union(*terms))
    ids = {t: i for i, t in enumerate(vocabulary)}
    kept = stage(postings(docs, ids), "postings")
    documents, total = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = kept.select("terms").mapInArrow(_document_frequencies(len(ids)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(len(ids), np.int64)
    for row in counted.collect():  # one row a term of the block
        df[row["term"]] = row["df"]
    wanted = [np.array([ids[t] for t in own], np.int64) for own in terms]
    found = kept.mapInArrow(_search(wanted, term_weights(documents, df), documents, max(total, 1), k), _HITS)
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(items)), "query long, item_id long")
    return ranked.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of each query (item_id, text)."""
    out = None
    for items, terms in _blocks(queries):
        hits = _block_hits(docs, items, terms, k)
        out = hits if out is None else out.union(hits)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out

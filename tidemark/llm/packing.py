"""Best-fit packing of documents into sequences with several capacities.

A sequence has three capacities: tokens, documents and attention cost (the sum of
squared piece lengths). A piece goes to an open sequence that can take it under
all three and that fits best: the one whose residual vector, scaled by the
capacities, has the largest weighted dot product with the piece's demand, or the
smallest norm after it, as ``score`` says.

The decision is made on counts, not on rows. Pieces of one length are alike, and
sequences with the same residual vector are alike, so packing works on the
histogram of lengths (at most ``max_tokens`` entries, whatever the corpus): longest
lengths first, each class placed into classes of open sequences, many at once.
What comes out is, for each length, a list of rank ranges and the sequences they
fill. Ranks are then given to pieces by counting in hashed buckets, so no length,
not even one that holds a third of all pieces, is numbered in one task.

Defined cases: only documents longer than ``max_tokens`` (of a sequence, or as
``Capacity.piece`` says) are cut; an empty or NULL
text is the closing id alone; repeated rows are packed each; an empty table gives
an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import slices
from tidemark.llm.pretokens import UNUSUAL, WORD_PIECES, Cache, piece_ids, tokenizer
from tidemark.runtime import stage

CLOSING_ID = 0
_CACHES: dict[str, Cache] = {}


@dataclass(frozen=True)
class Capacity:
    """Of one sequence. The defaults bind only by tokens: 2048 documents of one
    token and a single piece of full length both fit."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    #: longest piece, where that is less than a whole sequence; attention can bind only then
    piece: int | None = None
    #: how much each counts when sequences are compared
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    #: "norm": smallest weighted residual after placing; "dot": largest weighted dot product before
    score: str = "norm"


# ---- pieces ------------------------------------------------------------------
def pieces(docs: DataFrame, path: str, max_tokens: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    work = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = work.schema["doc_id"].dataType.simpleString()
    step = 4 * max_tokens
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        cache = _CACHES.get(path)
        if cache is None:
            ids_of, forms = piece_ids(path), [struct.Struct(f"<{k}I") for k in range(65)]

            def packed(piece: str) -> bytes:
                found = ids_of(piece)
                return forms[len(found)].pack(*found) if len(found) < len(forms) else np.array(found, "<u4").tobytes()

            cache = _CACHES[path] = Cache(packed)
        get = cache.__getitem__
        for batch in slices(batches):
            at, number, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                if UNUSUAL.search(text):
                    ids = np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                else:
                    ids = b"".join(map(get, WORD_PIECES.findall(text.lower())))
                ids += closing
                for k, begin in enumerate(range(0, len(ids), step)):
                    part = ids[begin : begin + step]
                    at.append(i)
                    number.append(k)
                    start.append(begin // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return work.mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


# ---- the plan: on the histogram ----------------------------------------------
def plan(counts: dict[int, int], cap: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first sequence, pieces per sequence, offset).

    Pieces of ``length`` with rank r in the range go to sequence
    ``first sequence + (r - first rank) // per``, at ``offset`` plus their place.
    """
    wt, wd, wa = cap.weights
    ct, cd, ca = float(cap.tokens), float(cap.documents), float(cap.attention)
    # class of open sequences: residual (tokens, documents, attention) -> runs of sequence numbers
    free: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    rows, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank, cost = counts[length], 0, length * length
        if length > cap.tokens or cost > cap.attention or cap.documents < 1:
            raise ValueError(f"a piece of {length} tokens exceeds an empty sequence")

        def place(key, runs, length=length, cost=cost):
            """Fill sequences of one class while pieces of this length and sequences last."""
            nonlocal left, rank
            t, d, a = key
            most = min(t // length, d, a // cost)
            while left and runs:
                first, n = runs.pop()
                # having taken one piece, a sequence fits the next of this length better than before
                used, per = (min(n, left // most), most) if left >= most else (1, left)
                rows.append((length, rank, used * per, first, per, cap.tokens - t))
                left -= used * per
                rank += used * per
                if used < n:
                    runs.append((first + used, n - used))
                rest = (t - per * length, d - per, a - per * cost)
                if rest[0] and rest[1]:
                    free.setdefault(rest, []).append((first, used))

        while left:
            fits = [k for k, runs in free.items() if runs and k[0] >= length and k[1] >= 1 and k[2] >= cost]
            if not fits:
                break
            k = np.array(fits, float)
            if cap.score == "dot":
                score = -(wt * k[:, 0] / ct * length / ct + wd * k[:, 1] / cd / cd + wa * k[:, 2] / ca * cost / ca)
            else:
                score = wt * ((k[:, 0] - length) / ct) ** 2 + wd * ((k[:, 1] - 1) / cd) ** 2 + wa * ((k[:, 2] - cost) / ca) ** 2
            key = fits[int(score.argmin())]
            place(key, runs := free[key])
            if not runs:
                del free[key]
        if left:  # open new sequences, all of one kind, and fill them with this length
            empty = (cap.tokens, cap.documents, cap.attention)
            opened = -(-left // min(cap.tokens // length, cap.documents, cap.attention // cost))
            place(empty, [(sequences, opened)])
            sequences += opened
    return rows


# ---- ranks and places --------------------------------------------------------
def _ranked(rows: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """A number from 0 for each piece among those of its length, and the histogram.

    Counted per (length, bucket); the window then runs inside a bucket only.
    """
    rows = stage(rows, "pieces")  # encoded once, read by the count and by the numbering
    total = rows.count()
    buckets = math.isqrt(total) + 1  # so that neither a bucket nor the list of buckets of one length gets long
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(sizes.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-starts")
    histogram = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    within = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = rows.withColumn("__row", F.row_number().over(within) - 1)
    ranked = numbered.join(starts.select("length", "__bucket", "__before"), ["length", "__bucket"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__before") + F.col("__row")).alias("__rank")), histogram


def pack(docs: DataFrame, path: str, cap: Capacity = Capacity()) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``."""
    ranked, histogram = _ranked(pieces(docs, path, cap.piece or cap.tokens))
    table: dict[int, np.ndarray] = {}
    for row in plan(histogram, cap):
        table.setdefault(row[0], []).append(row[1:])
    shared = docs.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in table.items()})
    schema = T.StructType([f for f in ranked.schema if f.name != "__rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["__rank"].to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                ranges = shared.value[int(size)]
                row = ranges[np.searchsorted(ranges[:, 0], rank[at], side="right") - 1]
                within = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + within // row[:, 3]
                offset[at] = row[:, 4] + within % row[:, 3] * size
            kept = batch.drop_columns(["__rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)

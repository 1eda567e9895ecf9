"""Exact Jaccard join of documents on word n-grams, by size-banded tiles.

A document is the set of hashes of its n-grams. Two documents link when
``100 * |A & B| >= percent * |A | B|``. Equal sets are one node throughout, so a
group of copies costs a row a task. How a link is found:

1. **Keys.** In any one order of all n-grams, the first few members of two linked
   sets have one in common: of a set of n members the first ``n - x + 1``, x being
   the least overlap a link of that set can have. The order puts n-grams that a
   sample of documents shares last, so most keys stand in one set only and end there.
2. **Counts.** Most sets that share a key share little else. Members are counted in
   some tens of hashed buckets, a byte each: what one side has more in a bucket, it
   has alone, which bounds the overlap. Rows whose bounds leave no partner under
   their key go no further; keys of many rows are left as they are.
3. **Tiles.** Sizes are cut into bands no linked pair can skip. A tile is a key and
   a band: smaller sets of that band, and sets of it or the next one that may be
   their larger partner. Tiles of many rows are dealt into blocks.
4. **Bounds.** Every set has a bitmap of hashed bits, four to eight a member. A bit
   that only one side has is a member that only this side has, so bit counts bound
   the overlap from above; most pairs of a tile end there.
5. **Exact.** What is left is settled by intersecting the sorted arrays.

Only components are asked for, so no task puts out pairs by the square. First each
block gives a forest: of the pairs its bounds allow, those that join parts of the
block not joined so far. These are settled. In tiles that then still hold several
components, sets with an allowed partner in another component are named (once a
block), their arrays are fetched, and all such pairs are settled inside the task,
which puts out the links that join components. A tile's commonest component need
not meet itself, so its blocks only meet the blocks of the others. Nothing is
capped: every pair that shares a key is equal in component, ruled out by its bound,
or settled.

Defined cases: NULL or wordless texts have an empty set and link with nothing; a
text of fewer words than n has its whole word sequence as the one member; rows
with a NULL id take part like others and are never named as the smallest (a
component of such rows alone is NULL); repeated rows get the same component;
several texts under one id are each compared; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, slices
from tidemark.llm.components import components
from tidemark.runtime import stage

BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 1024
SAMPLE_DOCS, SHARED_BY, SHARED_MOST = 5_000, 3, 200_000
FILTER_ROWS = 4_000_000
MEET_ROWS = 256
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# ---- sets --------------------------------------------------------------------
class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000 and len(word) <= 64:
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def ngram_set(text: str | None, n: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    found = text.encode().lower().split() if text else []  # bytes: folds A-Z and splits at ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = _mix(h * _M2 + w[i : len(w) - size + 1 + i])
    return np.unique(h)


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(hashes.tobytes())
    a, b = np.frombuffer(d, np.int64)
    return int(a), int(b)


def _bitmap(hashes: np.ndarray) -> bytes:
    width = max(64, 1 << (4 * len(hashes) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(hashes % np.uint64(width)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _counts(hashes: np.ndarray, percent: int) -> bytes:
    """Members by bucket, 255 for that and more; buckets enough that sets with little in common differ by twice what a link allows."""
    slack = (100 - percent) / (100 + percent)
    width = max(32, 1 << int(13 * slack * slack * len(hashes)).bit_length())
    return np.minimum(np.bincount((hashes % np.uint64(width)).astype(np.int64), minlength=width), 255).astype(np.uint8).tobytes()


_NODE = [("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())]


def _digests(n: int, percent: int):
    """Every row's digest; its bitmap and counts with the first row of a task that has this digest."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), *_NODE, ("bitmap", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _WordHashes(), set()
        for batch in slices(batches):
            rows = []
            for doc, h, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "h", "text"))):
                s = ngram_set(text, n, hashes)
                d = _digest(s)
                fresh = len(s) and d not in seen
                if fresh:
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(d)
                rows.append((doc, h, len(s), *d, *((_bitmap(s), _counts(s, percent)) if fresh else (None, None))))
            yield _batch(rows, schema)

    return run


# ---- keys ------------------------------------------------------------------------
def first_members(size: int, percent: int) -> tuple[int, int]:
    """How many first members a set needs as the larger, and as the smaller one of a link."""
    larger = size + percent * size // -100 + 1
    smaller = size + 2 * percent * size // -(100 + percent) + 1
    return larger, smaller


def keys_of(hashes: np.ndarray, percent: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set's first members in the order of all n-grams, and which of them hold as the smaller set."""
    larger, smaller = first_members(len(hashes), percent)
    late = shared[np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)] == hashes if len(shared) else np.zeros(len(hashes), bool)
    keys = np.concatenate([hashes[~late], hashes[late]])[:larger]
    return keys, np.arange(len(keys)) < smaller


def _sampled(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in slices(batches):
            found = [ngram_set(x, n, hashes) for x in batch["text"].to_pylist()]
            gram, count = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(count)], names=["gram", "n"])

    return run


def _keys(n: int, percent: int, shared):
    schema = pa.schema([("key", pa.int64()), ("d1", pa.int64()), ("small", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _WordHashes(), set()
        for batch in slices(batches):
            keys, d1, small = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
            for text in batch["text"].to_pylist():
                s = ngram_set(text, n, hashes)
                d = _digest(s)
                if not len(s) or d in seen:
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(d)
                k, as_small = keys_of(s, percent, shared.value)
                keys.append(k)
                small.append(as_small)
                d1.append(np.full(len(k), d[0]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(d1)), pa.array(np.concatenate(small))], schema=schema)

    return run


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, small first, d1): the distinct ones whose key has a small row and two nodes or more."""
    held = None  # the last row, which goes out when the next one has its key, and whether its key has a small row
    sent = led = False
    for batch in batches:
        k, d, small = (batch[c].to_numpy(zero_copy_only=False) for c in ("key", "d1", "small"))
        if not len(k):
            continue
        if held is not None:
            k, d, small = (np.concatenate([[h], x]) for h, x in zip(held, (k, d, small)))
        lead = np.concatenate([[True], k[1:] != k[:-1]])
        ok = np.maximum.accumulate(np.where(lead, np.arange(len(k)), 0))
        ok = (small & lead)[ok] if held is None else np.where(ok == 0, led, (small & lead)[ok])
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
        k, d, small, ok = k[fresh], d[fresh], small[fresh], ok[fresh]
        same = k[1:] == k[:-1]
        out = np.zeros(len(k), bool)
        out[1:] |= same
        out[:-1] |= same
        out &= ok
        last_sent = bool(out[-1]) or (len(k) == 1 and sent)
        out[0] &= not sent
        held, sent, led = (k[-1], d[-1], small[-1]), last_sent, bool(ok[-1])
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (k, d, small)], names=["key", "d1", "small"])


def _folded_counts(data: np.ndarray, at: np.ndarray, widths: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of ``rows`` in ``width`` buckets, and whether all of them are exact."""
    out, exact = np.empty((len(rows), width), np.int32), np.empty(len(rows), bool)
    for w in np.unique(widths[rows]):
        own = np.flatnonzero(widths[rows] == w)
        found = data[at[rows[own], None] + np.arange(w)]
        out[own] = found.reshape(len(own), -1, width).sum(axis=1, dtype=np.int32)
        exact[own] = (found < 255).all(axis=1)
    return out, exact


def _have_partner(key, size, small, counts: list[bytes], percent: int) -> np.ndarray:
    """Of rows sorted by key: those with a row of their key that, by sizes and counts, they may link with."""
    keep = np.zeros(len(key), bool)
    widths = np.fromiter(map(len, counts), np.int64, len(counts))
    data, at = np.frombuffer(b"".join(counts), np.uint8), np.cumsum(widths) - widths
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    after = ends[np.searchsorted(ends, np.arange(len(key)), side="right")] - 1 - np.arange(len(key))
    i = np.arange(len(key))
    for step in range(1, int(after.max(initial=0)) + 1):
        i = i[after[i] >= step]
        one = i[~(keep[i] & keep[i + step])]
        a, b = size[one], size[one + step]
        fit = (small[one] & (b >= a) & (percent * b <= 100 * a)) | (small[one + step] & (a >= b) & (percent * a <= 100 * b))
        one = one[fit]
        width = np.minimum(widths[one], widths[one + step])
        for w in np.unique(width):
            left, most = one[width == w], max(1, (1 << 20) // int(w))
            for part in (left[k : k + most] for k in range(0, len(left), most)):
                (x, x_exact), (y, y_exact) = (_folded_counts(data, at, widths, rows, int(w)) for rows in (part, part + step))
                more = x - y
                only_x = np.where(x_exact & y_exact, np.maximum(more, 0).sum(axis=1), 0)
                only_y = np.where(x_exact & y_exact, np.maximum(-more, 0).sum(axis=1), 0)
                a, b = size[part], size[part + step]
                allowed = part[_links(_most_common(a, b, only_x, only_y), a, b, percent)]
                keep[allowed] = keep[allowed + step] = True
    return keep


def _partnered(percent: int):
    """Rows (key, node, n, small, counts) sorted by key -> without counts, those that may link under their key. Of a key
    with over MEET_ROWS rows all go on."""
    names = ["key", "node", "n", "small"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, through = None, None  # the last key's rows so far; a key too common to be looked at
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if through is not None:
                other = int(np.searchsorted(rows["key"].to_numpy(), through, side="right"))
                yield from rows.slice(0, other).select(names).to_batches()
                rows = rows.slice(other)
            if held is not None:
                rows = pa.concat_tables([held, rows])
            if not rows.num_rows:
                continue
            key = rows["key"].to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            held, through = rows.slice(last), None
            yield from settle(rows.slice(0, last))
            if held.num_rows > MEET_ROWS:
                yield from held.select(names).to_batches()
                held, through = None, key[-1]
        if held is not None:
            yield from settle(held)

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, size, small = (rows[c].to_numpy() for c in ("key", "n", "small"))
        _, nth, of = np.unique(key, return_inverse=True, return_counts=True)
        common = of[nth] > MEET_ROWS
        keep, few = common.copy(), np.flatnonzero(~common)
        keep[few] = _have_partner(key[few], size[few], small[few], rows["counts"].take(pa.array(few)).to_pylist(), percent)
        yield from rows.select(names).filter(pa.array(keep)).to_batches()

    return run


def _band_edges(percent: int) -> list[int]:
    edges = [1]  # at 100 percent only equal sets link, and they are one node
    while percent < 100 and edges[-1] < 1 << 40:
        edges.append(100 * edges[-1] // percent + 1)
    return edges


def _tiles(groups: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, small) -> rows (key, band, node, n, small) of tiles that may hold a link.

    A set is in two bands at most: its own, where it may be the smaller one, and the
    one below. Near copies share many keys, and so would meet in as many tiles: of
    tiles with equal rows one is kept.
    """
    edges = ", ".join(f"{e}L" for e in _band_edges(percent))
    banded = groups.withColumn("own", F.expr(f"size(filter(array({edges}), e -> e <= n))"))
    each = banded.select("key", "node", "n", F.col("small").alias("leads"), "own", F.explode(F.array("own", F.col("own") - 1)).alias("band"))
    each = each.select("key", "band", "node", "n", (F.col("own") == F.col("band")).alias("small"), (F.col("leads") & (F.col("own") == F.col("band"))).alias("leads"))
    each = stage(each, "tile-rows")
    who = [F.bit_xor(F.xxhash64(F.lit(seed), "node", "small")).alias(f"who{seed}") for seed in (1, 2)]
    kinds = each.groupBy("key", "band").agg(F.count(F.lit(1)).alias("m"), F.max("leads").alias("leads"), *who).filter("m > 1 AND leads")
    kept = kinds.groupBy("band", "m", "who1", "who2").agg(F.min("key").alias("key"))
    return each.join(kept.select("key", "band"), ["key", "band"]).select("key", "band", "node", "n", "small")


# ---- bounds and exact test ----------------------------------------------------
def _folded(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to the narrowest."""
    width = min(map(len, bitmaps)) // 8
    rows = np.zeros((len(bitmaps), width), np.uint64)
    for i, x in enumerate(bitmaps):
        rows[i] = np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, width), axis=0)
    return rows


def _most_common(size_a, size_b, only_a, only_b):
    """Upper bound of the intersection from bits that one side alone has."""
    return np.minimum(size_a - only_a, size_b - only_b)


def _links(common, size_a, size_b, percent: int):
    return 100 * common >= percent * (size_a + size_b - common)


def _exact(a: bytes, b: bytes, percent: int) -> bool:
    one, other = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    common = len(np.intersect1d(one, other, assume_unique=True))
    return bool(_links(common, len(one), len(other), percent))


class _Block:
    """Rows of one block of a tile: who may be whose partner."""

    def __init__(self, rows: list[tuple], percent: int):
        self.node, self.label, self.size = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
        self.small, self.side = np.array([r[3] for r in rows], bool), np.array([r[4] for r in rows])
        self.bits, self.percent = _folded([r[5] for r in rows]), percent
        self.cross = len(np.unique(self.side)) > 1

    def partners(self, i: int) -> np.ndarray:
        """Larger sets of other components that the bound allows, most alike first."""
        at = (self.size >= self.size[i]) & (self.percent * self.size <= 100 * self.size[i]) & (self.label != self.label[i])
        if self.cross:
            at &= self.side != self.side[i]
        at = np.flatnonzero(at)
        if not len(at):
            return at
        only_i = np.bitwise_count(self.bits[i] & ~self.bits[at]).sum(axis=1, dtype=np.int64)
        only_at = np.bitwise_count(self.bits[at] & ~self.bits[i]).sum(axis=1, dtype=np.int64)
        bound = _most_common(self.size[i], self.size[at], only_i, only_at)
        allowed = _links(bound, self.size[i], self.size[at], self.percent)
        at, bound = at[allowed], bound[allowed]
        return at[np.lexsort((self.node[at], -bound))]

    def join(self, i: int, j: int) -> None:
        self.label[self.label == self.label[j]] = self.label[i]

    def forest(self) -> list[tuple]:
        """Pairs that would join the block's components, were all allowed pairs links."""
        out = []
        for i in np.flatnonzero(self.small):
            at = self.partners(i)
            while len(at):
                out.append((int(self.node[i]), int(self.node[at[0]])))
                self.join(i, at[0])
                at = at[self.label[at] != self.label[i]]
        return out

    def open_rows(self) -> np.ndarray:
        """Rows with an allowed partner in another component."""
        seen = np.zeros(len(self.node), bool)
        for i in np.flatnonzero(self.small):
            at = self.partners(i)
            seen[at] = True
            seen[i] |= len(at) > 0
        return np.flatnonzero(seen)

    def links(self, members: list[bytes]) -> list[tuple]:
        """Links that join components; every allowed pair across components is settled."""
        out = []
        for i in np.flatnonzero(self.small):
            for j in self.partners(i):
                if self.label[i] != self.label[j] and _exact(members[i], members[j], self.percent):
                    out.append((int(self.node[i]), int(self.node[j])))
                    self.join(i, j)
        return out


_ROW = ["node", "component", "n", "small", "side", "bitmap"]


def _by_block(columns: list[str], extra: list[str], schema: pa.Schema, settle):
    """Rows sorted by the block's ``columns`` -> what ``settle(key, rows, extras)`` makes of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, extras, out = None, [], [], []
        for batch in slices(batches, 1024):
            keys = zip(*(batch[c].to_pylist() for c in columns))
            more = zip(*(batch[c].to_pylist() for c in extra)) if extra else iter(lambda: (), None)
            for key, row, x in zip(keys, zip(*(batch[c].to_pylist() for c in _ROW)), more):
                if key != block:
                    if len(rows) > 1:
                        out.extend(settle(block, rows, extras))
                    block, rows, extras = key, [], []
                rows.append(row)
                extras.append(x)
            if out:
                yield _batch(out, schema)
                out = []
        if len(rows) > 1:
            out.extend(settle(block, rows, extras))
        yield _batch(out, schema)

    return run


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forests(percent: int):
    return _by_block(["key", "band", "block"], [], _PAIR, lambda key, rows, _: _Block(rows, percent).forest())


def _open(percent: int):
    schema = pa.schema([("key", pa.int64()), ("band", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), *((c, t) for c, t in zip(_ROW[:-1], (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32())))])

    def settle(key, rows, _):
        return [(*key, *rows[k][:-1]) for k in _Block(rows, percent).open_rows()]

    return _by_block(["key", "band", "i", "j"], [], schema, settle)


def _settled(percent: int):
    return _by_block(["key", "band", "i", "j"], ["members"], _PAIR, lambda key, rows, extras: _Block(rows, percent).links([x[0] for x in extras]))


def _verified(percent: int):
    """Rows (a, b, node, members) sorted by pair, one for each side -> the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in slices(batches):
            linked = []
            for a, b, node, members in zip(*(batch[c].to_pylist() for c in ("a", "b", "node", "members"))):
                if held is not None and held[:2] == (a, b) and held[2] != node and _exact(held[3], members, percent):
                    linked.append((a, b))
                held = (a, b, node, members)
            yield _batch(linked, _PAIR)

    return run


# ---- the operator ------------------------------------------------------------
def _members(work: DataFrame, nodes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, members, bitmap) of the wanted nodes. Texts stay where they are: a broadcast set of
    text hashes, bounded in size, spares most of them; the exact join follows."""
    wanted = nodes.join(wanted.select("node").distinct(), "node").select("node", "d1", "d2", "h")
    hashes = wanted.select("h").limit(FILTER_ROWS + 1).toArrow()["h"].to_numpy()
    shared = work.sparkSession.sparkContext.broadcast(np.sort(hashes) if len(hashes) <= FILTER_ROWS else None)
    schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("members", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _WordHashes(), set()
        for batch in batches:
            if shared.value is not None:
                h = batch["h"].to_numpy()
                batch = batch.filter(pa.array(np.isin(h, shared.value)))
            for part in slices(iter([batch])):
                rows = []
                for h, text in zip(part["h"].to_pylist(), part["text"].to_pylist()):
                    copy = (h, hash(text))
                    s = () if copy in seen else ngram_set(text, n, words)
                    if len(s):
                        if len(seen) >= 500_000:
                            seen.clear()
                        seen.add(copy)
                        rows.append((*_digest(s), s.tobytes()))
                yield _batch(rows, schema)

    found = work.select("h", "text").mapInArrow(run, "d1 long, d2 long, members binary")
    return found.join(wanted.select("node", "d1", "d2"), ["d1", "d2"]).dropDuplicates(["node"]).select("node", "members")


def _dealt() -> Column:
    """Blocks for a tile's rows: bounded in number of rows and in bytes."""
    return F.ceil(F.count(F.lit(1)) / F.min(F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / F.greatest(F.lit(64), F.col("n"))))))).cast("int")


def _cells(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of tiles that hold several components, once for each pair of blocks that must meet."""
    rows = tiles.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counted = rows.groupBy("key", "band", "component").agg(F.count(F.lit(1)).alias("m"), F.max("small").alias("small"), F.max("n").alias("n"))
    per = F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / F.greatest(F.lit(64), F.max("n")))))
    spans = counted.groupBy("key", "band").agg(
        F.count(F.lit(1)).alias("components"), F.max_by("component", F.struct("m", "component")).alias("major"), F.max("m").alias("majors"), F.sum("m").alias("all"), F.max("small").alias("any_small"), per.alias("per")
    ).filter("components > 1 AND any_small")
    spans = spans.select("key", "band", "major", F.ceil(F.col("majors") / F.col("per")).cast("int").alias("mb"), F.ceil((F.col("all") - F.col("majors")) / F.col("per")).cast("int").alias("ob"))
    rows = rows.join(spans, ["key", "band"])
    major = F.col("component") == F.col("major")
    block = F.pmod(F.xxhash64("node"), F.when(major, F.col("mb")).otherwise(F.col("ob"))).cast("int")
    rows = rows.withColumn("block", block)
    # cells (i, j): blocks of the others among themselves, i <= j < ob; block i of the others with block j - ob of the major ones
    with_others = F.transform(F.sequence(F.lit(0), F.col("ob") - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j"), (F.col("block") > k).cast("int").alias("side")))
    with_majors = F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda k: F.struct(F.col("block").alias("i"), (F.col("ob") + k).alias("j"), F.lit(0).alias("side")))
    from_majors = F.transform(F.sequence(F.lit(0), F.col("ob") - 1), lambda k: F.struct(k.alias("i"), (F.col("ob") + F.col("block")).alias("j"), F.lit(1).alias("side")))
    cells = F.when(major, from_majors).otherwise(F.concat(with_others, with_majors))
    return rows.select("key", "band", "node", "component", "n", "small", F.explode(cells).alias("t")).select("key", "band", "t.i", "t.j", "node", "component", "n", "small", "t.side")


def classes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, h, n, component) for every row: h is ``xxhash64(text)``, component a number (NULL for an empty set)."""
    spark = docs.sparkSession
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    digests = stage(work.mapInArrow(_digests(n, percent), "doc_id long, h long, n long, d1 long, d2 long, bitmap binary, counts binary"), "digests")
    nodes = digests.filter("n > 0").groupBy("d1", "d2").agg(F.max("n").alias("n"), F.min("h").alias("h"), F.max("bitmap").alias("bitmap"), F.max("counts").alias("counts"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    sample = bounded_sample(work.filter(F.col("text").isNotNull()), F.col("h"), SAMPLE_DOCS).select("text")
    common = sample.mapInArrow(_sampled(n), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= SHARED_BY)
    common = common.orderBy(F.desc("n"), "gram").limit(SHARED_MOST).select("gram").toArrow()["gram"].to_numpy()
    order = spark.sparkContext.broadcast(np.sort(common.astype(np.int64).view(np.uint64)))
    keys = work.select("text").mapInArrow(_keys(n, percent, order), "key long, d1 long, small boolean")
    shared = keys.repartition("key").sortWithinPartitions("key", F.desc("small"), "d1").mapInArrow(_shared_keys, "key long, d1 long, small boolean")
    met = shared.join(nodes.select("d1", "node", "n", "counts"), "d1").select("key", "node", "n", "small", "counts")
    groups = met.repartition("key").sortWithinPartitions("key").mapInArrow(_partnered(percent), "key long, node long, n long, small boolean")
    tiles = stage(_tiles(groups, percent), "tiles")

    # one pass of forests inside blocks, settled exactly
    alive = tiles.groupBy("key", "band").agg(_dealt().alias("blocks"))
    dealt = tiles.join(alive.select("key", "band", "blocks"), ["key", "band"]).withColumn("block", F.pmod(F.xxhash64("key", "node"), F.col("blocks")).cast("int"))
    bitmaps = nodes.select("node", "bitmap")
    rows = dealt.join(bitmaps, "node").select("key", "band", "block", "node", F.col("node").alias("component"), "n", "small", F.lit(0).alias("side"), "bitmap")
    forest = rows.repartition("key", "band", "block").sortWithinPartitions("key", "band", "block").mapInArrow(_forests(percent), "a long, b long")
    forest = stage(forest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "forest")
    ends = forest.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    sides = ends.join(_members(work, nodes, ends, n), "node").select("a", "b", "node", "members")
    links = stage(sides.repartition("a", "b").sortWithinPartitions("a", "b", "node").mapInArrow(_verified(percent), "a long, b long"), "links")
    labels = stage(components(links), "labels").select(F.col("id").alias("node"), "component")

    # what still may link components is settled inside its tile
    cells = _cells(tiles, labels).join(bitmaps, "node").select("key", "band", "i", "j", *_ROW)
    left = cells.repartition("key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j")
    left = stage(left.mapInArrow(_open(percent), "key long, band int, i int, j int, node long, component long, n long, small boolean, side int"), "open-rows")
    full = left.join(_members(work, nodes, left, n), "node").join(bitmaps, "node").select("key", "band", "i", "j", *_ROW, "members")
    more = full.repartition("key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j").mapInArrow(_settled(percent), "a long, b long")
    labels = stage(components(stage(links.union(more), "links")), "labels").select(F.col("id").alias("node"), "component")

    named = nodes.join(labels, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component"))
    return digests.select("doc_id", "h", "n", "d1", "d2").join(named, ["d1", "d2"], "left").select("doc_id", "h", "n", "component")


def join_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    rows = stage(classes(docs, n, percent), "classes")
    smallest = rows.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = rows.join(smallest, "component", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, the one with the smallest id (NULL ids last, ties by text hash).

    Rows with an empty set stay, once for each id and text.
    """
    rows = classes(docs, n, percent)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("x")
    linked = rows.filter("n > 0").groupBy("component").agg(best).select("x.doc_id", "x.h")
    keep = linked.union(rows.filter("n = 0").select("doc_id", "h").distinct())
    # hash columns of both sides: NULL ids meet too, and the window needs no other exchange
    keep = keep.select(F.coalesce("doc_id", "h").alias("__k"), F.col("h").alias("__h"), F.col("doc_id").isNull().alias("__none"))
    own = docs.withColumns({"__h": F.xxhash64("text"), "__none": F.col("doc_id").isNull()}).withColumn("__k", F.coalesce(F.col("doc_id").cast("long"), F.col("__h")))
    copy = F.row_number().over(Window.partitionBy("__k", "__h", "__none").orderBy(F.lit(1)))
    return own.join(keep, ["__k", "__h", "__none"], "left_semi").withColumn("__copy", copy).filter("__copy = 1").select(*[F.col(f"`{c}`") for c in docs.columns])

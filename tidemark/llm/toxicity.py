"""Toxicity of documents by noisy-channel deobfuscation and a sparse classifier.

1. **Channel.** Text may be disguised: digits and signs for letters, letters set
   apart, letters repeated. Only spans that look like that are decoded (a sign or
   digit beside a letter, one letter twice, a row of single letters however wide
   its gaps; punctuation around them and a first single letter are tried as not
   belonging to them).
   A span becomes a lattice: each character may stand for itself, for the letters
   it resembles, for a repetition of the letter before, for nothing or for the end
   of a word. Spans are read to their end. Viterbi finds the cheapest path under a character trigram model, whose counts come from
   all texts of the input.
2. **Score.** The words of the document and of its decoded spans, with their first
   four and five letters, are looked up in the weights of a logistic regression
   with an L1 penalty. The penalty leaves weight on what toxic documents share in
   general and none on words that merely stand in one family of copies.

The classifier is fitted on at most about ``max_labels`` labelled documents
(a bounded sample); of its features at most ``max_features`` are kept. The trigram
table has a fixed size.

Defined cases: NULL, empty and wordless texts score the prior of no evidence;
without a usable label in both classes every score is 0; NULL ids are held out;
repeated rows score alike; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, slices
from tidemark.runtime import stage

# Signs that stand for letters.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e"}
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
SIZE = len(LETTERS) + 1  # 0 is everything else
_INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
_CODES = np.zeros(0x10000, np.int64)
for _c, _i in _INDEX.items():
    _CODES[ord(_c)] = _i

_A = r"[^\W_]"
# Single letters or digits set apart by anything else, with a sign on either side.
SPACED = re.compile(f"{_A}(?!{_A})(?<!{_A}{_A})(?:[\\W_]++{_A}(?!{_A})){{2,}}")
_BEFORE, _AFTER = re.compile(r"[@$!|+(€]\s*$"), re.compile(f"\\s*+[@$!|+(€](?!{_A})")
_PUNCTUATION = re.compile("(?:[^\\w" + re.escape("".join(LOOKS_LIKE)) + "]|_)+")
_GAP = re.compile(r"[\W_]+")
_PLAIN = re.compile(f"(?:([{LETTERS}])(?!\\1))*+")  # letters, none of them twice in a row
_DOUBLES = re.compile(f"([{LETTERS}])\\1")
_LETTERS_ONLY = re.compile(f"(?:([{LETTERS}])(?!\\1\\1))++")  # none of them three times in a row
_SIGNS = re.compile("[" + re.escape("".join(LOOKS_LIKE)) + "]")
_LETTER = re.compile(f"[{LETTERS}]")
_SIMPLE = re.compile(f"[^\\w!(@$|+€]*+(?:([{LETTERS}])(?!\\1))*+[^\\w!(@$|+€]*+")
_OUTER = ".,;:?)[]{}<>\"'`«»“”„‘’…¿¡"  # punctuation that resembles no letter
WORD = re.compile(r"[^\W\d_]+")
SPELT, SIGN_COST, DROP_COST, REPEAT_COST, BEAM = 0.0, 1.0, 0.7, 0.4, 24


# ---- character model -----------------------------------------------------------
def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE**3, np.int64)
    for batch in slices(batches):
        joined = "  ".join(x.lower() for x in batch["text"].to_pylist() if x)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = _CODES[np.minimum(points, 0xFFFF)]
        if len(c) > 2:
            total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """-log p(next | two before) as a (SIZE, SIZE, SIZE) table, counted over all texts."""
    rows = docs.select("text").mapInArrow(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most SIZE^3 rows
    counts = np.zeros(SIZE**3)
    for r in rows:
        counts[r["gram"]] = r["n"]
    counts = counts.reshape(SIZE, SIZE, SIZE)
    one = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + SIZE)
    two = counts.sum(axis=0)
    two = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
    three = (counts + 5 * two) / (counts.sum(axis=2, keepdims=True) + 5)
    return -np.log(three).astype(np.float32)


@lru_cache(maxsize=100_000)
def _arcs(ch: str, last: int, breaks: bool, signs: bool) -> tuple[tuple[int, float], ...]:
    """What a character may stand for: (letter, 0 for the end of a word or -1 for nothing, cost)."""
    own = _INDEX.get(ch, 0)
    arcs = [(own, SPELT)] if own else []
    arcs += [(_INDEX[x], SIGN_COST) for x in LOOKS_LIKE.get(ch, "")]
    if signs and ch in LOOKS_LIKE:
        arcs += [(-1, REPEAT_COST)] if last and LETTERS[last - 1] in LOOKS_LIKE[ch] else []
    elif not own:
        drop = DROP_COST * 3 if ch in LOOKS_LIKE or ch.isalnum() else DROP_COST / 2
        arcs.append((-1, drop))
        if breaks and last:
            arcs.append((0, drop))
    elif own == last:
        arcs.append((-1, REPEAT_COST))
    return tuple(arcs)


def decode(span: str, cost: list[float], breaks: bool = True, signs: bool = False) -> list[str]:
    """The words of the cheapest reading of a span. Paths that end in the same two letters meet.

    ``cost`` is the flat table of the character model. Without ``breaks`` the span
    is one word; with ``signs`` each sign stands for a letter. Work and memory are linear in the span's length.
    """
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for ch in span:
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (c, read) in paths.items():
            base = (a * SIZE + b) * SIZE
            for letter, extra in _arcs(ch, b, breaks, signs):
                state = (a, b) if letter < 0 else (b, letter)
                total = c + extra + (0.0 if letter < 0 else cost[base + letter])
                if state not in nxt or total < nxt[state][0]:
                    nxt[state] = (total, read if letter < 0 else (read, letter))
        paths = nxt if len(nxt) <= BEAM else dict(sorted(nxt.items(), key=lambda x: x[1][0])[:BEAM])
    read = min(((c + (cost[(a * SIZE + b) * SIZE] if b else 0.0), i, read) for i, ((a, b), (c, read)) in enumerate(paths.items())), key=lambda x: x[:2])[2]
    letters = []
    while read is not None:
        read, letter = read
        letters.append(LETTERS[letter - 1] if letter else " ")
    return "".join(reversed(letters)).split()


def undoubled(word: str) -> set[str]:
    """The word with each choice of its doubled letters written once."""
    found = {""}
    at = 0
    for m in _DOUBLES.finditer(word):
        found = {x + word[at : m.start()] + y for x in found for y in (m.group(1), m.group())}
        at = m.end()
    return {x + word[at:] for x in found}


class Restorer:
    """Words of a text with its disguised spans read; tokens are judged and decoded once per worker."""

    LIMIT = 500_000

    def __init__(self, cost: np.ndarray):
        self.cost, self.known, self.plain = cost.ravel().tolist(), {}, set()
        self.spans: dict[str, frozenset[str]] = {}

    def read(self, span: str) -> frozenset[str]:
        """The span read as one word, also with every sign as a letter, and as several words."""
        if _LETTERS_ONLY.fullmatch(span) and len(_DOUBLES.findall(span)) < 4:
            return frozenset(undoubled(span))
        read = self.spans.get(span)
        if read is None:
            found = set(decode(span, self.cost, breaks=False))
            if _SIGNS.search(span):
                found.update(decode(span, self.cost, breaks=False, signs=True))
            if _GAP.search(span):
                found.update(decode(span, self.cost))
            read = frozenset(found)
            if len(span) <= 200:
                if len(self.spans) > self.LIMIT // 5:
                    self.spans.clear()
                self.spans[span] = read
        return read

    def token(self, token: str) -> tuple[str, ...]:
        """Readings of what stands between white space: with and without the signs at its ends that may be punctuation."""
        if _SIMPLE.fullmatch(token):
            return ()
        outer = token.strip(_OUTER)
        inner = outer.strip(_OUTER + "!(")
        spans = {inner, *_PUNCTUATION.split(inner)}
        if outer != inner and inner:  # a sign at an end is a letter here, and was punctuation in the inner part
            if outer[0] in "!(" and outer[1] == inner[0]:
                spans |= {x + inner for x in LOOKS_LIKE[outer[0]]}
            if outer[-1] in "!(" and outer[-2] == inner[-1]:
                spans |= {inner + x for x in LOOKS_LIKE[outer[-1]]}
        found: set[str] = set()
        for span in spans:
            if _LETTER.search(span):
                found |= {span} if _PLAIN.fullmatch(span) else self.read(span)
        return tuple(found.difference(WORD.findall(token)))

    def spaced(self, span: str, inner: str) -> set[str]:
        """Readings of letters set apart: with and without signs at the ends, without the first letter, and cut at the wider gaps."""
        gaps = [len(x) for x in _GAP.findall(inner)]
        pieces, least = [""], min(gaps)
        for part in re.split(r"([\W_]+)", inner):
            if len(part) > least and not part.isalnum():
                pieces.append("")
            else:
                pieces[-1] += part
        found: set[str] = set()
        for variant in {span, inner, _GAP.split(inner, maxsplit=1)[1], *pieces}:
            found |= self.read(variant)
        return found

    def words(self, text: str) -> set[str]:
        text = text.lower()
        found = set(WORD.findall(text))
        for token in set(text.split()) - self.plain:
            read = self.known.get(token)
            if read is None:
                read = self.token(token)
                if len(token) <= 200:
                    if len(self.known) + len(self.plain) > self.LIMIT:
                        self.known.clear()
                        self.plain.clear()
                    if read:
                        self.known[token] = read
                    else:
                        self.plain.add(token)
            found.update(read)
        for m in SPACED.finditer(text):
            before, after = _BEFORE.search(text, max(0, m.start() - 8), m.start()), _AFTER.match(text, m.end())
            found |= self.spaced(text[before.start() if before else m.start() : after.end() if after else m.end()], m.group())
        return found


def features(word: str) -> tuple[str, ...]:
    return (word[:40], f"{word[:4]}*", f"{word[:5]}*") if len(word) > 4 else (word,)


# ---- classifier ----------------------------------------------------------------
@dataclass
class ToxicityModel:
    cost: np.ndarray = field(repr=False)
    weights: dict[str, float] = field(repr=False)
    bias: float

    def score(self, found: set[str], memo: dict[str, tuple]) -> float:
        if not self.weights:
            return 0.0
        hit: set[str] = set()
        for word in found:
            known = memo.get(word)
            if known is None:
                known = tuple(f for f in features(word) if f in self.weights)
                if len(memo) < 400_000:
                    memo[word] = known
            if known:
                hit.update(known)
        z = self.bias + sum(map(self.weights.get, sorted(hit)))
        return float(1.0 / (1.0 + np.exp(-z)))


def _sparse_logistic(docs: list[list[int]], y: np.ndarray, size: int, penalty: float = 0.5, rounds: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression over binary features, by accelerated proximal steps."""
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    col = np.concatenate([np.asarray(d, np.int64) for d in docs]) if len(row) else np.empty(0, np.int64)
    prior = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    w, b, v, vb, t = np.zeros(size), prior, np.zeros(size), prior, 1.0
    # a bound of the curvature: power iteration on X'X
    x = np.ones(size)
    for _ in range(12):
        z = np.bincount(row, x[col], len(docs))
        x = np.bincount(col, z[row], size)
        norm = np.linalg.norm(x) or 1.0
        x /= norm
    step = 1.0 / (0.25 * norm + 0.25 * len(docs))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(vb + np.bincount(row, v[col], len(docs)))))
        g = np.bincount(col, (p - y)[row], size)
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = vb - step * (p - y).sum()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / s * (new - w), nb + (t - 1) / s * (nb - b)
        w, b, t = new, nb, s
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, max_labels: int = 8_000, max_features: int = 20_000) -> ToxicityModel:
    """Learn from rows of ``docs`` (doc_id, text) with a label (doc_id, toxic) where ``usable`` holds."""
    spark = docs.sparkSession
    cost = character_model(docs)
    shared = spark.sparkContext.broadcast(cost)
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = {r["doc_id"]: r["toxic"] for r in bounded_sample(marked, F.col("doc_id"), max_labels).collect()}  # about max_labels pairs of numbers
    wanted = spark.createDataFrame(list(ids.items()), "doc_id long, toxic int") if ids else None
    if wanted is None or len(set(ids.values())) < 2:
        return ToxicityModel(cost, {}, 0.0)
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in slices(batches):
            found = [sorted({f for w in restorer.words(x or "") for f in features(w)}) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(found, pa.list_(pa.string()))], names=["doc_id", "toxic", "features"])

    spread_rows = stage(rows.mapInArrow(spread, "doc_id long, toxic int, features array<string>"), "toxicity-features")
    each = spread_rows.select("toxic", F.explode("features").alias("feature"))
    counts = each.groupBy("feature").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    share = sum(ids.values()) / len(ids)
    gain = F.col("t") - F.lit(share) * F.col("n")  # more often toxic than its count explains
    chosen = counts.filter("t >= 3").orderBy(F.desc(gain / F.sqrt(F.col("n"))), "feature").limit(max_features).select("feature").collect()
    index = {r["feature"]: i for i, r in enumerate(chosen)}
    known = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = known.value
        for batch in slices(batches):
            found = [[at[f] for f in fs if f in at] for fs in batch["features"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(found, pa.list_(pa.int32()))], names=["toxic", "at"])

    table = spread_rows.mapInArrow(place, "toxic int, at array<int>").collect()  # the bounded sample, as numbers
    if len({r["toxic"] for r in table}) < 2:
        return ToxicityModel(cost, {}, 0.0)
    w, b = _sparse_logistic([r["at"] for r in table], np.array([r["toxic"] for r in table], float), len(index))
    names = list(index)
    return ToxicityModel(cost, {names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-9)}, b)



def predict(docs: DataFrame, model: ToxicityModel, keep: list[Column]) -> DataFrame:
    """``keep`` plus ``score`` for every row; only ``text`` is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    work = docs.select(*keep, F.col("text").alias("__text"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in work.schema[:-1])}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        restorer, memo = Restorer(m.cost), {}
        for batch in slices(batches):
            scores = [m.score(restorer.words(x or ""), memo) for x in batch["__text"].to_pylist()]
            kept = batch.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(scores, pa.float64())], names=[*kept.schema.names, "score"])

    return work.mapInArrow(run, schema)

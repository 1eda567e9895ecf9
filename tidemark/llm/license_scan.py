"""License scan by ordered signature rules.

Hundreds of patterns stand in ``license_rules``. One pass of an Aho-Corasick
automaton over the words of a text finds which keywords it holds; only the rules
of those keywords are tried. Of the detections that result, one is dropped if it
lies inside another of higher priority, or of equal priority and greater length,
or of equal both and an earlier rule. Base phrases are counted apart from that, all
places of them, and their labels always stay.

The work is narrow: a row's result needs its own text only.

Defined cases: a NULL or wordless text has no labels (empty strings), no places
(NULL positions) and score 0; repeated rows and NULL ids pass through; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.llm.license_rules import BASE, expanded

# A-Z fold to a-z; digits, letters and every byte of a non-ASCII character are parts of words
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@lru_cache(maxsize=1)
def _compiled():
    import ahocorasick

    rules = [(p, label, re.compile(f"(?<= ){pattern}(?= )")) for p, label, _, pattern in expanded()]
    by_keyword: dict[str, list[int]] = {}
    for i, (_, _, keyword, _) in enumerate(expanded()):
        by_keyword.setdefault(keyword, []).append(i)
    automaton = ahocorasick.Automaton()
    for keyword in [*by_keyword, *BASE]:
        automaton.add_word(f" {keyword}", keyword)
    automaton.make_automaton()
    return rules, by_keyword, automaton


def _kept(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Detections (start, end, priority, rule) that lie inside no stronger one."""
    ordered = sorted(found, key=lambda d: (-d[2], -(d[1] - d[0]), d[3], d[0]))
    longest = max((d[1] - d[0] for d in found), default=0)
    kept: list[tuple[int, int, int, int]] = []
    near: dict[int, list[tuple[int, int]]] = {}  # kept spans by where they start
    for d in ordered:
        cells = range((d[0] - longest) // 256, d[0] // 256 + 1)
        if not any(a <= d[0] and d[1] <= b for c in cells for a, b in near.get(c, ())):
            kept.append(d)
            near.setdefault(d[0] // 256, []).append(d[:2])
    return kept


def scan(text: str) -> tuple[int, list[int], set[str], set[str], float]:
    """(words, starts of base phrases, base labels, all labels, score) of one text."""
    split = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    joined = b" %s " % b" ".join(split)
    line = joined.decode("utf-8", "surrogatepass")
    rules, by_keyword, automaton = _compiled()
    present = {keyword for _, keyword in automaton.iter(line)} if split else set()
    if not present:
        return len(split), [], set(), set(), 0.0
    starts, base = [], set()
    for phrase in present & BASE.keys():
        at, counted, words = line.find(f" {phrase} "), 0, 0
        while at >= 0:
            words += line.count(" ", counted, at)
            counted = at
            starts.append(words)
            base.add(BASE[phrase])
            at = line.find(f" {phrase} ", at + 1)
    found = [(m.start(), m.end(), rules[i][0], i) for keyword in present for i in by_keyword.get(keyword, ()) for m in rules[i][2].finditer(line)]
    kept = _kept(found)
    labels = base | {rules[d[3]][1] for d in kept}
    score = max([0.5 if base else 0.0, *(d[2] / 100 for d in kept)])
    return len(split), starts, base, labels, score


def label(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` plus word count, base places and labels, all labels and a score."""
    work = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in work.schema[:-1])}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [scan(x) for x in batch["__text"].to_pylist()]
            kept = batch.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays(
                [
                    *kept.columns,
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([len(r[1]) for r in rows], pa.int64()),
                    pa.array([min(r[1], default=None) for r in rows], pa.int64()),
                    pa.array([max(r[1], default=None) for r in rows], pa.int64()),
                    pa.array([",".join(sorted(r[2])) for r in rows], pa.string()),
                    pa.array([",".join(sorted(r[3])) for r in rows], pa.string()),
                    pa.array([r[4] for r in rows], pa.float64()),
                ],
                names=[*kept.schema.names, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return work.mapInArrow(run, schema)

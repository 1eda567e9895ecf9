"""Merkle manifest, lexical search and chat windows against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, lexical_search, merkle, ordering, queries


@pytest.fixture(autouse=True)
def several_parts(spark):
    """Small tables would be coalesced into one part otherwise."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- places ---------------------------------------------------------------------
def test_running_sums_span_parts(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), rng.randrange(50), rng.randrange(9)) for _ in range(3000)]
    rows += [("c", 7, 1)] * 900  # equal rows may lie in several parts
    df = spark.createDataFrame(rows, "g string, o int, v long").repartition(6)
    placed = ordering.ordered(df, ["g", "o"], "t")
    got = ordering.running(placed, "g", {"i": F.lit(1), "s": F.col("v")}, {"most": F.col("v")}).collect()
    assert placed.select("__part").distinct().count() > 1 and len(got) == len(rows)
    for g in (None, "a", "b", "c"):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["__i"])
        assert [r["__i"] for r in mine] == list(range(len(mine))) and {r["__total_i"] for r in mine} == {len(mine)}
        assert [r["o"] for r in mine] == sorted(r["o"] for r in mine)
        assert [r["__s"] for r in mine] == [sum(x["v"] for x in mine[:k]) for k in range(len(mine))]
        assert {r["__total_s"] for r in mine} == {sum(x["v"] for x in mine)}
        assert {r["__most"] for r in mine} == {max(x["v"] for x in mine)}


# ---- Merkle ---------------------------------------------------------------------
def brute_tree(leaves, fanout):
    """(root, siblings of each leaf)"""
    level, index = list(leaves), list(range(len(leaves)))
    siblings = [[] for _ in leaves]
    while len(level) > 1:
        for leaf, i in enumerate(index):
            run = range(i - i % fanout, min(i - i % fanout + fanout, len(level)))
            siblings[leaf] += [level[k] for k in run if k != i]
        level = [sha(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
        index = [i // fanout for i in index]
    return level[0], siblings


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_equals_brute_force(spark, fanout):
    rng = random.Random(fanout)
    langs = [None, "", "de", "z", "é"]  # bytewise
    sizes = {None: 19, "": 1, "de": 300, "é": 17, "z": 2}
    rows = [(rng.choice([None, rng.randrange(10**6)]) if g is None else rng.randrange(-500, 500), g, f"text {k % 40}", "clash") for g in langs for k in range(sizes[g])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, path string").repartition(5)
    leaf = merkle.digest(merkle.field(F.col("doc_id")), merkle.field(F.col("text")))
    got = merkle.manifest(df, leaf, F.col("lang"), F.col("doc_id"), [F.col("doc_id"), F.col("lang")], fanout)
    got = got.select("*", merkle.proof(F.col("path")).alias("proof"), merkle.folded(F.col("leaf"), F.col("path")).alias("again"), merkle.folded(F.sha2(F.lit("other"), 256), F.col("path")).alias("wrong")).collect()

    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    subs, expect = {}, Counter()
    for g in langs:
        own = sorted((d is not None, d or 0, sha(part(d), part(t))) for d, h, t, _ in rows if h == g)
        subs[g] = (own, *brute_tree([x[2] for x in own], fanout))
    root, above = brute_tree([subs[g][1] for g in langs], fanout)
    for g, up in zip(langs, above):
        own, sub, siblings = subs[g]
        for (there, d, digest), path in zip(own, siblings):
            expect[(d if there else None, g, digest, sub, root, sha(*path, *up))] += 1
    assert Counter((r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got) == expect
    assert all(r["again"] == root and r["wrong"] != root for r in got)


def test_manifest_of_one_row_repeated_rows_and_none(spark):
    df = spark.createDataFrame([(1, "x", "t")], "doc_id long, lang string, text string")
    leaf = merkle.digest(merkle.field(F.col("text")))
    run = lambda d: merkle.manifest(d, leaf, F.col("lang"), F.col("doc_id"), [F.col("doc_id")])
    only = run(df).first()
    assert only["leaf"] == only["subroot"] == only["root"] == sha("1:t") and only["path"] == []
    assert run(df.limit(0)).count() == 0
    same = run(df.union(df).union(df)).collect()
    assert len(same) == 3 and len({r["root"] for r in same}) == 1


def test_tampered_rows_are_told(spark):
    rows = {r["doc_id"]: r for r in queries.op11_merkle_manifest(spark, "/root/testdata/sf0.001").collect()}
    import zlib

    chars = {r["doc_id"]: r["n_chars"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for i, r in rows.items():
        assert r["verified"] == (zlib.crc32(str(i).encode()) % 7 != 0 or chars[i] is None)


# ---- search ---------------------------------------------------------------------
def brute_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, terms(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        own, hits = set(terms(text)), []
        for d, bag in bags:
            tf = Counter(bag)
            score = sum(weight[t] * (10**9 * tf[t] // (1000 * tf[t] + 20 * (50 + 50 * len(bag) * n_docs // n_terms))) for t in own if tf[t])
            if score > 0:
                hits.append((-score, d is not None, d or 0))
        out += [(item, r + 1, d if there else None, -s) for r, (s, there, d) in enumerate(sorted(hits)[:k])]
    return out


@pytest.mark.parametrize("k", [1, 7, 50])
def test_search_equals_full_scoring(spark, k, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", 600)  # several shards a task, and a carried threshold
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 40)  # several blocks of queries
    rng = random.Random(k)
    vocab = [f"w{min(int(rng.expovariate(0.05)), 90)}" for _ in range(400)] + ["Été", "été", "ΣΑΣ", "x1"]
    docs = [(i, rng.choice([" ", ". ", "-"]).join(rng.choice(vocab) for _ in range(int(rng.expovariate(0.03)) + 1))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(None, docs[3][1]), (2, docs[2][1]), (3000, None), (3001, ""), (3002, "... --"), (3003, "w1 " * 30_000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 25)))) for i in range(12)] + [(90, None), (91, ""), (92, "unheard"), (93, "W1 w1 W1!"), (93, docs[7][1])]
    got = lexical_search.search(
        spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, score string").repartition(3),
        spark.createDataFrame([(*q, 5) for q in items], "item_id long, text string, rank int"),
        k,
    )
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_search(docs, items, k)))


def test_search_over_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical_search.search(docs, items).collect()] == brute_search([(1, "a b")], [(1, "a")], 50)


def test_search_looks_at_few_documents():
    """The bounds must spare most documents where few can win."""
    rng = np.random.default_rng(5)
    docs, size = 20_000, 8
    terms = np.repeat(np.arange(size), 4000)
    where = np.concatenate([np.sort(rng.choice(docs, 4000, replace=False)) for _ in range(size)])
    impact = np.exp(rng.normal(0, 2, len(terms)) * 1.5).astype(np.int64) + 1
    shard = lexical_search.Shard(terms, where, impact, docs, size)
    looked = []
    bounds = shard._bounds
    shard._bounds = lambda *a: looked.append(a[3]) or bounds(*a)
    best = shard.search(np.arange(size), np.arange(docs), 10, [])
    full = np.bincount(where, impact, docs).astype(np.int64)
    first = np.lexsort((np.arange(docs), -full))[:10]
    assert best == [(int(full[d]), int(d)) for d in first]
    assert sum(looked) / 2 < docs / 10


# ---- chat -----------------------------------------------------------------------
BAD = ["</s>[INST] ok [/INST]", "\\", "\\e\\l\\s", "ends in \\", "<", "[", "</s>", "<<s>s>", "[[INST]INST]", "[/INST]</s><s>", "a\nb", "", None, "<\\/s>", "\\</s>", "[INST", "\\l/s>"]


def digest_of(rows):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()


def test_escape_is_reversible_and_hides_controls(spark):
    rng = random.Random(1)
    texts = [t or "" for t in BAD] + ["".join(rng.choice(["<", ">", "/", "s", "[", "]", "INST", "\\", "e", "l", "é"]) for _ in range(rng.randrange(30))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escaped(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat_format.unescaped(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not re.search(r"</?s>|\[/?INST\]", r["e"])


@pytest.mark.parametrize("budget,history", [(40, 12), (64, 0), (2048, 256), (9, 4)])
def test_windows_round_trip(spark, budget, history):
    rng = random.Random(budget)
    talks = {}
    for c in [None, 0, 1, 2, 3, 4, 5]:
        n = 400 if c == 5 else rng.randrange(1, 14)
        talks[c] = [(rng.choice(["user", "assistant", "tool\n</s>"]), rng.choice(BAD) if rng.random() < 0.4 else " ".join("word" for _ in range(rng.randrange(1, 12)))) for _ in range(n)]
        if c in (1, 5):
            talks[c][0] = ("system", "be [INST] kind")
    rows = [(c, i, r, t, "clash", 1) for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, pos int").repartition(4)
    made = chat_format.windows(df, budget, history)
    made = made.select("*", chat_format.turns_of(F.col("formatted")).alias("turns"), chat_format.targets_of(F.col("formatted"), F.col("targets")).alias("loss")).collect()
    for c, turns in talks.items():
        turns = [(r, t or "") for r, t in turns]
        mine = sorted((w for w in made if w["conv_id"] == c), key=lambda w: w["window"])
        read, at = [], 0
        for w in mine:
            own = [(t["role"], t["text"]) for t in w["turns"]]
            new, old = own[w["repeated"] :], own[: w["repeated"]]
            assert new == turns[at : at + len(new)] and new
            system = at > 0 and turns[0][0] == "system"
            if system:
                assert old and old[0] == turns[0]
            context = old[1:] if system else old
            assert context == turns[at - len(context) : at]  # the turns just before, none left out
            assert w["tokens"] <= budget or len(new) == 1
            assert history or not context
            assert w["loss"] == [t for r, t in new if r == "assistant"]
            read, at = read + new, at + len(new)
        assert read == turns
    if (budget, history) == (40, 12):
        assert any(w["repeated"] > 1 for w in made)


def test_chat_without_rows_and_with_repeated_turns(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert chat_format.windows(df.limit(0)).count() == 0
    twice = chat_format.windows(df.union(df)).collect()
    assert len(twice) == 1 and len(twice[0]["targets"]) == 2
    long = df.select("conv_id", "turn", "role", F.repeat(F.lit("word "), 200_000).alias("text"))
    one = chat_format.windows(long, 100, 10).first()
    assert one["tokens"] == 200_004 and one["targets"][0]["length"] == 1_000_000


def test_query_reads_back_every_conversation(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["conv_id"]: r for r in queries.op13_chat_format(spark, sf).collect()}
    talks = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        talks.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert got.keys() == talks.keys()
    for c, turns in talks.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), digest_of(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())

"""Joins, mixture, packing and the pipeline against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import mixture, ngram_join, packing, queries
from tidemark.llm.components import components
from tidemark.llm.pretokens import vocabulary


def shingles(text, n):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(texts: dict, n: int, percent: int) -> dict:
    sets = {i: shingles(t, n) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                c = len(a & b)
                if 100 * c >= percent * (len(a) + len(b) - c):
                    u, v = find(i), find(j)
                    root[max(u, v)] = min(u, v)
    return {i: find(i) for i in ids}


def edited(rng, words, times):
    w = list(words)
    for _ in range(times):
        at = rng.randrange(len(w))
        w[at : at + rng.choice([0, 1])] = [f"e{rng.randrange(10**6)}"]
    return w


@pytest.fixture(scope="module")
def family_texts():
    rng = random.Random(11)
    texts, vocab = [], [f"v{i}" for i in range(3000)]
    for size in (4, 6, 9, 12, 19, 20, 21, 31, 33, 63, 65, 120, 300, 700):
        base = [rng.choice(vocab) for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            texts.append(" ".join(edited(rng, base, min(edits, size // 3))))
        chain = base
        for _ in range(4):  # each like the one before, the ends not alike
            chain = edited(rng, chain, max(1, size // 40))
            texts.append(" ".join(chain))
        texts += [" ".join(base[: int(size * s)]) for s in (0.92, 0.88, 0.81)]
    texts += ["", None, "one", "one", "ONE", "one two", "two one", "\t \n"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_join_against_brute_force(spark, family_texts, n, percent):
    df = spark.createDataFrame(list(family_texts.items()), "doc_id long, text string").withColumn("n_shingles", F.lit("clash")).repartition(4)
    got = ngram_join.join_components(df, n, percent).collect()
    want = brute_components(family_texts, n, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(shingles(family_texts[r["doc_id"]], n)) for r in got)


def test_join_of_one_large_group_of_near_copies(spark, monkeypatch):
    """Hundreds of variants of one text, some alike only through others, in blocks of few rows."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    texts = {i: " ".join(edited(rng, base, rng.choice([0, 1, 2, 4, 6]))) for i in range(350)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 9)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(df).collect()}
    assert got == brute_components(texts, 3, 90)


def test_join_edges(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (9, "A B C D"), (None, "z y x w"), (7, None)]
    got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and [r["component_id"] for r in got if r["doc_id"] is None].count(None) == 1  # a component of NULL ids alone
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == {(5, 5), (9, 5), (7, 7)}
    assert ngram_join.join_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_join_links_through_texts_under_null_and_repeated_ids(spark):
    w = [f"w{i}" for i in range(60)]
    a, b, c = w, ["x", *w[1:]], [*w[:-1], "y"]  # b ~ a ~ c, but b and c are too far apart
    sets = [shingles(" ".join(t), 3) for t in (a, b, c)]
    assert 100 * len(sets[1] & sets[2]) < 95 * len(sets[1] | sets[2]) and 100 * len(sets[0] & sets[1]) >= 95 * len(sets[0] | sets[1])
    for middle in (3, None, 2):  # its own id, no id, the id of another text
        rows = [(1, " ".join(b)), (2, " ".join(c)), (middle, " ".join(a))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r["component_id"] for r in ngram_join.join_components(df, 3, 95).collect()} == {1}
        assert [r["doc_id"] for r in ngram_join.first_of_each(df, 3, 95).collect()] == [1]
    unlike = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (1, "a b c d e f"), (1, None), (None, None), (None, None)], "doc_id long, text string")
    assert sorted(map(repr, (tuple(r) for r in ngram_join.first_of_each(unlike).collect()))) == ["(1, 'a b c d e f')", "(1, 'g h i j k l')", "(1, None)", "(None, None)"]


@pytest.mark.parametrize("percent", [50, 80, 90, 99, 100])
def test_linked_sets_share_a_key(percent):
    """Every allowed pair of sizes, at the least overlap that links."""
    rng = np.random.default_rng(percent)
    for _ in range(400):
        a = int(rng.integers(1, 120))
        b = int(rng.integers(a, a * 100 // percent + 1))
        need = -(-percent * (a + b) // (100 + percent))
        if need > a:
            continue
        grams = np.unique(rng.integers(1, 2**63, a + b - need + 20, dtype=np.uint64))[: a + b - need]
        rng.shuffle(grams)
        x, y = np.sort(grams[:a]), np.sort(grams[a - need :])
        late = np.sort(rng.choice(grams, len(grams) // 3, replace=False))
        (kx, small), (ky, _) = ngram_join.keys_of(x, percent, late), ngram_join.keys_of(y, percent, late)
        assert set(kx[small]) & set(ky)
        edges = ngram_join._band_edges(percent)
        bands = [sum(e <= n for e in edges) for n in (a, b)]
        assert bands[1] - bands[0] in (0, 1)


def test_keys_and_bounds():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(10, 400))
        a = np.unique(rng.integers(0, 2**64 - 1, n, dtype=np.uint64))
        other = np.unique(np.concatenate([rng.permutation(a)[: len(a) - int(rng.integers(0, 1 + len(a) // 18))], rng.integers(0, 2**64 - 1, int(rng.integers(0, 1 + len(a) // 18)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, other))
        bits = ngram_join._folded([ngram_join._bitmap(a), ngram_join._bitmap(other)])
        only = np.bitwise_count(bits & ~bits[::-1]).sum(axis=1)
        assert min(len(a) - int(only[0]), len(other) - int(only[1])) >= common
        if 100 * common >= 90 * (len(a) + len(other) - common) and len(np.setxor1d(a, other)):
            x, y = sorted((a, other), key=len)
            (kx, small), (ky, _) = (ngram_join.keys_of(v, 90, np.empty(0, np.uint64)) for v in (x, y))
            assert set(kx[small]) & set(ky), (len(a), len(other), common)


def test_texts_that_share_a_key_and_little_else_go_no_further(spark, monkeypatch):
    """Pairs share half of their words, and only one text has a near copy."""
    rng = random.Random(7)
    texts = {}
    for _ in range(40):
        passage = [f"p{rng.randrange(10**9)}" for _ in range(100)]
        for _ in range(2):
            texts[len(texts)] = " ".join(passage + [f"w{rng.randrange(10**9)}" for _ in range(100)])
    texts[500] = texts[0] + " end"
    staged, real = {}, ngram_join.stage

    def spy(df, label):
        out = real(df, label)
        staged[label] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "stage", spy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(df).collect()}
    assert got == {d: 0 if d == 500 else d for d in texts}
    assert staged["tile-rows"] <= 2 * 2 * ngram_join.first_members(200, 90)[0]  # rows of the two copies, in two bands each


@pytest.mark.parametrize("percent", [50, 80, 90, 99])
def test_counts_leave_every_link(percent, monkeypatch):
    """Sets of few to thousands of members, some with crowded buckets, in batches that cut keys."""
    rng = np.random.default_rng(percent)
    sets = []
    for size in [3, 20, 200, 1500, 6000] * 5:
        base = rng.integers(0, 2**64 - 1, size, dtype=np.uint64)
        for _ in range(int(rng.integers(1, 5))):
            k = int(rng.integers(0, 1 + size // 12))
            sets.append(np.unique(np.concatenate([base[k:], rng.integers(0, 2**64 - 1, k, dtype=np.uint64)])))
    sets += [np.unique(np.concatenate([np.arange(400, dtype=np.uint64) << np.uint64(20), rng.integers(0, 2**64 - 1, k, dtype=np.uint64)])) for k in (0, 2, 5)]
    sets = [sets[i] for i in rng.permutation(len(sets))]
    key, size, small = np.sort(rng.integers(0, 9, len(sets))), np.array([len(x) for x in sets]), rng.random(len(sets)) < 0.8
    counts = [ngram_join._counts(x, percent) for x in sets]
    got = ngram_join._have_partner(key, size, small, counts, percent)
    for i, x in enumerate(sets):
        for j in np.flatnonzero(key == key[i]):
            if i != j and small[i] and size[j] >= size[i] and ngram_join._exact(x.tobytes(), sets[j].tobytes(), percent):
                assert got[i] and got[j]
    rows = pa.table({"key": key, "node": np.arange(len(sets)), "n": size, "small": small, "counts": pa.array(counts, pa.binary())})
    for limit, batch in ((5, 1), (5, 3), (10**6, 4)):
        monkeypatch.setattr(ngram_join, "MEET_ROWS", limit)
        out = [x for b in ngram_join._partnered(percent)(iter(rows.to_batches(max_chunksize=batch))) for x in b["node"].to_pylist()]
        assert out == np.flatnonzero(got | (np.bincount(key)[key] > limit)).tolist()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 40)] + [(500, 499), (499, 498), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 1 for i in range(1, 40)) and got[500] == got[499] == got[498] == 498
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- packing -------------------------------------------------------------------
def places(rows, histogram):
    """Sequences as lists of (offset, length), from the plan's rank ranges."""
    out, ranks = collections.defaultdict(list), collections.Counter()
    for length, first, n, sequence, per, offset in rows:
        assert first == ranks[length]
        ranks[length] += n
        for r in range(n):
            out[sequence + r // per].append((offset + r % per * length, length))
    assert dict(ranks) == {k: v for k, v in histogram.items() if v}
    return out


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_plan_keeps_every_capacity(score):
    rng = random.Random(2)
    for _ in range(40):
        cap = packing.Capacity(tokens=100, documents=rng.choice([3, 5, 100]), attention=rng.choice([10_000, 4_000]), score=score)
        most = int(cap.attention**0.5)
        histogram = collections.Counter(min(most, rng.choice([rng.randint(1, 100), rng.randint(1, 20), 50])) for _ in range(rng.randint(1, 300)))
        for s in places(packing.plan(dict(histogram), cap), histogram).values():
            s.sort()
            at = 0
            for offset, length in s:
                assert offset == at
                at += length
            assert at <= cap.tokens and len(s) <= cap.documents and sum(x * x for _, x in s) <= cap.attention


def test_plan_is_close_to_the_bound():
    rng = random.Random(8)
    histogram = collections.Counter(max(1, min(2048, int(rng.lognormvariate(6, 1.2)))) for _ in range(20_000))
    used = len(places(packing.plan(dict(histogram), packing.Capacity()), histogram))
    assert used <= 1.01 * -(-sum(k * v for k, v in histogram.items()) // 2048)
    assert packing.plan({}, packing.Capacity()) == []
    with pytest.raises(ValueError):
        packing.plan({11: 1}, packing.Capacity(tokens=10))


def test_every_capacity_binds_in_the_pipeline(spark):
    docs = spark.createDataFrame([(i, "word " * n) for i, n in enumerate([1500] * 30 + [900] * 60 + [3] * 900)], "doc_id long, text string")
    cap = corpus_pipeline.CAPACITY
    got = packing.pack(docs, vocabulary("word_bpe_49k.json"), cap).groupBy("sequence_id").agg(F.sum("length").alias("t"), F.count("piece").alias("d"), F.sum(F.col("length") * F.col("length")).alias("a"), F.max("length").alias("m")).collect()
    assert all(r["t"] <= cap.tokens and r["d"] <= cap.documents and r["a"] <= cap.attention and r["m"] <= cap.piece for r in got)
    assert any(r["d"] == cap.documents and r["t"] < cap.tokens for r in got)  # documents bind
    assert any(r["t"] + 901 <= cap.tokens and r["a"] + 901**2 > cap.attention for r in got)  # attention binds


def test_pieces_have_the_library_s_ids():
    """Merges alone against the whole library, on usual pieces of every letter the pattern knows."""
    from tidemark.llm.pretokens import LETTERS, WORD_PIECES, piece_ids, tokenizer

    path = vocabulary("word_bpe_49k.json")
    rng = random.Random(2)
    letters = [chr(c) for c in range(0x10000) if re.match(f"[{LETTERS}]", chr(c))]
    text = " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(4000)) + " ".join("".join(rng.choice("abcdefgh.,-!?'§°€»“”…0123456789") for _ in range(rng.randrange(1, 12))) for _ in range(4000))
    found, ids = set(WORD_PIECES.findall(text.lower())), piece_ids(path)
    for piece in found:
        assert ids(piece) == tokenizer(path).encode(piece, add_special_tokens=False).ids, piece


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "word " * 5000), (10**6 + 2, "word " * 5000), (None, "null id ½ İ"), (10**6 + 3, "<|endoftext|> x")], "doc_id long, text string")
    docs = docs.union(extra)
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = collections.Counter()
    for d in docs.collect():
        ids = np.array(t.encode(d["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        want.update((d["doc_id"], k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048))
    got = packing.pack(docs.withColumn("piece", F.lit("clash")), vocabulary("word_bpe_49k.json")).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    full = collections.defaultdict(list)
    for r in got:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in full.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0] + [x for _, x in s[:-1]])) and sum(x for _, x in s) <= 2048
    assert packing.pack(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


# ---- mixture -------------------------------------------------------------------
def waterfill(budget, children):
    """Children: name -> (weight, capacity)."""
    out, open_ = dict.fromkeys(children, 0.0), {k for k, (w, c) in children.items() if w > 0 and c > 0}
    while open_ and budget > 1e-9:
        total = sum(children[k][0] for k in open_)
        full = [k for k in open_ if children[k][1] - out[k] <= budget * children[k][0] / total + 1e-12]
        if not full:
            for k in open_:
                out[k] += budget * children[k][0] / total
            break
        for k in full:
            budget -= children[k][1] - out[k]
            out[k] = children[k][1]
            open_.discard(k)
    return out


def test_budgets_against_repeated_sharing(spark):
    rng = random.Random(6)
    leaves = [(d, l, s, rng.choice([0, 10, 200, 5000]), 3) for d in "abc" for l in ("x", "y") for s in ("p", "q", "r")]
    mix = mixture.Mixture({"a": 0.7, "b": 0.3, "c": 0.0}, {"x": 0.8, "y": 0.2}, {"p": 3.0}, share=0.5, max_epochs=2)
    got = {(r["domain"], r["lang_key"], r["source_key"]): r["budget"] for r in mixture.budgets(spark.createDataFrame(leaves, "domain string, lang_key string, source_key string, tokens long, n long"), mix).collect()}
    w = lambda weights, k: weights.get(k, 1.0)
    cap = {(d, l, s): 0 if d == "c" else 2.0 * t for d, l, s, t, _ in leaves}
    under = lambda *p: sum(c for k, c in cap.items() if k[: len(p)] == p)
    domains = waterfill(0.5 * sum(x[3] for x in leaves), {d: (w(mix.domains, d), under(d)) for d in "abc"})
    for d in "abc":
        langs = waterfill(domains[d], {l: (w(mix.languages, l), under(d, l)) for l in "xy"})
        for l in "xy":
            for s, b in waterfill(langs[l], {s: (w(mix.sources, s), under(d, l, s)) for s in "pqr"}).items():
                assert abs(got[d, l, s] - b) <= 1, (d, l, s)


def test_mixture_takes_prefixes_of_seeded_epochs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op7_source_mixture(spark, "/root/testdata/sf0.01").collect()
    assert sorted(rows) == sorted(queries.op7_source_mixture(spark, "/root/testdata/sf0.01").collect())
    tokens = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in docs.collect()}
    by = collections.defaultdict(list)
    for r in rows:
        assert r["n_tokens"] == tokens[r["doc_id"]]
        by[r["doc_id"]].append(r["epoch"])
    assert all(sorted(e) == list(range(len(e))) and len(e) <= 2 for e in by.values())


def test_mixture_edges(spark):
    rows = [(1, None, None, None, 5), (None, "a b c", "en", "src1", 5), (2, "a b", "en", "src1", 5), (2, "a b", "en", "src1", 5), (3, "", "en", "src9", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long")
    out = mixture.mix(df, queries.domain(), mixture.Mixture(share=5.0))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_tokens", "__domain", "__n_tokens", "__epoch"]
    assert out.count() == 2 * len(rows)
    assert mixture.mix(df.limit(0), queries.domain()).count() == 0
    assert mixture.mix(df, queries.domain(), mixture.Mixture(default=0.0)).filter("__n_tokens > 0").count() == 0


# ---- pipeline ------------------------------------------------------------------
def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    from tidemark.runtime import stage

    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, docs, sf), name)
        if name == corpus_pipeline.STAGES[-1][0]:
            assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
            break
        assert out.schema == docs.schema
        kept = {r["doc_id"]: r["text"] for r in out.collect()}
        assert kept.items() <= seen.items() and len(kept) < len(seen)
        if name == "toxicity":
            gone = seen.keys() - kept.keys()
            assert np.mean([labels[i]["toxic"] for i in gone if i in labels]) > 0.9
        if name == "ngram_jaccard_join":
            assert kept.keys() == {i for i, c in brute_components(seen, 5, 80).items() if i == c}
        seen, docs = kept, out


def test_pipeline_of_nothing_and_of_odd_rows(spark):
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    long = " ".join(f"word{i}" for i in range(60))
    odd = [(None, long, None, None, None), (None, long, None, None, None), (1, None, "en", None, 3), (2, "", None, "src1", 0), (3, long + " end", "en", "src1", 1), (3, long + " end", "en", "src1", 1)]
    for rows, left in (([], 0), (odd, 1)):
        docs = spark.createDataFrame(rows, schema)
        for name, step in corpus_pipeline.STAGES[:3]:
            docs = step(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == left
        for name, step in corpus_pipeline.STAGES[3:]:
            docs = step(spark, docs, "/root/testdata/sf0.001")
        docs.collect()

"""Row-wise operators against brute force and hand cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprints, language_id, license_scan, quality_ledger, queries, token_counts, toxicity, url_filter
from tidemark.llm.common import held_out
from tidemark.llm.license_rules import expanded
from tidemark.llm.pretokens import UNUSUAL, vocabulary

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " \t\n", "one", "a b", "The MIT License.", "don't it's WE'RE they'll  x\n\n\ny ", "größe Ñandú œuvre naïve", "日本語 текст ελληνικά",
    "<|endoftext|> in the middle <|endoftext|>", "e\u0301 combining \u200b zero\u00a0width ½ ² İstanbul ǅ", "1234567890 3.14 50% x²", "a" * 5000, "tab\tand\x0bvt\x0cff\rcr",
    "x " * 3000, "😀 emoji 👩‍👩‍👧 \U0001F1E9\U0001F1EA", "__snake_case__ --dash-- #tag", "GNU General Public License, version 3. Apache License, Version 2.0 CC BY-NC 4.0",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None, "clash", 1) for i, t in enumerate(ODD)] + [(None, "no id here", "en", "src1", "clash", 2), (3, ODD[3], None, None, "clash", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string, score long")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def test_token_counts_equal_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = by_id(token_counts.count(odd, vocabulary("byte_bpe_50k.json"), [F.col("doc_id")]))
    for i, text in enumerate(ODD):
        assert got[i]["n_tokens"] == len(t.encode(text or "", add_special_tokens=False).ids), text
        assert got[i]["n_bytes"] == len((text or "").encode())
    assert token_counts.count(none, vocabulary("byte_bpe_50k.json"), [F.col("doc_id")]).count() == 0


def test_token_counts_do_not_depend_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = vocabulary("byte_bpe_50k.json")
    a = token_counts.count(docs, path, [F.col("doc_id")], sample_docs=2, table_size=5)
    b = token_counts.count(docs, path, [F.col("doc_id")])
    assert sorted(a.collect()) == sorted(b.collect())


def test_unusual_characters_go_to_the_library():
    assert UNUSUAL.search("a\u00a0b") and UNUSUAL.search("½") and UNUSUAL.search("<|") and UNUSUAL.search("İ")
    assert not UNUSUAL.search("Größe, naïve. Ñ “x” – 漢字 кот 12!\n")


def test_language_by_words_then_ngrams(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs.filter(~held_out(F.col("doc_id"))))
    got = language_id.predict(docs, model, [F.col("doc_id"), F.col("lang")]).collect()
    unseen = [r for r in got if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["lang"] == r["lang_pred"] for r in unseen]) > 0.95
    edge = by_id(language_id.predict(odd, model, [F.col("doc_id")]))
    assert edge[0]["lang_pred"] == edge[1]["lang_pred"] == edge[2]["lang_pred"] == "und" and edge[0]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in edge.values())
    assert language_id.predict(none, model, [F.col("doc_id")]).count() == 0
    nothing = language_id.fit(none)
    assert {r["lang_pred"] for r in language_id.predict(odd, nothing, [F.col("doc_id")]).collect()} == {"und"}


def test_unseen_words_fall_back_to_shorter_grams():
    row = lambda *x: np.array(x, float)
    m = language_id.LanguageModel(["a", "b"], {"known": row(0, -5)}, {"xyz": row(-5, 0), "q": row(0, -1)})
    assert m.evidence("known")[0] == 0
    assert m.evidence("wxyz").argmax() == 1  # only the trigram speaks
    assert m.evidence("q").argmax() == 0
    assert not m.evidence("").any()


def test_quality_ledger_against_brute_force(spark, odd, none):
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(12)]
    texts = [" ".join(rng.choice(vocab[: rng.choice([1, 2, 12])]) for _ in range(rng.randint(0, 60))).replace("w3", "w3\n") for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(quality_ledger.ledger(df, [F.col("doc_id")]))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        covered = set()
        for j in range(len(w) - 7):
            if grams[tuple(w[j : j + 8])] > 1:
                covered.update(range(j, j + 8))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["n_dup_lines"]) == (len(w), len(covered), len(lines) - len(set(lines)))
    edge = by_id(quality_ledger.ledger(odd, [F.col("doc_id")]))
    assert edge[0]["n_words"] == edge[1]["n_words"] == edge[2]["n_words"] == 0 and edge[0]["failures"] & quality_ledger.BIT["few_words"]
    assert quality_ledger.ledger(none, [F.col("doc_id")]).count() == 0


def test_policies_and_ablations_read_the_ledger_only(spark):
    rows = spark.createDataFrame([(0,), (1,), (1 | 4,), (4,), (32,)], "failures long")
    assert quality_ledger.kept(rows, "base").count() == 3
    assert quality_ledger.kept(rows, "v2").count() == 1
    out = {r["rule"]: (r["n_failed"], r["n_only_this"]) for r in quality_ledger.ablations(rows, "v1").collect()}
    assert out["few_words"] == (2, 1) and out["symbols"] == (2, 1) and "upper_case" not in out
    assert {r["n_docs"] for r in quality_ledger.ablations(rows.limit(0)).collect()} == {0}


def test_license_places_against_brute_force(spark, odd):
    got = by_id(license_scan.label(odd, [F.col("doc_id")]))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, text in enumerate(ODD):
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        starts = [k for p in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(starts), min(starts, default=None), max(starts, default=None))
    assert got[17]["base_labels"] == "apache,cc-by,gpl" and got[17]["labels"] == "apache,apache-2.0,cc-by,cc-by-nc-4.0,gpl,gpl-3"
    assert got[0]["labels"] == "" and got[0]["score"] == 0


def test_license_rules_suppress_what_lies_inside():
    assert len(expanded()) >= 200
    assert license_scan.scan("under the BSD 3-Clause License")[3] == {"bsd-3-clause"}
    assert license_scan.scan("GNU Lesser General Public License version 2.1")[3] == {"lgpl-2.1"}
    assert license_scan.scan("GNU General Public License, version 2 of the License, or (at your option) any later version")[3] == {"gpl", "gpl-2-or-later"}
    assert license_scan.scan("mit license mit license")[1] == [0, 2]
    assert license_scan.scan("commit licenses")[1] == []


def test_toxicity_restores_disguised_words(spark):
    rng = random.Random(5)
    words = ["thin", "heat", "onor", "stable", "ration", "under", "three", "mention", "loser", "idiot", "pathetic", "other"]
    docs = [(i, " ".join(rng.choice(words[:8]) for _ in range(40)) + (" loser idiot pathetic" if i % 3 == 0 else "")) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels, ~held_out(F.col("doc_id")))
    for seen in ("l0ser", "i d i o t", "iiidiot", "p@thetic", "p.a.t.h.e.t.i.c", "l-0-s-e-r"):
        assert toxicity.Restorer(model.cost).words(f"thin {seen} heat") & {"loser", "idiot", "pathetic"}, seen
    probe = [(0, "thin heat onor stable"), (1, "thin l0ser heat 1diot"), (2, None), (3, ""), (4, "heat i d i o t p@thet1c onor")]
    got = by_id(toxicity.predict(spark.createDataFrame(probe, "doc_id long, text string"), model, [F.col("doc_id")]))
    assert got[0]["score"] < 0.5 < got[1]["score"] and got[4]["score"] > 0.5
    assert 0 <= got[2]["score"] < 0.5 and got[2]["score"] == got[3]["score"]
    unlabelled = toxicity.fit(df, labels.limit(0), ~held_out(F.col("doc_id")))
    assert {r["score"] for r in toxicity.predict(df, unlabelled, [F.col("doc_id")]).collect()} == {0.0}


@pytest.fixture(scope="module")
def restorer(spark):
    return toxicity.Restorer(toxicity.character_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))


def test_toxicity_finds_disguises_at_the_edges_of_clauses(restorer):
    for word in ("moron", "loser", "idiot", "clown", "trash", "scum"):
        spelt = " ".join(word)
        for text in (f"{spelt}!", f"{spelt}, go", f"so {spelt}.", f"({spelt})", f'"{spelt}"', f"a {spelt}", f"y {spelt}", f"{spelt} !", "  ".join(word), "\n".join(word), "_".join(word), "-".join(word)):
            assert word in restorer.words(text), (word, text)
    for text, word in (("$cum", "scum"), ("idio+", "idiot"), ("!diot", "idiot"), ("(lown", "clown"), ("(1diot)", "idiot"), ("tra$h!", "trash"), ("moroon", "moron"), ("loseer,", "loser")):
        assert word in restorer.words(f"thin {text} heat"), text


def test_toxicity_reads_whole_spans_as_several_words(restorer):
    assert "idiot" in restorer.words("y o u a r e a n i d i o t")
    assert "moron" in restorer.words("w a s t e o f s p a c e " * 8 + "m o r o n")
    assert {"idiot", "loser"} <= restorer.words("[you-are-such-a-complete-1d1ot-and-l0ser]-as-everyone-here-knows")
    assert len(restorer.words("a b " * 50_000)) > 2


def test_toxicity_on_held_out_labels(spark):
    rows = queries.op3_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.95
    assert not any(r["predicted"] for r in rows if r["toxic"] == 0)


def test_fingerprints_estimate_weighted_jaccard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = sorted(fingerprints.fingerprint(docs).collect(), key=lambda r: -r["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts, reverse=True)
    count = lambda t: collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", t))
    likeness = lambda a, b: sum((a & b).values()) / max(1, sum((a | b).values()))
    errors = []
    for k, (i, r) in enumerate(zip(ids, got)):
        text, other = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        new = text[: len(text) - half] + other[:half]
        assert r["doc_id"] == i and r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        errors += [r["near_edited"] - likeness(count(text), count(new)), r["near_next"] - likeness(count(text), count(other))]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.09


def test_ranges_of_ids_hold_few_rows_however_ids_lie(spark):
    """An outlying id, a crowded id and a crowd of NULL ids: no range gets a large share, and the order is that of a plain sort."""
    ids = [*range(4000), 10**15, -(10**15), 2**63 - 1, -(2**63)] + [77] * 2500 + [None] * 2500
    docs = spark.createDataFrame([(d, f"text {k}") for k, d in enumerate(ids)], "doc_id long, text string")
    got = fingerprints.successors(docs).collect()
    hashed = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    line = sorted(zip(ids, (f"text {k}" for k in range(len(ids)))), key=lambda x: (x[0] is None, -(x[0] or 0), hashed[x[1]]))
    want = {a[1]: b[1] for a, b in zip(line, line[1:] + line[:1])}
    assert {r["text"]: r["next_text"] for r in got} == want and len(got) == len(ids)
    assert max(collections.Counter(r["range"] for r in got).values()) < len(ids) / 20


def test_fingerprint_edges(spark, odd, none):
    rows = fingerprints.fingerprint(odd).collect()
    assert len(rows) == len(ODD) + 2
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["fingerprint"] == by[1]["fingerprint"] == by[2]["fingerprint"]
    assert fingerprints.fingerprint(none).count() == 0
    one = fingerprints.fingerprint(odd.filter("doc_id = 4")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_url_parts_and_rules(spark):
    urls = [
        "https://A.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://notexample.org/en/1", "http://x.com/fr/a", "http://x.com/de/a", "nothing", None,
        "http://h.com", "http://h.com?q=/fr/", "ftp://u@h.net:80/p/q", "a://b://c/d", "http://h.com/fr/\nx", "https://com/fr/",
    ]
    df = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[3])], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(df, queries.URL_RULES).collect()}
    assert (got[0]["host"], got[0]["path"], got[0]["rule"], got[0]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1]["rule"] == "example.org/en/1" and got[2]["rule"] == "org/" and got[3]["rule"] == "com/fr/" and got[4]["verdict"] == "block"
    assert (got[5]["host"], got[5]["path"], got[5]["rule"]) == ("", "", None) and (got[6]["host"], got[6]["path"]) == ("", "")
    assert (got[7]["host"], got[7]["path"]) == ("h.com", "") and (got[8]["host"], got[8]["path"]) == ("h.com", "")
    assert (got[10]["host"], got[10]["path"]) == ("b:", "//c/d") and got[12]["rule"] == "com/fr/"
    assert len(got) == len(urls) + 1 and all(r["verdict"] in ("allow", "block") for r in got.values())
    assert url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0
    alone = url_filter.judge(df.filter("page_id = 3 OR page_id = 9"), queries.URL_RULES).collect()
    assert {r["verdict"] for r in alone} == {"allow"}


def test_url_models_against_brute_force(spark):
    got = {r["page_id"]: r for r in url_filter.judge(spark.read.parquet(f"{SF}/pages.parquet"), queries.URL_RULES).collect()}
    symbols = lambda r: "^" + re.sub(r"[^a-z0./_-]", "~", re.sub("[0-9]", "0", r["host"] + r["path"]).lower()) + "$"
    grams = lambda s: [s[e - k + 1 : e + 1] for e in range(1, len(s)) for k in range(1, min(3, e + 1) + 1)]
    n = {"allow": collections.Counter(), "block": collections.Counter()}
    for r in got.values():
        if r["rule"]:
            n[r["verdict"]].update(grams(symbols(r)))
    known = {g for g in n["allow"] + n["block"] if n["allow"][g] + n["block"][g] >= (1 if len(g) == 1 else 3)}
    totals = {v: collections.Counter() for v in n}
    for g in known:
        for v in n:
            totals[v][len(g), g[:-1]] += n[v][g]

    def p(v, g):
        below = 1 / 34 if len(g) == 1 else p(v, g[1:])
        return (n[v][g] + 2 * below) / (totals[v][len(g), g[:-1]] + 2)

    def score(s):
        total = 0
        for e in range(1, len(s)):
            for k in range(min(3, e + 1), 0, -1):
                g = s[e - k + 1 : e + 1]
                if g in known:
                    total += np.log(p("allow", g) / p("block", g))
                    break
        return total / (len(s) - 1)

    for r in got.values():
        assert abs(r["score"] - score(symbols(r))) < 1e-3


def test_language_needs_letters_and_reads_whole_runs(spark):
    """Signs that count as numbers are no letters; what follows the first letters of a long run counts."""
    learn = spark.createDataFrame([(i, w * 3, lang) for i in range(20) for lang, w in (("xx", "xxxx xxx xxxxx "), ("yy", "yyyy yyy yyyyy "))], "doc_id long, text string, lang string")
    model = language_id.fit(learn)
    rows = [(1, "½ ² 12 Ⅷ"), (2, "x" * 64 + "y" * 5000), (3, "y" * 64 + "x" * 5000), (4, "12xx½xxx"), (5, None), (6, "_ - 3"), (7, "xxx")]
    got = by_id(language_id.predict(spark.createDataFrame(rows, "doc_id long, text string"), model, [F.col("doc_id")]))
    assert [got[i]["lang_pred"] for i in range(1, 8)] == ["und", "yy", "xx", "xx", "und", "und", "xx"]
    assert language_id.letter_runs("Aé½b ²c Ⅷ d_e") == ["aé", "b", "c", "d", "e"]

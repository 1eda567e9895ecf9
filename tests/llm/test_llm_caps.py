"""Nothing is cut inside an item: grams with all languages, weights on one scale, prefixes by plain sorting."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id, mixture, queries

TEXTS = {"en": ["the theme of them", "other weather there"], "de": ["der andere theme", "wetter der them"], "fr": ["le theme les autres"]}


def _labelled(spark):
    rows = [(i * 10 + k, text, lang) for i, lang in enumerate(TEXTS) for k, text in enumerate(TEXTS[lang])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def _counts(pieces):
    out = defaultdict(Counter)
    for lang, texts in TEXTS.items():
        for word in " ".join(texts).split():
            for x in pieces(word):
                out[x][lang] += 1
    return out


def _grams(word):
    marked = f"^{word}$"
    return [marked[i : i + k] for i in range(len(marked)) for k in range(1, 6) if i + k <= len(marked)]


def _log_shares(counts, most, least):
    kept = sorted((x for x in counts if sum(counts[x].values()) >= least), key=lambda x: (-sum(counts[x].values()), x))[:most]
    langs = sorted(TEXTS)
    totals = {l: max(1, sum(counts[x][l] for x in kept)) for l in langs}
    out = {}
    for x in kept:
        p = [math.log((counts[x][l] + 0.1) / (totals[l] + 0.1 * len(kept))) for l in langs]
        top = math.log(sum(map(math.exp, p)))
        out[x] = [y - top for y in p]
    return out


@pytest.mark.parametrize("max_words,max_grams", [(3, 7), (100, 1000)])
def test_language_model_against_brute_force(spark, max_words, max_grams):
    model = language_id.fit(_labelled(spark), max_words=max_words, max_grams=max_grams)
    words, grams = _log_shares(_counts(lambda w: [w]), max_words, 1), _log_shares(_counts(_grams), max_grams, 2)
    assert model.languages == sorted(TEXTS)
    for made, plain in ((model.words, words), (model.grams, grams)):
        assert set(made) == set(plain)
        for x in plain:
            assert made[x] == pytest.approx(plain[x])

    def naive(text):
        found, z = re.findall("[a-z]+", text.lower()), [0.0] * 3
        for word in found:
            if word in words:
                z = [a + b for a, b in zip(z, words[word])]
                continue
            marked = f"^{word}$"
            for at in range(len(marked)):
                hit = next((grams[marked[at : at + k]] for k in range(5, 0, -1) if at + k <= len(marked) and marked[at : at + k] in grams), None)
                z = [a + 0.5 * b / max(1, len(marked) - 2) for a, b in zip(z, hit)] if hit else z
        e = [math.exp((a - max(z)) / math.sqrt(len(found))) for a in z]
        return sorted(TEXTS)[e.index(max(e))], max(e) / sum(e)

    asked = ["the weather", "der wetterbericht", "les autres themes", "qqq the", "anderes"]
    df = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    for r in language_id.predict(df, model, [F.col("doc_id")]).collect():
        lang, score = naive(asked[r["doc_id"]])
        assert (r["lang_pred"], r["score"]) == (lang, pytest.approx(score))


def test_unnamed_nodes_weigh_as_the_least_named(spark):
    leaves = spark.createDataFrame([("web", lang, "s", 1000, 10) for lang in ("en", "de", "", "xx")], "domain string, lang_key string, source_key string, tokens long, n long")
    got = {r["lang_key"]: r["budget"] for r in mixture.budgets(leaves, mixture.Mixture(languages={"en": 0.55, "de": 0.15}, share=0.2)).collect()}
    assert got == {"en": 440, "de": 120, "": 120, "xx": 120}


@pytest.mark.parametrize("share", [0.37, 1.4])
def test_prefix_of_an_epoch_against_sorting(spark, share):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), "en", "web1") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    setting = mixture.Mixture(share=share, max_epochs=2)
    tokens = {i: len(t.split()) for i, t, *_ in rows}
    total = sum(tokens.values())
    whole, rest = divmod(int(total * share + 1e-6), total)
    placed = df.select("doc_id", F.xxhash64(F.lit(setting.seed), F.lit(whole), F.col("doc_id").cast("string")).alias("h")).collect()
    order = sorted(placed, key=lambda r: ((r["h"] % 2**64) >> 1, r["h"]))
    left, expected = rest, Counter({i: whole for i in tokens})
    for r in order:
        left -= tokens[r["doc_id"]]
        if left < 0:
            break
        expected[r["doc_id"]] += 1
    got = Counter(r["doc_id"] for r in mixture.mix(df, queries.domain(), setting).select("doc_id").collect())
    assert got == +expected

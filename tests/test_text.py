import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import evidence as evd
from tidemark.operators import search as se

CARD = "card_id string, status string, title string, claim string, evidence_refs array<struct<citation string, locator string>>, limitations array<string>"


def _cards(spark, rows):
    return spark.createDataFrame([(i, s, t, c, [("书籍章节", "p1")], []) for i, s, t, c in rows], CARD)


def _ask(spark, text):
    return spark.createDataFrame([(1, text)], "query_id long, text string")


def test_tokens(spark):
    got = spark.range(1).select(tx.tokens(F.lit("Abc_1 锤子线 é乌云x")).alias("t"), tx.token_count(F.lit("Abc_1 锤子线 é乌云x")).alias("n")).first()
    assert got["t"] == ["abc_1", "x", "锤", "子", "线", "锤子", "子线", "锤子线", "乌", "云", "乌云"]
    assert got["n"] == len(got["t"])


def test_page_text_cleaning(spark):
    row = spark.range(1).select(tx.clean_page_text(F.lit(" a\x00b\x07 \t c\n\n\n\nd \x0c")).alias("x"), tx.squeeze(F.lit(" a \n\t b ")).alias("y")).first()
    assert row["x"] == "ab c\n\nd" and row["y"] == "a b"


def test_drafts_are_never_found(spark):
    cards = _cards(spark, [("kc_1", "published", "hammer pattern", "hammer reversal evidence"), ("kc_2", "draft", "hammer draft", "unreviewed")])
    assert [r["card_id"] for r in se.search(cards, _ask(spark, "hammer")).collect()] == ["kc_1"]
    assert se.search(cards, _ask(spark, "  ")).count() == 0


def test_short_chinese_query_ranks_its_title_first(spark):
    cards = _cards(spark, [("kc_dark", "published", "乌云盖顶形态", "上涨后的看跌反转警告"), ("kc_hammer", "published", "锤子线与上吊线", "结合趋势判断"), ("kc_draft", "draft", "乌云盖顶草稿", "未审校")])
    got = se.search(cards, _ask(spark, "乌云盖顶"), 2).orderBy("position").collect()
    assert got[0]["card_id"] == "kc_dark" and got[0]["score"] > 9 and "kc_draft" not in [r["card_id"] for r in got]


def test_named_pattern_beats_a_longer_name(spark):
    cards = _cards(spark, [("kc_hammer", "published", "锤子线与上吊线", "下跌后的锤子线"), ("kc_inverted", "published", "流星线与倒锤子线", "下降后的倒锤子线")])
    for text in ("锤子线", "锤子线需要什么条件？"):
        assert se.search(cards, _ask(spark, text), 2).orderBy("position").first()["card_id"] == "kc_hammer"


def test_answers_or_refuses(spark):
    cards = _cards(spark, [("kc_hammer", "published", "锤子线与上吊线", "下跌后的锤子线"), ("kc_other", "published", "其他说明", "提到锤子线的文字")])
    qs = spark.createDataFrame([(1, "锤子线是什么"), (2, "天气如何")], "query_id long, text string")
    got = {r["query_id"]: r for r in se.answers(qs, se.search(cards, qs, 3)).collect()}
    assert got[1]["status"] == "answered" and got[1]["cards"] == ["kc_hammer"] and got[1]["answer"] == "[证据1] 下跌后的锤子线"
    assert got[2]["status"] == "insufficient_evidence"


def test_html_text(spark):
    html = "<html><head><style>p{}</style><script>var a='</p>';</script></head><body><h1>T &amp; x</h1><p>one<br/>two</p>\n\n\n<div>a <b>b</b></div></body></html>"
    got = spark.range(1).select(tx.html_text(F.lit(html)).alias("t")).first()["t"]
    assert got == "T & x\n\none\n\ntwo\n\na b"


def test_exact_title_counts_however_low_its_terms_rank(spark):
    filler = [(f"kc_{i}", "published", f"note {i}", "alpha alpha alpha") for i in range(30)]
    cards = _cards(spark, [*filler, ("kc_title", "published", "alpha", "many other words that make this card long and its only term light " * 5)])
    assert se.search(cards, _ask(spark, "alpha"), 1).first()["card_id"] == "kc_title"


def test_cycle_of_revisions_is_an_error(spark):
    rows = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "span_id long, supersedes_id long")
    with pytest.raises(ValueError, match="cycle"):
        evd.revisions(rows)


def test_revisions_of_a_long_chain(spark):
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(1000, None), (1001, 5), (1002, 5)]
    got = {r["span_id"]: r["revision"] for r in evd.revisions(spark.createDataFrame(rows, "span_id long, supersedes_id long")).collect()}
    assert got == {**{i: i + 1 for i in range(300)}, 1000: 1, 1001: 7, 1002: 7}


def test_media_signature(spark):
    rows = [("application/pdf", b"%PDF-1.7"), ("image/png", b"\x89PNG\r\n\x1a\n.."), ("image/tiff", b"MM\x00*x"), ("application/pdf", b"PK\x03\x04"), ("image/jpeg", b"")]
    got = spark.createDataFrame(rows, "m string, c binary").select(evd.media_issue(F.col("m"), F.col("c")).alias("i")).collect()
    assert [r["i"] for r in got] == [None, None, None, "signature_mismatch", "empty_file"]


def test_citation_and_locators(spark):
    spans = spark.createDataFrame([(1, 10, 2)], "span_id long, page_id long, revision long")
    pages = spark.createDataFrame([(10, 5, None, 7)], "page_id long, edition_id long, printed_label string, physical_number long")
    editions = spark.createDataFrame([(5, "书", "第二版")], "edition_id long, title string, edition_label string")
    assert evd.citation_labels(spans, pages, editions).first()["citation"] == "[书，第二版，书内第 未标印刷页 页（文件第 7 页），证据 revision 2]"
    cards = spark.createDataFrame([("c", [("pdf_page", "m", "1"), ("pdf_page", "m", "2"), ("pdf_page", "m", "9")])], "card_id string, evidence_refs array<struct<kind string, manifest string, locator string>>")
    loc = spark.createDataFrame([("pdf_page", "m", "1", "text"), ("pdf_page", "m", "2", "  ")], "kind string, manifest string, locator string, text string")
    assert {r["locator"]: r["reason"] for r in evd.locator_issues(cards, loc).collect()} == {"2": "page_without_text", "9": "locator_missing"}


def test_bm25_against_brute_force(spark):
    import math
    from collections import Counter

    texts = {"a": "x y z x", "b": "y y", "c": "q z z z w"}
    cards = spark.createDataFrame([(k, "published", v, "", [], []) for k, v in texts.items()], CARD)
    docs = {k: v.split() for k, v in texts.items()}
    mean = sum(map(len, docs.values())) / 3
    def score(q, d):
        total = 0.0
        for t, n in Counter(q.split()).items():
            df = sum(t in x for x in docs.values())
            tf = docs[d].count(t)
            total += n * math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(docs[d]) / mean))
        return total
    got = {r["card_id"]: r["bm25"] for r in se.bm25(cards, _ask(spark, "x z z"), 5).collect()}
    assert got == pytest.approx({k: score("x z z", k) for k in ("a", "c")})

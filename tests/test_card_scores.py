import random

from pyspark.sql import functions as F

from tidemark.operators import search as se
from tidemark.operators import search_index as si

CARD = "card_id string, status string, title string, claim string, evidence_refs array<struct<citation string, locator string>>, limitations array<string>"


def _cards(spark, n):
    rng = random.Random(7)
    rows = [(f"kc_{i}", "published", "Title", " ".join(["all"] + rng.choices([f"w{j}" for j in range(12)], k=rng.randint(1, 9))), [], []) for i in range(n)]
    rows += [(f"copy_{i}", "published", "Title", "all w1 w1 锤子线", [], []) for i in range(n)]
    return spark.createDataFrame(rows, CARD).repartition(3)


def test_only_best_cards_leave_a_task(spark):
    cards = _cards(spark, 120)
    queries = spark.createDataFrame([(i, f"all w{i} w1 锤子线") for i in range(6)], "query_id long, text string")
    full, few = se.term_scores(cards, queries), se.best_scores(cards, queries, 2)
    assert full.count() == 6 * 240 and few.count() <= 6 * 2 * 3
    want = se.first_by_score(full, 2)
    order = lambda df: sorted((r["query_id"], r["card_id"], round(r["bm25"], 9)) for r in df.collect())
    assert order(se.first_by_score(few, 2)) == order(want)
    with_slack = se.best_scores(cards, queries, 2, se.MOST_BONUS)  # every card here is within the bonus
    assert order(with_slack) == order(full)


def test_blocks_of_questions_and_no_cards(spark, monkeypatch, tmp_path):
    cards = _cards(spark, 10)
    queries = spark.createDataFrame([(i, f"all w{i}") for i in range(5)] + [(9, None), (10, "?")], "query_id long, text string")
    rows = lambda: sorted((r["query_id"], r["card_id"], round(r["bm25"], 9)) for r in se.bm25(cards, queries, 3).collect())
    whole = rows()
    monkeypatch.setattr(se.cs, "BLOCK_QUERIES", 2)
    assert rows() == whole
    none = cards.withColumn("status", F.lit("draft"))
    assert se.bm25(none, queries, 3).count() == 0
    si.build(none, f"{tmp_path}/none", buckets=4)
    assert si.best(spark, f"{tmp_path}/none", queries, 3, 4).count() == 0


def test_index_reads_asked_words_without_an_exchange_of_the_rest(spark, tmp_path):
    si.build(_cards(spark, 60), f"{tmp_path}/i", buckets=4)
    queries = spark.createDataFrame([(0, "w1 w2")], "query_id long, text string")
    plan = si.scores(spark, f"{tmp_path}/i", queries, 2, buckets=4)._jdf.queryExecution().optimizedPlan().toString()
    words = [line for line in plan.splitlines() if "Join LeftSemi" in line and "rightHint=(strategy=broadcast)" in line]
    assert len(words) >= 2  # postings, and blocks at each use

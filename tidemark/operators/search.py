"""BM25 search over knowledge cards, with title bonuses and a relevance gate.

Cards: card_id, status, title, claim, evidence_refs array<struct<citation>>,
limitations array<string>.  Queries: query_id, text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import cjk_grams, key_text, title_entities, token_count, tokens
from tidemark.operators import card_scores as cs
from tidemark.operators.card_scores import B, K1
from tidemark.runtime import stage

# Title bonuses.
EXACT, PREFIX, INSIDE, ENTITY = 8.0, 5.0, 2.0, 4.0
MOST_BONUS = EXACT + ENTITY


def searchable(cards: DataFrame) -> DataFrame:
    """Published cards with the text that is indexed."""
    cites = F.array_join(F.transform("evidence_refs", lambda r: r["citation"]), " ")
    body = F.concat_ws("\n", "title", "claim", cites, F.array_join("limitations", " "))
    return cards.where(F.col("status") == "published").withColumn("body", body)


def term_weights(cards: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """BM25 weight of every (card, term) for the terms the queries use, or for all terms.

    Card length is known before the explode, and tokens outside the query
    vocabulary leave before the shuffle; all tokens of a card sit in one row, so
    counting them is complete in the map task.  Collection size and mean length
    are scalar subqueries.
    """
    published = searchable(cards).select("card_id", "body")
    totals = published.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(token_count(F.col("body"))).alias("mean"))
    docs = published.select("card_id", tokens(F.col("body")).alias("t")).withColumn("len", F.size("t"))
    hits = docs.select("card_id", "len", F.explode("t").alias("term"))
    if queries is not None:
        hits = hits.join(queries.select(F.explode(tokens(F.col("text"))).alias("term")).distinct(), "term", "left_semi")
    # read twice below; without the table every card would be tokenised for each
    tf = stage(hits.groupBy("card_id", "len", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = F.lit(0.0) + F.col("__t.n")
    idf = F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.lit(K1) * (1.0 - B + B * F.col("len") / F.col("__t.mean"))
    packed = totals.select(F.struct("n", "mean").alias("s"))
    return (
        tf.join(df, "term")
        .withColumn("__t", packed.scalar())
        .select("card_id", "term", (idf * F.col("tf") * (K1 + 1.0) / (F.col("tf") + norm)).alias("weight"))
    )


def term_scores(cards: DataFrame, queries: DataFrame) -> DataFrame:
    """BM25 of every (query, card) that share a term: as many rows as pairs; ``best_scores`` is the form for many cards."""
    return term_weights(cards, queries).join(cs.query_terms(queries), "term").groupBy("query_id", "card_id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("bm25"))


def best_scores(cards: DataFrame, queries: DataFrame, k: int, slack: float = 0.0) -> DataFrame:
    """query_id, card_id, bm25 of every card that may be among the k best of its query; both ids are unique.

    ``slack`` is the most that anything later can add to a score.  Each block of queries
    takes one pass over the cards, whose terms among the block's are written once.
    """
    spark, published = cards.sparkSession, searchable(cards).select("card_id", "body")
    kind, card = (d.schema[c].dataType.simpleString() for d, c in ((queries, "query_id"), (cards, "card_id")))
    found = None
    for block in cs.blocks(queries):
        rows = stage(cs.counted(published, block.vocabulary), "postings")
        n, mean = rows.agg(F.count(F.lit(1)), F.avg("len")).first()
        df = np.zeros(len(block.vocabulary))
        for term, holding in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1))).collect():  # one block's vocabulary
            df[term] = holding
        ids = spark.createDataFrame(list(enumerate(block.ids)), f"query int, query_id {kind}")
        hits = cs.best_cards(rows, block, k, slack, float(n), mean or 1.0, df)
        hits = hits.join(F.broadcast(ids), "query").select("query_id", "card_id", "bm25")
        found = hits if found is None else found.unionByName(hits)
    return spark.createDataFrame([], f"query_id {kind}, card_id {card}, bm25 double") if found is None else found


def first_by_score(scores: DataFrame, k: int) -> DataFrame:
    """The k rows of each query with the highest score, pruned to k rows per task and query."""
    order = Window.partitionBy("query_id").orderBy(F.desc(cs.rank_key(F.col("bm25"))), "card_id")
    return scores.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")


def bm25(cards: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best cards of each query by term weight alone."""
    return first_by_score(best_scores(cards, queries, k), k)


def _bonus(title_key: Column, entities: Column, query_key: Column) -> Column:
    some = query_key != ""
    whole = (
        F.when(title_key == query_key, EXACT).when(some & F.startswith(title_key, query_key), PREFIX)
        .when(some & F.contains(title_key, query_key), INSIDE).otherwise(0.0)
    )
    named = F.when(F.exists(entities, lambda e: F.contains(query_key, e)), ENTITY).otherwise(0.0)
    return whole + named


def title_bonus(title: Column, query: Column) -> Column:
    """Exact, prefix or contained title, plus a named entity of the title."""
    return _bonus(key_text(title), title_entities(title), key_text(query))


def search(cards: DataFrame, queries: DataFrame, k: int = 5, scores: DataFrame | None = None) -> DataFrame:
    """Top k cards per query by BM25 and title bonus together.

    A card is left out early only if no bonus could bring it among the k best, so a
    title counts however low its terms rank.  Keys of titles and questions are made
    once per card and question; the other columns join the k winners.
    ``scores`` (query_id, card_id, bm25) may come from a stored index, which then
    has to allow for the bonus (``MOST_BONUS``).
    """
    asked = queries.where(F.trim("text") != "")
    published = cards.where(F.col("status") == "published")
    titles = published.select("card_id", key_text(F.col("title")).alias("__t"), title_entities(F.col("title")).alias("__e"))
    questions = asked.select("query_id", key_text(F.col("text")).alias("__q"))
    scored = (best_scores(cards, asked, k, MOST_BONUS) if scores is None else scores).join(questions, "query_id").join(titles, "card_id")
    scored = scored.select("query_id", "card_id", "bm25", (F.col("bm25") + _bonus(F.col("__t"), F.col("__e"), F.col("__q"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "card_id")
    top = scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
    return top.join(asked, "query_id").join(published.select("card_id", "title", "claim", "limitations", "evidence_refs"), "card_id")


def relevant(hits: DataFrame, least: float = 1.0) -> DataFrame:
    """Hits that say something specific about the question.

    Score at the floor, and a shared CJK trigram or two shared bigrams; if any
    hit of a query names a title entity of three characters, only those stay.
    """
    body = F.concat_ws(" ", "title", "claim", F.array_join("limitations", " "))
    three = F.arrays_overlap(cjk_grams(F.col("text"), (3,)), cjk_grams(body, (3,)))
    two = F.size(F.array_intersect(cjk_grams(F.col("text"), (2,)), cjk_grams(body, (2,)))) >= 2
    question = key_text(F.col("text"))
    direct = F.exists(title_entities(F.col("title")), lambda e: (F.length(e) >= 3) & F.contains(question, e))
    kept = hits.where((F.col("score") >= least) & (F.coalesce(three, F.lit(False)) | two)).withColumn("direct", direct)
    any_direct = F.max(F.col("direct").cast("int")).over(Window.partitionBy("query_id"))
    return kept.withColumn("__any", any_direct).where((F.col("__any") == 0) | F.col("direct")).drop("__any")


def answers(queries: DataFrame, hits: DataFrame, least: float = 1.0) -> DataFrame:
    """Per query: answered with the claims in order, or insufficient_evidence.

    A query has at most k hits, so the lists stay short.
    """
    listed = F.array_sort(F.collect_list(F.struct("position", "card_id", "claim")))
    kept = relevant(hits, least).groupBy("query_id").agg(listed.alias("e"))
    out = queries.select("query_id").join(kept, "query_id", "left")
    return out.select(
        "query_id",
        F.when(F.col("e").isNull(), "insufficient_evidence").otherwise("answered").alias("status"),
        F.array_join(
            F.transform(F.col("e"), lambda x, i: F.concat(F.lit("[证据"), (i + 1).cast("string"), F.lit("] "), x["claim"])), "\n\n"
        ).alias("answer"),
        F.transform("e", lambda x: x["card_id"]).alias("cards"),
    )


def citations(cards: DataFrame) -> DataFrame:
    """Citations of the cards, each (card, locator) once."""
    rows = cards.select("card_id", "title", F.posexplode("evidence_refs").alias("pos", "ref"))
    first = rows.groupBy("card_id", F.col("ref.locator").alias("locator")).agg(F.min_by(F.struct("title", "ref"), "pos").alias("r"))
    return first.select("card_id", F.col("r.title").alias("title"), "locator", F.col("r.ref.citation").alias("citation"))

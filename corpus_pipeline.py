"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's documents. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixture, ngram_join, packing, quality_ledger, queries, toxicity
from tidemark.llm.common import held_out, table
from tidemark.llm.pretokens import vocabulary
from tidemark.runtime import stage

NEAR_WORDS, NEAR_PERCENT = 5, 80
TOXIC = 0.5
#: Pieces of half a sequence, at most 24 in one, and one and a half full pieces' attention: each of the three can bind.
CAPACITY = packing.Capacity(tokens=queries.SEQUENCE, piece=1024, documents=24, attention=3 * 1024**2 // 2)


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the current policy."""
    text_only = docs.select(F.struct(*_all(docs)).alias("row"), "text")
    return quality_ledger.kept(quality_ledger.ledger(text_only, [F.col("row")])).select("row.*")


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    rows = docs.select(F.struct(*_all(docs)).alias("row"), "text")
    return toxicity.predict(rows, model, [F.col("row")]).filter(F.col("score") < TOXIC).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies.

    Rows without an id come last; texts of one id are each compared; of rows that
    repeat id and text one stays, also where the text has no words.
    """
    return ngram_join.first_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture's epochs take them."""
    return mixture.mix(docs, queries.domain(), queries.MIXTURE).select(*_all(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mixture", source_mixture),
    ("best_fit_packing", best_fit_packing),
]

#: Learned scores, link components and the packing plan have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Helpers the operators share: tables, the fold rule, Arrow batches, bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = 5
_FINE = 10**15
WORD_BREAKS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text mod 5; NULL ids count as held out (fold 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a task holds the Python objects of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bounded_sample(df: DataFrame, key: Column, rows: int, n: int | None = None) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of ``key`` (no NULLs); all rows if there are no more.

    Used only to fit classifiers and to fill caches, never to choose results. The
    hash is cut fine enough for any number of rows.
    """
    df = df.filter(key.isNotNull())
    n = df.count() if n is None else n
    if n <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(_FINE)) < _FINE * rows // n)


def words(text: Column) -> Column:
    """Words between ASCII white space, as an array; empty for NULL."""
    return F.coalesce(F.array_remove(F.split(text, WORD_BREAKS), ""), F.array().cast("array<string>"))

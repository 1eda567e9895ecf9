"""Event tables on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_events(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Observations or outcomes, one folder per rule.

    The commit protocol of the writer stands in for batch markers: readers see
    a finished write or none.  Rules differ in size, so rows are spread over
    rule and symbol, not over rule alone.
    """
    rows.repartition("rule_id", "symbol").write.mode(mode).partitionBy("rule_id").parquet(path)


def read_events(spark: SparkSession, path: str, rule_id: str | None = None, schema: StructType | None = None) -> DataFrame:
    """Events of all rules or of one.

    A write without events leaves a folder without files, which says nothing of
    their columns: where that may happen, ``schema`` names them.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df if rule_id is None else df.where(F.col("rule_id") == rule_id)

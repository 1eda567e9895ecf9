"""A keyed table in partitions: an append or upsert reads and rewrites only what it touches.

The key determines the partition, so rows of one key meet in one partition and an
earlier row can't hide in another. A batch is merged with the stored rows of its
own partitions, written aside, and then put in their place (dynamic partition
overwrite); all other partitions are neither read nor written. Doing a batch again
gives the same table, so a failed or repeated commit needs no clean-up.

Within a partition the merge is one aggregation with partial sums in the map tasks:
copies of a key, however many, cost a row a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runtime import stage

MOST_PARTITIONS = 10_000


@dataclass(frozen=True)
class Store:
    """A table under ``path`` with unique ``key``, in partitions ``name -> column of the key``."""

    path: str
    key: tuple[str, ...]
    partitions: dict[str, Column]

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows, or None where nothing was committed yet."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        return spark.read.parquet(self.path) if files.exists(folder) else None

    def append(self, rows: DataFrame) -> None:
        """Adds the rows whose key is not stored; stored rows stay as they are."""
        self._merge(rows, stored_first=True)

    def upsert(self, rows: DataFrame) -> None:
        """Adds rows and replaces stored ones of the same key; of several in the batch the largest stays."""
        self._merge(rows, stored_first=False)

    def _merge(self, rows: DataFrame, stored_first: bool) -> None:
        names = list(self.partitions)
        batch = stage(rows.withColumns(self.partitions), "batch")
        touched = batch.select(*names).distinct().limit(MOST_PARTITIONS + 1).collect()  # partitions of one batch, not rows
        if len(touched) > MOST_PARTITIONS:
            raise ValueError(f"a batch touches more than {MOST_PARTITIONS} partitions; choose wider ones")
        if not touched:
            return
        old = self.read(rows.sparkSession)
        merged = batch.withColumn("__new", F.lit(1))
        if old is not None:
            merged = merged.unionByName(old.where(self._within(touched)).select(*batch.columns).withColumn("__new", F.lit(0)))
        rest = [c for c in batch.columns if c not in (*self.key, *names)]
        rank = F.struct((-F.col("__new") if stored_first else F.col("__new")).alias("__new"), *rest)
        once = merged.groupBy(*self.key, *names).agg(F.max_by(F.struct("__new", *rest), rank).alias("r"))
        aside = stage(once.select(*self.key, *[f"r.{c}" for c in rest], *names), "merged")
        aside.repartition(*names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(self.path)

    def _within(self, touched: list) -> Column:
        """The touched partitions as a filter that prunes folders."""
        names = list(self.partitions)
        if len(names) == 1:
            return F.col(names[0]).isin([r[0] for r in touched])
        return F.concat_ws("/", *[F.col(n).cast("string") for n in names]).isin(["/".join(str(v) for v in r) for r in touched])

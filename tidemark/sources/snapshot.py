"""Content snapshots of files, or of any table of (role, path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, roles: dict[str, str], pattern: str = "*.parquet") -> DataFrame:
    """(role, path, content) of every file under each role's folder, by Spark's own
    file source, hence from any store Spark reads. A file is one value (2 GB at most)."""
    files = None
    for role, folder in sorted(roles.items()):
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
        found = found.select(F.lit(role).alias("role"), "path", "content")
        files = found if files is None else files.unionByName(found)
    return files


def content_snapshot(files: DataFrame) -> DataFrame:
    """(role, path, size, sha256) of each content; nothing is shuffled."""
    content = F.col("content").cast("binary")
    return files.select("role", "path", F.length(content).cast("long").alias("size"), F.concat(F.lit("sha256:"), F.sha2(content, 256)).alias("sha256"))


def snapshot_id(snapshot: DataFrame) -> DataFrame:
    """One digest over the file list in (role, path) order.

    The list holds one short entry per file; it is folded in two steps, first
    per 4,096 groups of paths and then over the group digests, so no task ever
    holds the whole list.
    """
    entry = F.concat_ws("|", "role", "path", F.col("size").cast("string"), "sha256")
    group = F.substring(F.sha2("path", 256), 1, 3)
    parts = snapshot.groupBy(group.alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("d"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), "\n")
    return parts.agg(F.concat(F.lit("sha256:"), F.sha2(joined, 256)).alias("snapshot_id"))


def verify_snapshot(manifest: DataFrame, fresh: DataFrame) -> DataFrame:
    """Files that are missing, new, or differ in size or content."""
    m = manifest.select("role", "path", F.col("size").alias("__s"), F.col("sha256").alias("__h"))
    both = m.join(fresh, ["role", "path"], "full_outer")
    reason = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("__h").isNull(), "not_in_manifest")
        .when(F.col("size") != F.col("__s"), "size_mismatch")
        .when(F.col("sha256") != F.col("__h"), "content_mismatch")
    )
    return both.select("role", "path", reason.alias("reason")).where(F.col("reason").isNotNull())

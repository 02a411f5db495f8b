"""Table writers: upsert by key, rebuild, and partition overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("rn_", F.row_number().over(order)).where("rn_ = 1").drop("rn_")


def merge_into(spark: SparkSession, path: str, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The table at path with fresh rows in place of those with the same keys."""
    old = spark.read.parquet(path)
    return old.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def rebuild(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Full recompute: the table is what rows holds."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_partitions(rows: DataFrame, path: str, partition_by: list[str]) -> None:
    """Only the partitions that rows touch are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def read_volumes(spark: SparkSession, path: str, upto: int, schema: str | None = None) -> DataFrame:
    """Volumes 1 to upto of a table partitioned by vol; others are pruned."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path).where(F.col("vol") <= upto)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append(rows: DataFrame, path: str) -> None:
    """Rows added to a log; what is there stays."""
    rows.write.mode("append").parquet(path)


def write_tree(pages: DataFrame, path: str) -> None:
    """A folder of pages for each cutoff: pages(cutoff, slug, page), one file a page."""
    pages.repartition("cutoff", "slug").select("page", "cutoff", "slug").write.mode("overwrite").partitionBy("cutoff", "slug").text(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(cutoff, slug, page) of a tree of pages; a filter on cutoff prunes folders."""
    files = spark.read.schema("page string, cutoff int, slug string").text(path, wholetext=True)
    return files.select("cutoff", "slug", F.regexp_replace("page", r"\n\z", "").alias("page"))

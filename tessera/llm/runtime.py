"""What the operators of this subpackage share: the shared folder, written tables, tokens."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white space bytes.
WORD = r"[^\x20\x09-\x0D]+"


#: Tables written and not yet discarded.
_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master, where driver and executors are one process, gets a
    folder of its own when the setting is missing.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """Where the list of written tables stands."""
    return len(_paths)


def discard(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Delete the tables written since the mark, but for those that keep reads; nothing lazy may need them any more."""
    files = [f.replace("file:///", "/").replace("file:/", "/") for f in keep.inputFiles()]
    for path in _paths[since:]:
        if not any(f.startswith(path.replace("file://", "")) or path in f for f in files):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            _paths.remove(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo folds, is fold; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def n_words(text: Column) -> Column:
    """Number of words, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_words(text: str | None) -> list[bytes]:
    """Words of the text in UTF-8 with A-Z lower-cased; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []

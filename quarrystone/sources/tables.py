"""Reading: driver tables, store tables, pack folders, ordered key scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def point_get(df: DataFrame, **key) -> DataFrame:
    """The row with this key, or none; equality reaches the Parquet scan."""
    for k, v in key.items():
        df = df.where(F.col(k) == v)
    return df


def range_scan(df: DataFrame, key: str, start, end) -> DataFrame:
    """Rows with start <= key < end, in key order."""
    return df.where((F.col(key) >= start) & (F.col(key) < end)).orderBy(key)


def page(df: DataFrame, keys: list[str], cursor: tuple | None, limit: int) -> DataFrame:
    """The first ``limit`` rows after the cursor in key order, with has_more: whether the limit was reached."""
    if cursor is not None:
        df = df.where(after(keys, cursor))
    n = F.count("*").over(Window.partitionBy(F.lit(0)))  # over a page, which one task holds anyway
    return df.orderBy(*keys).limit(limit).withColumn("has_more", n >= limit)


def after(keys: list[str], cursor: tuple) -> Column:
    """Rows whose keys are greater than the cursor's, lexicographically."""
    out, same = F.lit(False), F.lit(True)
    for k, v in zip(keys, cursor, strict=True):
        out, same = out | (same & (F.col(k) > v)), same & (F.col(k) == v)
    return out


def pack_files(spark: SparkSession, root: str) -> DataFrame:
    """(pack_id, length) of pack files in the store's folders; other files are skipped and contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "pack-*.vpk").option("recursiveFileLookup", True).load(root)
    return files.select(scalars.pack_id_of("path").alias("pack_id"), F.col("length")).where("pack_id is not null").orderBy("pack_id")


def tree_size(spark: SparkSession, root: str) -> DataFrame:
    """Total bytes of all files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def statfs(spark: SparkSession, root: str) -> DataFrame:
    """(capacity, used, available) of the storage that holds a folder, in bytes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getStatus(path)
    return spark.createDataFrame([(status.getCapacity(), status.getUsed(), status.getRemaining())], "capacity long, used long, available long")


def publish(df: DataFrame, root: str, version: int) -> str:
    """One commit: a new version folder, complete or absent; earlier versions stay readable."""
    path = f"{root.rstrip('/')}/v{version:012d}"
    df.write.mode("errorifexists").parquet(path)
    return path

"""Integrity audits and logical sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import refcounts


def orphan_extents(extents: DataFrame, inodes: DataFrame) -> DataFrame:
    """Extents whose inode doesn't exist, each row."""
    return extents.join(inodes.select("ino"), "ino", "left_anti")


def missing_chunks(extents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct hashes of extents that no chunk row has."""
    return extents.select("hash").distinct().join(chunks.select("hash"), "hash", "left_anti")


def refcount_mismatches(chunks: DataFrame, extents: DataFrame) -> DataFrame:
    """(hash, refcount, refs) of chunks whose stored count differs from their extents'."""
    refs = F.coalesce("refs", F.lit(0)).alias("refs")
    return chunks.join(refcounts(extents), "hash", "left").select("hash", "refcount", refs).where("refcount <> refs")


def orphan_dirents(dirents: DataFrame, inodes: DataFrame) -> DataFrame:
    return dirents.join(inodes.select("ino"), "ino", "left_anti")


def stored_bytes(chunks: DataFrame) -> DataFrame:
    """Sums over all chunk rows, those without references too."""
    return chunks.agg(F.sum("ulen").alias("uncompressed"), F.sum("clen").alias("compressed"))


def readable(extents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Extents with their chunk; one without fails the query."""
    both = extents.join(chunks.drop("refcount"), "hash", "left")
    return both.withColumn("clen", F.when(F.col("clen").isNull(), F.raise_error(F.concat(F.lit("no chunk "), F.col("hash")))).otherwise(F.col("clen")))

"""Deduplication by content hash: what is new, and how reference counts change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_hashes(incoming: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of ``incoming`` for each hash that no chunk has."""
    return incoming.join(chunks.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])


def dedup_stats(extents: DataFrame, block: int) -> DataFrame:
    """Blocks, distinct blocks and bytes in one row; counts are partial before the shuffle."""
    by = extents.groupBy("hash").agg(F.count("*").alias("n"), F.sum("used").alias("used"))
    return by.agg(F.sum("n").alias("blocks"), F.count("*").alias("distinct_blocks"), F.sum("used").alias("logical_bytes"), (F.count("*") * block).alias("stored_bytes"), (F.sum("n") / F.count("*")).alias("dedup_ratio"))


def net_deltas(replaced: DataFrame) -> DataFrame:
    """(hash, delta) of changed blocks (old_hash, hash): +1 for the new, -1 for the old; unchanged blocks and zero sums are left out."""
    changed = replaced.where(~F.col("old_hash").eqNullSafe(F.col("hash")))
    rows = changed.select(F.explode(F.array(F.struct(F.col("hash").alias("hash"), F.lit(1).alias("d")), F.struct(F.col("old_hash").alias("hash"), F.lit(-1).alias("d")))).alias("x")).select("x.*").where("hash is not null")
    return rows.groupBy("hash").agg(F.sum("d").alias("delta")).where("delta <> 0")


def apply_deltas(chunks: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counts never fall below 0; an unknown hash with a positive delta becomes a row (its other columns null), others are ignored."""
    both = chunks.join(deltas, "hash", "full_outer").where("refcount is not null or delta > 0")
    return both.withColumn("refcount", F.greatest(F.coalesce("refcount", F.lit(0)) + F.coalesce("delta", F.lit(0)), F.lit(0))).select(*chunks.columns)


def apply_deltas_strict(chunks: DataFrame, deltas: DataFrame) -> DataFrame:
    """As apply_deltas, but a negative count or an unknown hash with a positive delta fails the query."""
    both = chunks.join(deltas, "hash", "full_outer").where("refcount is not null or delta > 0")
    count = F.col("refcount") + F.coalesce("delta", F.lit(0))
    checked = F.when(F.col("refcount").isNull(), F.raise_error(F.lit("a chunk is missing"))).when(count < 0, F.raise_error(F.lit("a count falls below 0"))).otherwise(count)
    return both.withColumn("refcount", checked).select(*chunks.columns)


def decrements(extents: DataFrame) -> DataFrame:
    """(hash, delta): -1 for each occurrence of a hash."""
    return extents.groupBy("hash").agg((-F.count("*")).alias("delta"))


def refcounts(extents: DataFrame) -> DataFrame:
    """References to each hash, from all extents."""
    return extents.groupBy("hash").agg(F.count("*").alias("refs"))

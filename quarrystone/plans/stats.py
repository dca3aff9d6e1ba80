"""The store's report: one row of totals, and its text form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import human_bytes, ratio
from ..operators import audit
from ..operators.dedup import refcounts


def collect_stats(inodes: DataFrame, extents: DataFrame, chunks: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row; ``sizes`` has (scope, files, bytes).

    Chunks meet their references in one full join, which serves all counts and sums over them.
    """
    known = F.col("refcount").isNotNull()
    both = chunks.select("hash", "refcount", "ulen", "clen").join(refcounts(extents), "hash", "full_outer")
    parts = [
        inodes.agg(F.count("*").alias("inodes"), F.count_if(F.col("kind") == 1).alias("files"), F.count_if(F.col("kind") == 2).alias("directories")),
        sizes.agg(F.coalesce(F.sum(F.when(F.col("scope") == "live", F.col("bytes"))), F.lit(0)).alias("live_bytes"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("logical_bytes")),
        both.agg(
            F.sum("ulen").alias("uncompressed"),
            F.sum("clen").alias("compressed"),
            F.count("refcount").alias("chunks"),
            F.count_if(F.col("refcount") == 0).alias("zero_ref_chunks"),
            F.count_if(~known).alias("missing_chunks"),
            F.count_if(known & (F.coalesce("refs", F.lit(0)) != F.col("refcount"))).alias("refcount_mismatches"),
        ),
        audit.orphan_extents(extents, inodes).agg(F.count("*").alias("orphan_extents")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def with_ratios(stats: DataFrame) -> DataFrame:
    """Adds savings, dedup ratio and whether the three counters are 0."""
    saved = F.greatest(F.lit(0.0), 1 - ratio("compressed", "uncompressed"))
    clean = (F.col("orphan_extents") == 0) & (F.col("missing_chunks") == 0) & (F.col("refcount_mismatches") == 0)
    return stats.withColumn("compression_savings", saved).withColumn("dedup_ratio", ratio("logical_bytes", "uncompressed")).withColumn("disk_delta", F.col("logical_bytes") - F.col("compressed")).withColumn("consistent", clean)


def report(stats: DataFrame) -> DataFrame:
    """(position, metric, value, readable) rows of a stats row."""
    names = ["inodes", "files", "directories", "live_bytes", "logical_bytes", "uncompressed", "compressed", "chunks", "zero_ref_chunks", "orphan_extents", "missing_chunks", "refcount_mismatches"]
    rows = F.array(*(F.struct(F.lit(k).alias("position"), F.lit(n).alias("metric"), F.col(n).cast("bigint").alias("value")) for k, n in enumerate(names)))
    size = F.col("metric").rlike("bytes|compressed")
    return stats.select(F.inline(rows)).select("position", "metric", "value", F.when(size, human_bytes("value")).otherwise(F.col("value").cast("string")).alias("readable"))

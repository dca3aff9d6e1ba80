"""Garbage collection: candidates, discard log, thresholds, offline rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SCAN_BATCH
from ..functions.scalars import ratio
from .order import numbered_pages
from .packs import pack_sizes


def zero_ref_scan(chunks: DataFrame, cursor: str | None = None, limit: int = SCAN_BATCH) -> DataFrame:
    """(hash, pack_id, clen, next_cursor): unreferenced chunks among the next ``limit`` keys after the cursor."""
    rest = chunks if cursor is None else chunks.where(F.col("hash") > cursor)
    batch = rest.select("hash", "refcount", "pack_id", "clen").orderBy("hash").limit(limit)
    last = F.max("hash").over(Window.partitionBy(F.lit(0)))  # of a page, which one task holds anyway
    return batch.withColumn("next_cursor", last).where("refcount = 0").drop("refcount")


def zero_ref_pages(chunks: DataFrame, limit: int = SCAN_BATCH) -> DataFrame:
    """(hash, pack_id, clen, next_cursor): what following zero_ref_scan's cursor from the first key to the last gives, all pages at once."""
    paged = numbered_pages(chunks.select("hash", "refcount", "pack_id", "clen"), ["hash"], limit)
    last = paged.groupBy("page").agg(F.max("hash").alias("next_cursor"))
    return paged.where("refcount = 0").join(last, "page").select("hash", "pack_id", "clen", "next_cursor")


def delete_candidates(chunks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Chunk rows without those candidates that are still unreferenced now."""
    dead = chunks.where("refcount = 0").join(candidates.select("hash"), "hash", "left_semi")
    return chunks.join(dead.select("hash"), "hash", "left_anti")


def live_hashes(chunks: DataFrame) -> DataFrame:
    return chunks.where("refcount > 0").select("pack_id", "hash")


def latest_discards(discards: DataFrame) -> DataFrame:
    """One record for each (pack, hash): the last epoch's."""
    w = Window.partitionBy("pack_id", "hash").orderBy(F.desc("epoch"))
    return discards.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def dead_bytes(discards: DataFrame, index: DataFrame) -> DataFrame:
    """(pack_id, dead, size, percent): dead payload against the pack's size with headers."""
    dead = latest_discards(discards).groupBy("pack_id").agg(F.sum("bytes").alias("dead"))
    return dead.join(pack_sizes(index), "pack_id").select("pack_id", "dead", "size", (ratio("dead", "size") * 100).alias("percent"))


def worth_rewriting(per_pack: DataFrame, active: int, min_bytes: int, min_percent: float) -> DataFrame:
    """Packs over either threshold; never the active one, nor empty ones."""
    return per_pack.where((F.col("pack_id") != active) & (F.col("size") > 0) & ((F.col("dead") >= min_bytes) | (F.col("percent") >= min_percent)))


def without_packs(discards: DataFrame, packs: DataFrame) -> DataFrame:
    """The log after these packs were rewritten."""
    return discards.join(packs.select("pack_id"), "pack_id", "left_anti")


def liveness(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Index entries with ``state``: live only if the chunk is referenced and lies in this very pack."""
    own = chunks.select("hash", "refcount", F.col("pack_id").alias("home"))
    both = index.join(own, "hash", "left")
    state = F.when(F.col("home").isNull(), "unknown").when(F.col("refcount") <= 0, "unreferenced").when(F.col("home") != F.col("pack_id"), "elsewhere").otherwise("live")
    return both.withColumn("state", state)


def rebuilt_discards(index: DataFrame, chunks: DataFrame, epoch: int) -> DataFrame:
    """(epoch, pack_id, hash, bytes): a discard record for each dead (pack, hash), duplicates collapsed."""
    dead = liveness(index, chunks).where("state <> 'live'")
    return dead.groupBy("pack_id", "hash").agg(F.max("clen").alias("bytes")).select(F.lit(epoch).cast("bigint").alias("epoch"), "pack_id", "hash", "bytes")


def offline_report(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counters of a rebuild, in one row."""
    rows = liveness(index, chunks)
    per = rows.groupBy("pack_id", "hash", "state").agg(F.count("*").alias("n"), F.max("clen").alias("clen"))
    dead = F.col("state") != "live"
    return per.agg(
        F.count_distinct("pack_id").alias("packs"),
        F.sum("n").alias("entries"),
        F.sum(F.when(dead, 0).otherwise(F.col("n"))).alias("live_entries"),
        F.sum(F.when(F.col("state") == "unknown", F.col("n")).otherwise(0)).alias("unknown_entries"),
        F.sum(F.when(F.col("state") == "unreferenced", F.col("n")).otherwise(0)).alias("unreferenced_entries"),
        F.sum(F.when(F.col("state") == "elsewhere", F.col("n")).otherwise(0)).alias("elsewhere_entries"),
        F.sum(F.when(dead, F.col("n") - 1).otherwise(0)).alias("collapsed_duplicates"),
        F.count_if(dead).alias("discards"),
        F.sum(F.when(dead, F.col("clen")).otherwise(0)).alias("discard_bytes"),
    )


def split_log(records: DataFrame, checkpoint: int, ok) -> tuple[DataFrame, DataFrame]:
    """(valid records, one row with their number and that of invalid ones) before the checkpoint position."""
    own = records.where(F.col("pos") < checkpoint)
    return own.where(ok), own.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))

"""Fixed-size blocks: split, pad, patch, truncate, and the counts of a write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def padded(data: Column, size: int) -> Column:
    """Binary data cut or zero-filled to ``size`` bytes."""
    return F.rpad(F.substring(data, 1, size), size, F.lit(b"\0"))


def split_blocks(df: DataFrame, key: str, data: str, size: int) -> DataFrame:
    """(key, block_idx, used, data): every block of each row's bytes; empty data has none."""
    n = F.octet_length(F.col(data))
    blocks = df.where(n > 0).select(key, F.col(data).alias("__d"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / size))).alias("block_idx"))
    part = F.substring(F.col("__d"), (F.col("block_idx") * size + 1).cast("int"), F.lit(size))
    return blocks.select(key, "block_idx", F.octet_length(part).cast("bigint").alias("used"), padded(part, size).alias("data"))


def patched(old: Column, new: Column, start: Column, size: int) -> Column:
    """``old`` (or zeros) with ``new`` laid over it from byte ``start`` (from 0)."""
    base = padded(F.coalesce(old, F.lit(b"")), size)
    return F.concat(F.substring(base, F.lit(1), start.cast("int")), new, F.substring(base, (start + F.octet_length(new) + 1).cast("int"), F.lit(size)))


def truncated(old: Column, keep: Column, size: int) -> Column:
    """A boundary block after truncation: ``keep`` bytes, then zeros."""
    return F.rpad(F.substring(old, F.lit(1), keep.cast("int")), size, F.lit(b"\0"))


def write_blocks(ops: DataFrame, size: int) -> DataFrame:
    """(seq, ino, block_idx, dst_start, part) of write operations (seq, ino, offset, data): the blocks each touches."""
    end = F.col("offset") + F.octet_length("data")
    touched = ops.where(F.octet_length("data") > 0).withColumn("block_idx", F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor((end - 1) / size))))
    begin = F.greatest(F.col("offset"), F.col("block_idx") * size)
    stop = F.least(end, (F.col("block_idx") + 1) * size)
    return touched.select("seq", "ino", "block_idx", (begin - F.col("block_idx") * size).alias("dst_start"), F.substring("data", (begin - F.col("offset") + 1).cast("int"), (stop - begin).cast("int")).alias("part"))


def patch_blocks(ops: DataFrame, stored: DataFrame, size: int) -> DataFrame:
    """(ino, block_idx, old_hash, hash, data): blocks as one batch of non-overlapping writes leaves them.

    ``stored`` has (ino, block_idx, hash, data).  Blocks that no row of it has start as zeros.
    """
    parts = write_blocks(ops, size).groupBy("ino", "block_idx").agg(F.array_sort(F.collect_list(F.struct("dst_start", "part"))).alias("parts"))
    old = stored.select("ino", "block_idx", F.col("hash").alias("old_hash"), F.col("data").alias("__old"))
    both = parts.join(old, ["ino", "block_idx"], "left")
    new = F.aggregate("parts", padded(F.coalesce("__old", F.lit(b"")), size), lambda acc, p: patched(acc, p["part"], p["dst_start"], size))
    return both.select("ino", "block_idx", "old_hash", F.md5(new).alias("hash"), new.alias("data"))


def hits_and_misses(changed: DataFrame, chunks: DataFrame) -> DataFrame:
    """(hits, misses) of changed blocks (op, hash): the first block of a hash in an op that no chunk has is a miss."""
    per = changed.groupBy("op", "hash").agg(F.count("*").alias("n")).join(chunks.select("hash", F.lit(True).alias("known")), "hash", "left")
    miss = F.when(F.col("known").isNull(), 1).otherwise(0)
    return per.agg(F.coalesce(F.sum(F.col("n") - miss), F.lit(0)).alias("hits"), F.coalesce(F.sum(miss), F.lit(0)).alias("misses"))

"""The write path as one plan: blocks, dedup, new chunks, packs, counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import blocks, dedup, dml, packs
from ..shared import stored


@dataclass
class Commit:
    extents: DataFrame
    chunks: DataFrame
    inodes: DataFrame
    new_chunks: DataFrame


def commit_writes(ops: DataFrame, inodes: DataFrame, extents: DataFrame, chunks: DataFrame, payloads: DataFrame, size: int, pack_limit: int, writers: int = 16, level: int = 3) -> Commit:
    """State after a batch of non-overlapping writes (seq, ino, offset, data).

    ``payloads`` has (hash, data) of stored chunks.  New chunks are compressed and dealt by hash to ``writers``
    writers, each of which appends to packs of its own: (hash, writer, pack_no, offset, codec, ulen, clen, payload).
    Only lengths pass through the writers' ordered folds.
    """
    held = extents.join(payloads, "hash").select("ino", "block_idx", "hash", "data")
    changed = stored(blocks.patch_blocks(ops, held, size).where(~F.col("old_hash").eqNullSafe(F.col("hash"))), "changed")
    fresh = dedup.new_hashes(changed.select("hash", "data"), chunks)
    made = fresh.select("hash", F.pmod(F.xxhash64("hash"), F.lit(writers)).cast("int").alias("writer"), codecs.compress(level)("data").alias("z"))
    made = stored(made.select("hash", "writer", "z.*"), "made")
    placed = packs.assign_packs(made.select("hash", "writer", "clen"), "writer", ["hash"], pack_limit).select("hash", "pack_no", "offset")
    packed = made.join(placed, "hash")
    rows = packed.select("hash", F.lit(0).cast("bigint").alias("refcount"), "pack_no", "ulen", "clen")
    known = chunks.select("hash", "refcount", F.lit(None).cast("bigint").alias("pack_no"), "ulen", "clen")
    counted = dedup.apply_deltas(known.unionByName(rows), dedup.net_deltas(changed))
    ends = ops.groupBy("ino").agg(F.max(F.col("offset") + F.octet_length("data")).alias("__end"))
    grown = inodes.join(ends, "ino", "left").withColumn("size", F.greatest("size", F.coalesce("__end", F.lit(0)))).select(*inodes.columns)
    return Commit(dml.upsert(extents.select("ino", "block_idx", "hash"), changed.select("ino", "block_idx", "hash"), ["ino", "block_idx"]), counted, grown, packed)

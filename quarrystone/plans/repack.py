"""Rewriting all chunk rows, unreferenced ones too, to packs of another size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.packs import assign_packs


def repack(chunks: DataFrame, limit: int) -> DataFrame:
    """Chunks with new packs, in (pack_id, hash) order within each old pack; packs of different old packs don't mix."""
    moved = assign_packs(chunks, "pack_id", ["hash"], limit)
    return moved.select("hash", "refcount", F.col("pack_id").alias("old_pack_id"), "pack_no", "offset", "codec", "ulen", "clen")


def check_pack_size(stored_mb: int | None, configured_mb: int) -> None:
    """A store made with another pack size must be migrated first."""
    if stored_mb is not None and stored_mb != configured_mb:
        raise ValueError(f"the store has packs of {stored_mb} MB, {configured_mb} are configured; repack it first")

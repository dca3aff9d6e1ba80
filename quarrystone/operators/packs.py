"""Pack files as tables: assignment of records, offsets, verification, compaction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import PACK_HEADER


def assign_packs(records: DataFrame, writer: str, order: list[str], limit: int, first: int = 1, size: str = "clen", header: int = PACK_HEADER) -> DataFrame:
    """``records`` with pack_no (from ``first``, for each writer) and offset.

    A pack is closed before a record that would take it over ``limit``, unless it is empty.  The sum
    that starts anew at each rotation depends on all rows before, so each writer's rows
    stream in order through one task, which holds three numbers.
    """
    schema = T.StructType([*records.schema.fields, T.StructField("pack_no", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        who, pack, used = object(), first, 0
        for batch in batches:
            packs, offsets = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for k, (w, n) in enumerate(zip(batch.column(writer).to_pylist(), batch.column(size).to_pylist(), strict=True)):
                if w != who:
                    who, pack, used = w, first, 0
                own = header + n
                if used and used + own > limit:
                    pack, used = pack + 1, 0
                packs[k], offsets[k] = pack, used
                used += own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packs), pa.array(offsets)], schema=pa.schema([*batch.schema, ("pack_no", pa.int64()), ("offset", pa.int64())]))

    return records.repartition(writer).sortWithinPartitions(writer, *order).mapInArrow(run, schema)


def with_offsets(records: DataFrame, header: int = PACK_HEADER) -> DataFrame:
    """Byte offset of each record (pack_id, seq, clen): the sum of those before it."""
    w = Window.partitionBy("pack_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum(F.col("clen") + header).over(w), F.lit(0)))


def last_entries(index: DataFrame) -> DataFrame:
    """Where a hash has several entries in a pack, the last one wins."""
    w = Window.partitionBy("pack_id", "hash").orderBy(F.desc("offset"))
    return index.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def mismatches(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """(hash, pack_id, problem) of chunks whose index entry is missing or tells another codec or length."""
    own = last_entries(index).select("pack_id", "hash", *(F.col(c).alias(f"i_{c}") for c in ("codec", "ulen", "clen")))
    both = chunks.join(own, ["pack_id", "hash"], "left")
    problem = F.when(F.col("i_ulen").isNull(), "missing")
    for c in ("codec", "ulen", "clen"):
        problem = problem.when(F.col(f"i_{c}") != F.col(c), c)
    return both.select("hash", "pack_id", problem.alias("problem")).where("problem is not null")


def compacted(index: DataFrame, live: DataFrame, active: int, header: int = PACK_HEADER) -> DataFrame:
    """The index after rewriting packs to their live hashes (pack_id, hash): first occurrences in offset order, new offsets.

    The active pack is left as it is.
    """
    w = Window.partitionBy("pack_id", "hash").orderBy("offset")
    kept = index.where(F.col("pack_id") != active).join(live.select("pack_id", "hash"), ["pack_id", "hash"], "left_semi").withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    order = Window.partitionBy("pack_id").orderBy("offset")
    moved = with_offsets(kept.withColumn("seq", F.row_number().over(order)), header)
    return moved.select("pack_id", "hash", "offset", "codec", "ulen", "clen").unionByName(index.where(F.col("pack_id") == active).select("pack_id", "hash", "offset", "codec", "ulen", "clen"))


def pack_sizes(index: DataFrame, header: int = PACK_HEADER) -> DataFrame:
    return index.groupBy("pack_id").agg(F.sum(F.col("clen") + header).alias("size"), F.count("*").alias("records"))

"""Joining neighbouring writes: only a write that touches the one just before it, of the same inode, joins it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def appended_runs(ops: DataFrame, lane: str) -> DataFrame:
    """(lane, run, ino, first_seq, offset, length, ops) of writes that only append, in arrival order within each lane.

    A run goes on while inode and position continue the previous write's; all in window functions.
    """
    w = Window.partitionBy(lane).orderBy("seq")
    goes_on = (F.lag("ino").over(w) == F.col("ino")) & (F.lag(F.col("offset") + F.col("length")).over(w) == F.col("offset"))
    marked = ops.withColumn("run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w))
    return marked.groupBy(lane, "run").agg(F.first("ino").alias("ino"), F.min("seq").alias("first_seq"), F.min("offset").alias("offset"), F.sum("length").alias("length"), F.count("*").alias("ops"))


def merge(a: tuple[int, bytes], b: tuple[int, bytes]) -> tuple[int, bytes]:
    """Union of two touching (offset, data) writes; bytes of the later one win.

    >>> merge((0, b"abcd"), (2, b"XY!"))
    (0, b'abXY!')
    """
    start, end = min(a[0], b[0]), max(a[0] + len(a[1]), b[0] + len(b[1]))
    out = bytearray(end - start)
    out[a[0] - start : a[0] - start + len(a[1])] = a[1]
    out[b[0] - start : b[0] - start + len(b[1])] = b[1]
    return start, bytes(out)


def coalesced(ops: DataFrame, lane: str, limit: int = 64 << 20) -> DataFrame:
    """(lane, seq, ino, offset, data, ops): writes after joining; overlaps too.  A joined write stays under ``limit`` bytes.

    The rule looks at the group so far, so each lane's rows stream in order through one task that holds one group.
    """
    kind = dict(ops.dtypes)[lane]

    def run(batches):
        held = None

        def out(rows):
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [lane, "seq", "ino", "offset", "data", "ops"])

        for batch in batches:
            types = [batch.schema.field(lane).type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            done = []
            for who, seq, ino, offset, data in zip(*(batch.column(c).to_pylist() for c in (lane, "seq", "ino", "offset", "data")), strict=True):
                if held and held[0] == who and held[2] == ino and offset <= held[3] + len(held[4]) and held[3] <= offset + len(data) and len(held[4]) + len(data) <= limit:
                    start, both = merge((held[3], held[4]), (offset, data))
                    held = (who, held[1], ino, start, both, held[5] + 1)
                else:
                    if held:
                        done.append(held)
                    held = (who, seq, ino, offset, data, 1)
            yield out(done)
        if held:
            yield out([held])

    return ops.select(lane, "seq", "ino", "offset", "data").repartition(lane).sortWithinPartitions(lane, "seq").mapInArrow(run, f"{lane} {kind}, seq long, ino long, offset long, data binary, ops long")


def last_writer(ops: DataFrame, size: int) -> DataFrame:
    """(ino, block_idx, hash) of final blocks when every byte is the last write's, in ``seq`` order, over zeros."""
    from .blocks import padded, patched, write_blocks

    parts = write_blocks(ops, size).groupBy("ino", "block_idx").agg(F.array_sort(F.collect_list(F.struct("seq", "dst_start", "part"))).alias("parts"))
    return parts.select("ino", "block_idx", F.md5(F.aggregate("parts", padded(F.lit(b""), size), lambda acc, p: patched(acc, p["part"], p["dst_start"], size))).alias("hash"))


def set_locks(held: DataFrame, requests: DataFrame, bin_size: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(held, refused) after requests (ino, owner, start, end, typ), which don't overlap each other; typ is r, w or u (unlock).

    A request that conflicts with another owner's lock is refused.  Any other replaces its owner's locks that it overlaps.
    """
    touched = lambda df: df.withColumn("first", F.floor(F.col("start") / bin_size)).withColumn("bin", F.explode(F.sequence("first", F.floor(F.col("end") / bin_size))))
    h, q = touched(held).alias("h"), touched(requests).alias("q")
    meet = (F.col("h.ino") == F.col("q.ino")) & (F.col("h.bin") == F.col("q.bin")) & (F.col("h.start") <= F.col("q.end")) & (F.col("q.start") <= F.col("h.end"))
    other = (F.col("h.owner") != F.col("q.owner")) & (F.col("q.typ") != "u") & ((F.col("h.typ") == "w") | (F.col("q.typ") == "w"))
    key = ["ino", "owner", "start", "end", "typ"]
    refused = q.join(h, meet & other, "left_semi").select(*key).distinct()
    granted = requests.select(*key).join(refused, key, "left_anti")
    replaced = h.join(touched(granted).alias("q"), meet & (F.col("h.owner") == F.col("q.owner")), "left_semi").select(*key).distinct()
    return held.select(*key).join(replaced, key, "left_anti").unionByName(granted.where("typ <> 'u'")), refused


def conflicts(locks: DataFrame, bin_size: int = 1 << 20) -> DataFrame:
    """(ino, owner, other): pairs of locks of different owners on overlapping ranges of one inode, one at least for writing.

    Locks meet in the bins of their range only, and a pair in the first bin that both touch.
    """
    first, last = (F.floor(F.col(c) / bin_size) for c in ("start", "end"))
    binned = locks.withColumn("first", first).withColumn("bin", F.explode(F.sequence(first, last)))
    a, b = binned.alias("a"), binned.alias("b")
    same = (F.col("a.ino") == F.col("b.ino")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.bin") == F.greatest("a.first", "b.first"))
    on = same & (F.col("a.owner") < F.col("b.owner")) & (F.col("a.start") <= F.col("b.end")) & (F.col("b.start") <= F.col("a.end")) & ((F.col("a.typ") == "w") | (F.col("b.typ") == "w"))
    return a.join(b, on).select(F.col("a.ino").alias("ino"), F.col("a.owner").alias("owner"), F.col("b.owner").alias("other"))

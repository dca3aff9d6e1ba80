"""Reading files back from extents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_range(wanted: DataFrame, inodes: DataFrame, extents: DataFrame, payloads: DataFrame, size: int) -> DataFrame:
    """(ino, offset, data) of the requests (ino, offset, length): clipped to the file's size, holes are zeros.

    An extent whose chunk is missing fails the query.
    """
    own = wanted.join(inodes.select("ino", "size"), "ino").withColumn("stop", F.greatest(F.col("offset"), F.least(F.col("offset") + F.col("length"), F.col("size"))))
    rows = own.where("stop > offset").withColumn("block_idx", F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor((F.col("stop") - 1) / size))))
    rows = rows.join(extents.select("ino", "block_idx", "hash"), ["ino", "block_idx"], "left").join(payloads.select("hash", "data"), "hash", "left")
    block = F.when(F.col("hash").isNull(), F.rpad(F.lit(b""), size, F.lit(b"\0"))).when(F.col("data").isNull(), F.raise_error(F.concat(F.lit("no chunk "), F.col("hash")))).otherwise(F.col("data"))
    begin = F.greatest(F.col("offset") - F.col("block_idx") * size, F.lit(0))
    end = F.least(F.col("stop") - F.col("block_idx") * size, F.lit(size))
    part = F.substring(block, (begin + 1).cast("int"), (end - begin).cast("int"))
    parts = rows.groupBy("ino", "offset").agg(F.array_sort(F.collect_list(F.struct("block_idx", part.alias("part")))).alias("parts"))
    joined = parts.select("ino", "offset", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["part"])).alias("data"))
    empty = own.where("stop <= offset").select("ino", "offset", F.lit(b"").alias("data"))
    return joined.unionByName(empty)


def truncate(inodes: DataFrame, extents: DataFrame, data: DataFrame, new_size: DataFrame, size: int) -> DataFrame:
    """(ino, block_idx, old_hash, hash) of files cut to ``new_size`` (ino, new_size): hash is null where a block goes.

    A cut inside a block zeroes its tail; growing adds no blocks.  Blocks that stay as they are aren't listed.
    ``data`` has (hash, data).
    """
    cut = new_size.join(inodes.select("ino", "size"), "ino").where("new_size < size")
    rows = extents.join(cut, "ino").where(F.col("block_idx") >= F.floor(F.col("new_size") / size))
    keep = F.col("new_size") - F.col("block_idx") * size
    both = rows.join(data.select("hash", "data"), "hash", "left")
    new = F.when(keep > 0, F.md5(F.rpad(F.substring("data", F.lit(1), keep.cast("int")), size, F.lit(b"\0"))))
    return both.select("ino", "block_idx", F.col("hash").alias("old_hash"), new.alias("hash")).where("hash is null or hash <> old_hash")

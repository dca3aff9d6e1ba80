"""Open files: truncation on opening, and what goes when the last handle of an unlinked file is closed."""

from __future__ import annotations

import errno
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FLAG_READONLY, KIND_DIR, KIND_FILE
from .dml import Tables, problem, purge_closed, refuse


def opened(t: Tables, held: DataFrame, new: DataFrame) -> tuple[Tables, DataFrame]:
    """The namespace and the handles (fh, ino) after opening ``new`` (fh, ino, truncate).

    Directories, lost inodes and handles in use are refused; so is truncating what is read-only or no file.
    A truncated file keeps its inode, and its blocks' counts fall.
    """
    own = t.inodes.select("ino", F.col("kind").alias("__kind"), F.col("flags").alias("__flags"))
    at = new.select("fh", "ino", "truncate", F.col("ino").cast("string").alias("name")).join(own, "ino", "left")
    handles = new.select("fh", "ino").unionByName(held.select("fh", "ino"))
    twice = handles.groupBy("fh").agg(F.count("*").alias("n"), F.max("ino").cast("string").alias("name"))
    refuse(
        problem(at, F.col("__kind").isNull(), errno.ENOENT),
        problem(at, F.col("__kind") == KIND_DIR, errno.EISDIR),
        problem(at, F.col("truncate") & (F.col("__kind") != KIND_FILE), errno.EISDIR),
        problem(at, F.col("truncate") & (F.col("__flags").bitwiseAND(FLAG_READONLY) != 0), errno.EROFS),
        problem(twice, F.col("n") > 1, errno.EBADF),
    )
    cut = new.where("truncate").select("ino").distinct()
    gone = t.extents.join(cut, "ino", "left_semi").groupBy("hash").agg((-F.count("*")).alias("delta"))
    if t.deltas is not None:
        gone = t.deltas.unionByName(gone).groupBy("hash").agg(F.sum("delta").alias("delta"))
    sizes = t.inodes.join(cut.withColumn("__cut", F.lit(True)), "ino", "left").withColumn("size", F.when(F.col("__cut"), F.lit(0).cast("long")).otherwise(F.col("size")))
    extents = t.extents.join(cut, "ino", "left_anti").select(*t.extents.columns)
    return replace(t, inodes=sizes.select(*t.inodes.columns), extents=extents, deltas=gone), handles


def released(t: Tables, held: DataFrame, closed: DataFrame) -> tuple[Tables, DataFrame]:
    """The namespace and the handles after closing ``closed`` (fh): files without name or handle are removed."""
    refuse(problem(closed.join(held, "fh", "left_anti").withColumn("name", F.col("fh").cast("string")), F.lit(True), errno.EBADF))
    left = held.join(closed.select("fh"), "fh", "left_anti").select("fh", "ino")
    return purge_closed(t, left.select("ino").distinct()), left

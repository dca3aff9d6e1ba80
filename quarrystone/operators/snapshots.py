"""Snapshots: clone or delete a tree; blocks are shared, so only counts change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KIND_DIR
from .order import ranked


def clone_ids(reached: DataFrame, first: int) -> DataFrame:
    """(path, parent_path, name, ino, kind, new_ino): a new inode for each name, so hard links part; ids follow path order."""
    name = F.substring_index("path", "/", -1)
    cut = F.length("path") - F.length(name) - 1
    rows = reached.where("level > 0").select("path", F.substring("path", F.lit(1), cut).alias("parent_path"), name.alias("name"), "ino", "kind")
    return ranked(rows, ["path"], "k").withColumn("new_ino", F.col("k") + (first - 1)).drop("k")


def clone_dirents(ids: DataFrame, new_root: int) -> DataFrame:
    """(parent, name, ino, kind) of the copy below ``new_root``."""
    parents = ids.where(F.col("kind") == KIND_DIR).select(F.col("path").alias("parent_path"), F.col("new_ino").alias("parent"))
    return ids.join(parents, "parent_path", "left").select(F.coalesce("parent", F.lit(new_root)).alias("parent"), "name", F.col("new_ino").alias("ino"), "kind")


def clone_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Inodes, attributes, links or extents of the copy: the same rows under new ids."""
    return rows.join(ids.select("ino", "new_ino"), "ino").withColumn("ino", F.col("new_ino")).drop("new_ino").select(*rows.columns)


def added_refs(cloned_extents: DataFrame) -> DataFrame:
    return cloned_extents.groupBy("hash").agg(F.count("*").alias("delta"))


def without_tree(rows: DataFrame, reached: DataFrame) -> DataFrame:
    """Rows of inodes outside a deleted tree."""
    return rows.join(reached.select("ino").distinct(), "ino", "left_anti")


def names(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("name").orderBy("name")

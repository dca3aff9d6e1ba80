"""Directory trees: listing, paths, reachability, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import KIND_DIR, KIND_FILE
from ..shared import stored
from .order import ranked


def listing(dirents: DataFrame, inodes: DataFrame, parent: int, grand: int) -> DataFrame:
    """(pos, name, ino): `.` and `..`, then names in byte order; entries without an inode are dropped."""
    own = dirents.where(F.col("parent") == parent).join(inodes.select("ino"), "ino", "left_semi").select("name", "ino", F.lit(2).alias("rank"))
    spark = dirents.sparkSession
    dots = spark.createDataFrame([(".", parent, 0), ("..", grand, 1)], "name string, ino long, rank int")
    return ranked(dots.unionByName(own), ["rank", "name"], "pos").select((F.col("pos") - 1).alias("pos"), "name", "ino")


def descend(dirents: DataFrame, roots: DataFrame, max_levels: int | None = None) -> DataFrame:
    """(root, ino, kind, path, level) reachable from ``roots`` (root, ino), one join a level.

    A directory met again is not entered again, so cycles end; each level is kept in shared storage.
    """
    front = stored(roots.select("root", "ino", F.lit(KIND_DIR).alias("kind"), F.lit("").alias("path"), F.lit(0).alias("level")))
    seen, level = front, 0
    while max_levels is None or level < max_levels:
        level += 1
        step = front.where(F.col("kind") == KIND_DIR).select("root", F.col("ino").alias("parent"), "path").join(dirents, "parent")
        step = step.select("root", "ino", "kind", F.concat("path", F.lit("/"), "name").alias("path"), F.lit(level).alias("level"))
        known = seen.where(F.col("kind") == KIND_DIR).select("root", "ino", "kind")
        front = stored(step.join(known, ["root", "ino", "kind"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def below(dirents: DataFrame, root: int) -> DataFrame:
    """(ino, kind, path, level) below ``root``, by ``descend``: a recursive query stops at Spark's row and level limits."""
    roots = dirents.sparkSession.createDataFrame([(root, root)], "root long, ino long")
    return descend(dirents, roots).where("level > 0").select("ino", "kind", "path", "level")


def resolve(dirents: DataFrame, paths: DataFrame, root: int) -> DataFrame:
    """(path, ino) of absolute paths; ino is null if a part is missing.  `.` stays, `..` goes up.

    One join for each depth, up to that of the deepest path.
    """
    parts = F.filter(F.split("path", "/"), lambda p: (p != "") & (p != "."))
    walk = paths.select("path", parts.alias("parts"), F.lit(root).cast("bigint").alias("ino"))
    deepest = walk.agg(F.max(F.size("parts"))).first()[0] or 0
    step = dirents.select(F.col("parent").alias("__p"), F.col("name").alias("__n"), F.col("ino").alias("__child"))
    up = dirents.where(F.col("kind") == KIND_DIR).select(F.col("ino").alias("__d"), F.col("parent").alias("__up"))
    for k in range(deepest):
        want = F.when(F.size("parts") > k, F.col("parts")[k])
        walk = walk.withColumn("want", want).join(step, (F.col("ino") == F.col("__p")) & (F.col("want") == F.col("__n")), "left").join(up, F.col("ino") == F.col("__d"), "left")
        after = F.when(F.col("want").isNull(), F.col("ino")).when(F.col("want") == "..", F.coalesce("__up", F.lit(root))).otherwise(F.col("__child"))
        walk = walk.select("path", "parts", after.alias("ino"))
    return walk.select("path", "ino")


def logical_size(reached: DataFrame, inodes: DataFrame, scope: Column) -> DataFrame:
    """(scope, files, bytes): sizes of the distinct files reached in each scope; a hard link counts once."""
    files = reached.where(F.col("kind") == KIND_FILE).select(scope.alias("scope"), "ino").distinct()
    return files.join(inodes.where(F.col("kind") == KIND_FILE).select("ino", "size"), "ino").groupBy("scope").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def link_counts(dirents: DataFrame) -> DataFrame:
    """(ino, links): names of each inode."""
    return dirents.groupBy("ino").agg(F.count("*").alias("links"))


def directory_links(dirents: DataFrame) -> DataFrame:
    """(ino, nlink) of directories with entries: 2 and one for each subdirectory."""
    return dirents.groupBy(F.col("parent").alias("ino")).agg((F.count_if(F.col("kind") == KIND_DIR) + 2).alias("nlink"))


def attribute_names(xattrs: DataFrame) -> DataFrame:
    """(ino, names): sorted distinct names, joined by a zero character."""
    return xattrs.groupBy("ino").agg(F.array_join(F.array_sort(F.collect_set("name")), "\0").alias("names"))


def attribute_map(xattrs: DataFrame) -> DataFrame:
    """(ino, attrs): a map of each inode's attributes; later duplicates of a name don't occur."""
    return xattrs.groupBy("ino").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attrs"))

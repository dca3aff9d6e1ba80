"""Changes of the namespace: each takes the store's tables and returns their next version, or refuses.

What a change requires is checked by a query of its own before any table is returned, so nothing that a later
plan prunes can skip it.
"""

from __future__ import annotations

import errno
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FLAG_READONLY, FLAG_VAULT, KIND_DIR, KIND_SYMLINK
from ..functions.scalars import valid_name
from ..shared import stored


class Refused(OSError):
    """A change that the namespace doesn't allow; ``errno`` tells why."""


@dataclass(frozen=True)
class Tables:
    """One version of the namespace; ``deltas`` (hash, delta) are the changes of reference counts that go with it."""

    dirents: DataFrame
    inodes: DataFrame
    extents: DataFrame
    xattrs: DataFrame
    symlinks: DataFrame
    deltas: DataFrame | None = None

    def without_payload(self, dead: DataFrame) -> Tables:
        """Without the inodes (ino) in ``dead`` and all that belongs to them."""
        own = dead.select("ino").distinct()
        gone = self.extents.join(own, "ino", "left_semi").groupBy("hash").agg((-F.count("*")).alias("delta"))
        if self.deltas is not None:
            gone = self.deltas.unionByName(gone).groupBy("hash").agg(F.sum("delta").alias("delta"))
        keep = {n: getattr(self, n).join(own, "ino", "left_anti").select(*getattr(self, n).columns) for n in ("inodes", "extents", "xattrs", "symlinks")}
        return replace(self, **keep, deltas=gone)

    def stored(self) -> Tables:
        """This version written to shared storage, as one transaction leaves it for the next."""
        return Tables(*(stored(getattr(self, n), n) for n in ("dirents", "inodes", "extents", "xattrs", "symlinks")), self.deltas)

    def touched(self, parents: DataFrame, now: int) -> Tables:
        """With nlink changed by ``more`` (never below 0) and a new mtime for the inodes in ``parents`` (ino, more)."""
        more = parents.groupBy("ino").agg(F.sum("more").alias("__more"))
        both = self.inodes.join(more, "ino", "left")
        nlink = F.greatest(F.col("nlink") + F.coalesce("__more", F.lit(0)), F.lit(0)).cast("bigint")
        mtime = F.when(F.col("__more").isNotNull(), F.lit(now).cast("bigint")).otherwise(F.col("mtime"))
        return replace(self, inodes=both.withColumn("nlink", nlink).withColumn("mtime", mtime).select(*self.inodes.columns))


def refuse(*problems: DataFrame) -> None:
    """Raises the first of the problems (code, name), if there is any."""
    row = reduce(DataFrame.unionByName, problems).first()
    if row:
        raise Refused(row.code, errno.errorcode[row.code], row["name"])


def problem(rows: DataFrame, when: Column, code: int) -> DataFrame:
    return rows.where(when).select(F.lit(code).alias("code"), "name")


def found(names: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``names`` with the rows of a table that have their keys, or nulls.

    The table, which may look small enough to be broadcast, never goes through the driver: it is cut to the keys first (there
    only the keys can be broadcast), then merged.
    """
    return names.join(table.join(names.select(*keys), keys, "left_semi").hint("merge"), keys, "left")


def in_writable_folder(names: DataFrame, inodes: DataFrame) -> list[DataFrame]:
    """Problems of names (parent, name) whose parent is missing, no directory or read-only."""
    own = inodes.select(F.col("ino").alias("parent"), F.col("kind").alias("__kind"), F.col("flags").alias("__flags"))
    rows = found(names.select("parent", "name"), own, ["parent"])
    readonly = F.col("__flags").bitwiseAND(FLAG_READONLY) != 0
    return [problem(rows, F.col("__kind").isNull(), errno.ENOENT), problem(rows, F.col("__kind") != KIND_DIR, errno.ENOTDIR), problem(rows, readonly, errno.EROFS)]


def new_names(names: DataFrame, t: Tables) -> list[DataFrame]:
    """Problems of names (parent, name) that are to be added: bad ones, repeated ones, those that a live entry has."""
    live = t.dirents.join(names.select("parent", "name"), ["parent", "name"], "left_semi").join(t.inodes.select("ino").hint("merge"), "ino", "left_semi").select("parent", "name")
    repeated = names.groupBy("parent", "name").agg(F.count("*").alias("n"))
    return [
        problem(names, ~valid_name("name"), errno.EINVAL),
        problem(repeated, F.col("n") > 1, errno.EEXIST),
        problem(names.join(live.hint("merge"), ["parent", "name"], "left_semi"), F.lit(True), errno.EEXIST),
        *in_writable_folder(names, t.inodes),
    ]


def with_names(t: Tables, new: DataFrame) -> DataFrame:
    """Entries with the new ones; they replace entries of that name whose inode is lost."""
    return t.dirents.join(new.select("parent", "name"), ["parent", "name"], "left_anti").select(*t.dirents.columns).unionByName(new.select(*t.dirents.columns))


def targets(t: Tables, names: DataFrame) -> DataFrame:
    """Entries of names (parent, name) with their inode's kind, flags and nlink; all null where there is none."""
    entries = found(names.select("parent", "name").distinct(), t.dirents.select("parent", "name", "ino"), ["parent", "name"])
    return found(entries, t.inodes.select("ino", F.col("kind").alias("__kind"), F.col("flags").alias("__flags"), F.col("nlink").alias("__nlink")), ["ino"])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it lacks."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def create(t: Tables, new: DataFrame, now: int) -> Tables:
    """Adds (parent, name, ino, kind, perm, uid, gid).  A directory's parent gains a link and a new mtime; a vault's children belong to it."""
    inos = new.groupBy("ino").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    refuse(*new_names(new, t), problem(inos, F.col("n") > 1, errno.EEXIST), problem(new.join(t.inodes.select("ino").hint("merge"), "ino", "left_semi"), F.lit(True), errno.EEXIST))
    flags = t.inodes.select(F.col("ino").alias("parent"), F.col("flags").bitwiseAND(FLAG_VAULT).alias("flags")).join(new.select("parent"), "parent", "left_semi").hint("merge")
    links = F.when(F.col("kind") == KIND_DIR, 2).otherwise(1)
    made = new.join(flags, "parent").selectExpr("ino", "cast(kind as int) as kind", "cast(perm as int) as perm", "uid", "gid").withColumn("nlink", links.cast("bigint"))
    made = made.join(new.join(flags, "parent").select("ino", "flags"), "ino").withColumn("size", F.lit(0).cast("bigint")).withColumn("mtime", F.lit(now).cast("bigint"))
    folders = new.where(F.col("kind") == KIND_DIR).select(F.col("parent").alias("ino"), F.lit(1).alias("more"))
    out = replace(t, dirents=with_names(t, new)).touched(folders, now)
    return replace(out, inodes=out.inodes.unionByName(made.select(*t.inodes.columns)))


def symlink(t: Tables, new: DataFrame, now: int) -> Tables:
    """Adds (parent, name, ino, target); a link's size is its target's length in bytes."""
    shape = new.select("parent", "name", "ino", F.lit(KIND_SYMLINK).alias("kind"), F.lit(0o777).alias("perm"), F.lit(0).cast("bigint").alias("uid"), F.lit(0).cast("bigint").alias("gid"))
    out = create(t, shape, now)
    size = new.select("ino", F.octet_length("target").cast("bigint").alias("__size"))
    inodes = out.inodes.join(size, "ino", "left").withColumn("size", F.coalesce("__size", "size")).select(*t.inodes.columns)
    return replace(out, inodes=inodes, symlinks=t.symlinks.unionByName(new.select("ino", "target")))


def link(t: Tables, new: DataFrame) -> Tables:
    """Adds names (parent, name, ino) of files and symbolic links; directories are refused."""
    of = found(new, t.inodes.select("ino", F.col("kind").alias("__kind"), F.col("flags").alias("__flags")), ["ino"])
    bad = [problem(of, F.col("__kind").isNull(), errno.ENOENT), problem(of, F.col("__kind") == KIND_DIR, errno.EPERM), problem(of, F.col("__flags").bitwiseAND(FLAG_READONLY) != 0, errno.EROFS)]
    refuse(*new_names(new, t), *bad)
    more = new.groupBy("ino").agg(F.count("*").alias("__more"))
    inodes = t.inodes.join(more, "ino", "left").withColumn("nlink", F.col("nlink") + F.coalesce("__more", F.lit(0))).select(*t.inodes.columns)
    return replace(t, dirents=with_names(t, of.withColumn("kind", F.col("__kind"))), inodes=inodes)


def unlink(t: Tables, names: DataFrame, held_open: DataFrame | None = None) -> Tables:
    """Removes names (parent, name) of files; the last name takes the payload with it, unless the inode is in ``held_open`` (ino).

    An entry whose inode is lost just goes.
    """
    at = targets(t, names)
    readonly = F.col("__flags").bitwiseAND(FLAG_READONLY) != 0
    refuse(problem(at, F.col("ino").isNull(), errno.ENOENT), problem(at, F.col("__kind") == KIND_DIR, errno.EISDIR), problem(at, readonly, errno.EROFS), *in_writable_folder(names, t.inodes))
    fewer = at.groupBy("ino").agg(F.count("*").alias("__less"))
    left = t.inodes.join(fewer, "ino", "left").withColumn("nlink", F.greatest(F.col("nlink") - F.coalesce("__less", F.lit(0)), F.lit(0)))
    # from the few entries, as an inner join with all inodes might broadcast these
    dead = at.where("__kind is not null").groupBy("ino", "__nlink").agg(F.count("*").alias("__less")).where("greatest(__nlink - __less, 0) = 0").select("ino")
    if held_open is not None:
        dead = dead.join(held_open, "ino", "left_anti")
    dirents = t.dirents.join(names.select("parent", "name"), ["parent", "name"], "left_anti").select(*t.dirents.columns)
    return replace(t, dirents=dirents, inodes=left.select(*t.inodes.columns)).without_payload(dead)


def purge_closed(t: Tables, held_open: DataFrame | None = None) -> Tables:
    """Removes files without a name that nobody holds open any more."""
    dead = t.inodes.where((F.col("nlink") == 0) & (F.col("kind") != KIND_DIR)).select("ino")
    return t.without_payload(dead if held_open is None else dead.join(held_open, "ino", "left_anti"))


def children(t: Tables, folders: DataFrame) -> DataFrame:
    """(ino, __n) of those directories that hold entries with an inode; others don't count."""
    within = t.dirents.join(folders.select(F.col("ino").alias("parent")), "parent", "left_semi")
    live = within.join(t.inodes.select("ino").hint("merge"), "ino", "left_semi").select(F.col("parent").alias("ino"))
    return live.groupBy("ino").agg(F.count("*").alias("__n"))


def rmdir(t: Tables, names: DataFrame, now: int) -> Tables:
    """Removes empty directories (parent, name); entries in them whose inode is lost go too."""
    at = targets(t, names)
    full = at.join(children(t, at).hint("merge"), "ino", "left_semi")
    readonly = F.col("__flags").bitwiseAND(FLAG_READONLY) != 0
    refuse(problem(at, F.col("__kind").isNull(), errno.ENOENT), problem(at, F.col("__kind") != KIND_DIR, errno.ENOTDIR), problem(at, readonly, errno.EROFS), problem(full, F.lit(True), errno.ENOTEMPTY), *in_writable_folder(names, t.inodes))
    dirents = t.dirents.join(names.select("parent", "name"), ["parent", "name"], "left_anti").join(at.select(F.col("ino").alias("parent")), "parent", "left_anti")
    parents = at.select(F.col("parent").alias("ino"), F.lit(-1).alias("more"))
    return replace(t, dirents=dirents.select(*t.dirents.columns)).touched(parents, now).without_payload(at)


def _one(t: Tables, place: tuple[int, str]):
    """The entry at (parent, name) with its inode's kind, flags and nlink, or None."""
    here = F.broadcast(t.dirents.where((F.col("parent") == place[0]) & (F.col("name") == place[1])).select("parent", "name", "kind"))
    row = targets(t, here).first()
    if row is not None and row["__kind"] is None:
        raise Refused(errno.ENOENT, "the inode is lost", place[1])
    if row is not None and row["__flags"] & FLAG_READONLY:
        raise Refused(errno.EROFS, "read-only", place[1])
    return row


def _moved(t: Tables, to: dict[tuple[int, str], tuple[int, str]]) -> DataFrame:
    """Entries of which those at the keys of ``to`` have new places."""
    parent, name = F.col("parent"), F.col("name")
    for (p, n), (q, m) in to.items():
        here = (F.col("parent") == p) & (F.col("name") == n)
        parent, name = F.when(here, q).otherwise(parent), F.when(here, F.lit(m)).otherwise(name)
    return t.dirents.select(parent.cast("bigint").alias("parent"), name.alias("name"), "ino", "kind")


def _places(t: Tables, *places: tuple[int, str]) -> DataFrame:
    names = F.broadcast(t.dirents.sparkSession.createDataFrame([*places], "parent long, name string"))
    refuse(problem(names, ~valid_name("name"), errno.EINVAL), *in_writable_folder(names, t.inodes))
    return names


def rename(t: Tables, source: tuple[int, str], target: tuple[int, str], now: int, overwrite: bool = True) -> Tables:
    """Moves a name.  An existing target loses that name, and its payload with its last one; without ``overwrite`` it is refused.

    A directory may only replace an empty directory, anything else only what isn't one.
    """
    _places(t, source, target)
    if source == target:
        return t
    old, new = _one(t, source), _one(t, target)
    if old is None:
        raise Refused(errno.ENOENT, "no such name", source[1])
    folder = old["__kind"] == KIND_DIR
    spark = t.dirents.sparkSession
    parents = {source[0]: 0, target[0]: 0}
    if new is not None:
        if not overwrite:
            raise Refused(errno.EEXIST, "the target exists", target[1])
        if new.ino == old.ino:
            return t
        if folder != (new["__kind"] == KIND_DIR):
            raise Refused(errno.ENOTDIR if folder else errno.EISDIR, "the target is of another kind", target[1])
        at = F.broadcast(spark.createDataFrame([(*target, new.ino)], "parent long, name string, ino long"))
        if folder:
            t = rmdir(t, at, now)
        else:
            t = unlink(t, at)
    if folder and source[0] != target[0]:
        parents = {source[0]: -1, target[0]: 1}
    return replace(t, dirents=_moved(t, {source: target})).touched(spark.createDataFrame([*parents.items()], "ino long, more long"), now)


def exchange(t: Tables, a: tuple[int, str], b: tuple[int, str], now: int) -> Tables:
    """Two names swap their inodes."""
    _places(t, a, b)
    for place in (a, b):
        if _one(t, place) is None:
            raise Refused(errno.ENOENT, "no such name", place[1])
    parents = t.dirents.sparkSession.createDataFrame([(p, 0) for p in {a[0], b[0]}], "ino long, more long")
    return replace(t, dirents=_moved(t, {a: b, b: a})).touched(parents, now)


def set_attributes(inodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Inodes with what ``changes`` (ino, perm, uid, gid, mtime) has not null."""
    new = changes.select("ino", *(F.col(c).alias(f"__{c}") for c in ("perm", "uid", "gid", "mtime")))
    out = inodes.join(new, "ino", "left")
    for c in ("perm", "uid", "gid", "mtime"):
        out = out.withColumn(c, F.coalesce(f"__{c}", c))
    return out.select(*inodes.columns)


def set_xattr(xattrs: DataFrame, new: DataFrame, mode: str = "any") -> DataFrame:
    """Attributes with (ino, name, value) set; mode ``create`` fails where one exists, ``replace`` where none does."""
    old = xattrs.select("ino", "name", F.lit(True).alias("__old"))
    rows = found(new, old, ["ino", "name"])
    bad = F.col("__old").isNotNull() if mode == "create" else F.col("__old").isNull() if mode == "replace" else F.lit(False)
    rows = rows.withColumn("value", F.when(bad, F.raise_error(F.concat(F.lit(f"{mode}: "), F.col("name")))).otherwise(F.col("value")))
    return upsert(xattrs, rows.select("ino", "name", "value"), ["ino", "name"])


def remove_xattr(xattrs: DataFrame, names: DataFrame) -> DataFrame:
    return xattrs.join(names.select("ino", "name"), ["ino", "name"], "left_anti")

"""A session over one store: snapshots, the vault and the report, as the control protocol calls them."""

from __future__ import annotations

import errno
import time
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FLAG_READONLY, KIND_DIR, ROOT_INO, SNAPSHOTS_INO
from ..functions.scalars import valid_name
from ..operators import dml, namespace, snapshots, vault
from ..shared import stored
from . import stats


class Session:
    """Holds the current version of the tables; each change is stored before it becomes current.

    What is lost stays lost: entries without an inode aren't cloned, and counts change for known chunks only.
    The report's sizes take each file that has a name outside the snapshots as live, any other as theirs.
    """

    def __init__(self, tables: dml.Tables, chunks: DataFrame, known: DataFrame, clock: Callable[[], float] = time.time):
        self.spark, self.tables, self.chunks, self.known, self.clock = tables.dirents.sparkSession, tables, chunks, known, clock
        self.vault: vault.Vault | None = None
        # inode numbers aren't used again, nor are those that only lost inodes' rows still hold
        used = [getattr(tables, n).agg(F.max("ino").alias("ino")) for n in ("inodes", "dirents", "extents", "xattrs", "symlinks")]
        self.next_ino = max(r.ino or 0 for r in reduce(DataFrame.unionByName, used).collect()) + 1

    def operations(self) -> dict[str, Callable]:
        names = ("snapshot_create", "snapshot_list", "snapshot_delete", "vault_create", "vault_unlock", "vault_lock", "stats")
        return {n: getattr(self, n) for n in names}

    def _commit(self, t: dml.Tables, known: DataFrame | None = None) -> None:
        deltas = t.deltas
        if deltas is not None:
            both = self.chunks.join(deltas, "hash", "left")
            counts = both.withColumn("refcount", F.greatest(F.col("refcount") + F.coalesce("delta", F.lit(0)), F.lit(0)))
            self.chunks = stored(counts.select(*self.chunks.columns), "chunks")
        self.tables = replace(t.stored(), deltas=None)
        if known is not None:
            self.known = stored(known, "snapshots")

    def _entry(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([(SNAPSHOTS_INO, name)], "parent long, name string")

    def snapshot_list(self) -> list[str]:
        """Names in byte order; snapshots are made by hand or by a schedule, so there are few."""
        return [r.name for r in snapshots.names(self.known).collect()]

    def snapshot_create(self, name: str) -> None:
        """A copy of everything but the snapshots, read-only, under the folder of snapshots; blocks are shared."""
        t, new = self.tables, self._entry(name)
        folder = t.inodes.where((F.col("ino") == SNAPSHOTS_INO) & (F.col("kind") == KIND_DIR))
        if folder.isEmpty():
            raise dml.Refused(errno.ENOENT, "there is no folder of snapshots")
        taken = new.join(self.known.select("name").unionByName(t.dirents.where(F.col("parent") == SNAPSHOTS_INO).select("name")), "name", "left_semi")
        dml.refuse(dml.problem(new, ~valid_name("name"), errno.EINVAL), dml.problem(taken, F.lit(True), errno.EEXIST))
        root = self.next_ino
        live = t.dirents.where((F.col("parent") != ROOT_INO) | (F.col("ino") != SNAPSHOTS_INO)).join(t.inodes.select("ino"), "ino", "left_semi")
        ids = stored(snapshots.clone_ids(namespace.below(live, ROOT_INO), root + 1))
        self.next_ino += 1 + ids.count()
        copied = lambda rows: rows.unionByName(snapshots.clone_rows(rows, ids))
        readonly = F.col("flags").bitwiseOR(F.lit(FLAG_READONLY)).alias("flags")
        frozen = lambda rows: rows.select(*(readonly if c == "flags" else c for c in t.inodes.columns))
        top = t.inodes.where(F.col("ino") == ROOT_INO).withColumn("ino", F.lit(root).cast("long"))
        entry = self.spark.createDataFrame([(SNAPSHOTS_INO, name, root, KIND_DIR)], "parent long, name string, ino long, kind int")
        extents = snapshots.clone_rows(t.extents, ids)
        done = dml.Tables(
            t.dirents.unionByName(snapshots.clone_dirents(ids, root).select(*t.dirents.columns)).unionByName(entry),
            t.inodes.unionByName(frozen(snapshots.clone_rows(t.inodes, ids))).unionByName(frozen(top)),
            t.extents.unionByName(extents),
            copied(t.xattrs),
            copied(t.symlinks),
            snapshots.added_refs(extents),
        )
        record = self.spark.createDataFrame([(name, root, int(self.clock()))], "name string, root_ino long, created long")
        self._commit(done, self.known.unionByName(record))

    def snapshot_delete(self, name: str) -> None:
        t, old = self.tables, self._entry(name)
        dml.refuse(dml.problem(old, ~valid_name("name"), errno.EINVAL), dml.problem(old.join(t.dirents, ["parent", "name"], "left_anti"), F.lit(True), errno.ENOENT))
        entry = t.dirents.join(old, ["parent", "name"], "left_semi").select("ino").first().ino
        tree = stored(namespace.below(t.dirents, entry).select("ino", "kind").union(self.spark.createDataFrame([(entry, KIND_DIR)], "ino long, kind int")))
        folders = tree.where(F.col("kind") == KIND_DIR).select(F.col("ino").alias("parent"))
        dirents = t.dirents.join(folders, "parent", "left_anti").join(old, ["parent", "name"], "left_anti").select(*t.dirents.columns)
        self._commit(replace(t, dirents=dirents).without_payload(tree), self.known.where(F.col("name") != name))

    def vault_create(self, password: str, key_path: str | None = None) -> str:
        """Makes the vault's folder and a key file, which must not exist yet; the path of the key file."""
        path = Path(key_path or "vault.key").absolute()
        if path.exists():
            raise FileExistsError(errno.EEXIST, "the key file exists", str(path))
        ino, self.next_ino = self.next_ino, self.next_ino + 1
        done, own, material = vault.create(self.tables, ino, password, int(self.clock()))
        path.touch(mode=0o600)
        path.write_bytes(material)
        self._commit(done)
        self.vault = own
        return str(path)

    def _vault(self) -> vault.Vault:
        if self.vault is None:
            raise dml.Refused(errno.ENOENT, "there is no vault")
        return self.vault

    def vault_unlock(self, password: str, key_file: str) -> None:
        self.vault = self._vault().unlock(self.spark, password, Path(key_file).read_bytes())

    def vault_lock(self) -> None:
        self.vault = self._vault().lock()

    def stats(self) -> str:
        """The report's lines: metric and value."""
        t = self.tables
        outside = t.dirents.where((F.col("parent") != ROOT_INO) | (F.col("ino") != SNAPSHOTS_INO))
        live = namespace.below(outside, ROOT_INO).select("ino").distinct()
        files = t.inodes.where(F.col("kind") == 1).join(live.withColumn("live", F.lit(True)), "ino", "left")
        sizes = files.groupBy(F.when(F.col("live"), "live").otherwise("snapshots").alias("scope")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
        rows = stats.report(stats.collect_stats(t.inodes, t.extents, self.chunks, sizes)).orderBy("position").collect()
        return "\n".join(f"{r.metric}: {r.readable}" for r in rows)

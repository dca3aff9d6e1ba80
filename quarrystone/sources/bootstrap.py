"""An empty store: the root, the folder of snapshots, and the system counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import KIND_DIR, PACK_FOLDERS, ROOT_INO, SNAPSHOTS_INO, Settings

INODES = "ino long, kind int, perm int, uid long, gid long, nlink long, size long, mtime long, flags int"
DIRENTS = "parent long, name string, ino long, kind int"
EXTENTS = "ino long, block_idx long, hash string"
CHUNKS = "hash string, refcount long, pack_id int, codec int, ulen long, clen long"
XATTRS = "ino long, name string, value string"
SYMLINKS = "ino long, target string"
SNAPSHOTS = "name string, root_ino long, created long"
DISCARDS = "epoch long, pack_id int, hash string, bytes long"


def bootstrap(spark: SparkSession, now: int, settings: Settings | None = None) -> dict[str, DataFrame]:
    """Every table of a new store."""
    own = settings or Settings()
    empty = {n: spark.createDataFrame([], s) for n, s in {"extents": EXTENTS, "chunks": CHUNKS, "xattrs": XATTRS, "symlinks": SYMLINKS, "snapshots": SNAPSHOTS, "discards": DISCARDS}.items()}
    inodes = [(ROOT_INO, KIND_DIR, 0o755, 0, 0, 3, 0, now, 0), (SNAPSHOTS_INO, KIND_DIR, 0o755, 0, 0, 2, 0, now, 1)]
    counters = [("next_inode", 16), ("active_pack_id", 1), ("gc.epoch", 0), ("pack_max_size_mb", own.pack_max_size_mb), ("pack_folders", len(PACK_FOLDERS))]
    return empty | {
        "inodes": spark.createDataFrame(inodes, INODES),
        "dirents": spark.createDataFrame([(ROOT_INO, ".snapshots", SNAPSHOTS_INO, KIND_DIR)], DIRENTS),
        "sys": spark.createDataFrame(counters, "name string, value long"),
    }

"""Permissions of the folder that holds a store's files."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Modes of folders and files.
DIR_MODE, FILE_MODE = 0o770, 0o660


def normalize_tree(spark: SparkSession, root: str) -> list[tuple[str, bool, int]]:
    """Sets the modes of a folder and all below it; (path below the root, is a folder, mode) of each.

    Symbolic links keep theirs, a missing root has nothing.  One call for each file: packs are few and large.
    """
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(top):
        return []
    mode = jvm.org.apache.hadoop.fs.permission.FsPermission
    out, waiting = [], [files.getFileStatus(top)]  # the root may be a link, what is below it is taken as it is
    base = waiting[0].getPath().toUri().getPath().rstrip("/")
    while waiting:
        at = waiting.pop()
        if at.isSymlink():
            continue
        want = DIR_MODE if at.isDirectory() else FILE_MODE
        files.setPermission(at.getPath(), mode(f"{want:o}"))
        if at.isDirectory():
            # paths without a scheme, as the local file system tells links by these only
            waiting.extend(files.getFileLinkStatus(jvm.org.apache.hadoop.fs.Path(f.getPath().toUri().getPath())) for f in files.listStatus(at.getPath()))
        got = int(files.getFileStatus(at.getPath()).getPermission().toShort())
        out.append((at.getPath().toUri().getPath()[len(base) + 1 :], at.isDirectory(), got))
    return sorted(out)

"""Scalar expressions over store columns; all are built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FLAG_READONLY, FLAG_VAULT, KIND_DIR, KIND_FILE, KIND_SYMLINK, PACK_FOLDERS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def human_bytes(n: Column | str) -> Column:
    """1024-based size with two decimals, from B to PiB."""
    n = col(n).cast("double")

    def text(x: Column, unit: str) -> Column:
        # to the nearest even of what the binary fraction holds, as C and Rust print; %.2f of the JVM rounds half up
        return F.concat(F.bround(x.cast("decimal(38,20)"), 2).cast("string"), F.lit(f" {unit}"))

    out = text(n / 1024.0**5, "PiB")
    for k, unit in reversed([*enumerate(("B", "KiB", "MiB", "GiB", "TiB"))]):
        out = F.when(n < 1024.0 ** (k + 1), text(n / 1024.0**k, unit)).otherwise(out)
    return out


def human_bytes_signed(n: Column | str) -> Column:
    n = col(n)
    return F.when(n < 0, F.concat(F.lit("-"), human_bytes(-n))).otherwise(human_bytes(n))


def pack_path(pack_id: Column | str, suffix: str = "vpk") -> Column:
    """Folder by id modulo six, id padded to 20 digits."""
    i = col(pack_id)
    return F.format_string(f"%s/pack-%020d.{suffix}", F.element_at(F.array(*map(F.lit, PACK_FOLDERS)), (i % len(PACK_FOLDERS) + 1).cast("int")), i)


def pack_id_of(name: Column | str) -> Column:
    """Id in a pack or index file's name; null for other names."""
    return F.regexp_extract(col(name), r"^(?:.*/)?pack-([0-9]+)\.(?:vpk|idx)$", 1).try_cast("bigint")


def blocks_512(size: Column | str) -> Column:
    return F.ceil(col(size) / 512)


def file_type(kind: Column | str) -> Column:
    """Unknown kinds count as files."""
    k = col(kind)
    return F.when(k == KIND_DIR, "directory").when(k == KIND_SYMLINK, "symlink").otherwise("file")


def mode_flag(kind: Column | str) -> Column:
    """File-type bits of a mode."""
    k = col(kind)
    return F.when(k == KIND_DIR, 0o040000).when(k == KIND_SYMLINK, 0o120000).otherwise(0o100000)


def split_time(ts: Column | str) -> tuple[Column, Column]:
    """(seconds, nanoseconds); before the epoch seconds are negated and nanoseconds stay positive."""
    us = F.unix_micros(col(ts).cast("timestamp"))
    sign = F.when(us < 0, -1).otherwise(1)
    return (sign * F.floor(F.abs(us) / 1_000_000)).cast("bigint"), (F.abs(us) % 1_000_000 * 1000).cast("bigint")


def join_time(sec: Column | str, nsec: Column | str) -> Column:
    """The inverse of split_time, but for the last second before the epoch, whose sign is lost."""
    s, n = col(sec), F.floor(col(nsec) / 1000)
    return F.timestamp_micros(F.when(s < 0, s * 1_000_000 - n).otherwise(s * 1_000_000 + n).cast("bigint"))


def valid_name(name: Column | str) -> Column:
    """Neither empty nor `.` nor `..`, and without a slash."""
    n = col(name)
    return F.coalesce((n != "") & ~n.isin(".", "..") & ~n.contains("/"), F.lit(False))


def overlap(a_start, a_end, b_start, b_end) -> Column:
    """Closed ranges that share a point."""
    return (col(a_start) <= col(b_end)) & (col(b_start) <= col(a_end))


def access_granted(uid: int, gid: int, groups: tuple[int, ...], need: int) -> Column:
    """Whether a caller may use an inode (perm, uid, gid, kind) so.

    Root may read and write all, and execute what anyone may execute or a directory.
    The others' triplet is the owner's, else the group's (supplementary ones too), else the last.
    """
    perm = F.col("perm")
    if uid == 0:
        return (F.lit(need & 1 == 0)) | (F.col("kind") == KIND_DIR) | (perm.bitwiseAND(0o111) != 0)
    triplet = F.when(F.col("uid") == uid, F.shiftright(perm, 6)).when(F.col("gid").isin(gid, *groups), F.shiftright(perm, 3)).otherwise(perm)
    return triplet.bitwiseAND(need) == need


def writable() -> Column:
    return F.col("flags").bitwiseAND(FLAG_READONLY) == 0


def visible(unlocked: bool) -> Column:
    """Vault inodes can't be seen while the vault is locked."""
    return F.lit(True) if unlocked else F.col("flags").bitwiseAND(FLAG_VAULT) == 0


def big_endian(n: Column | str) -> Column:
    """A non-negative long as eight bytes, in hexadecimal."""
    return F.lpad(F.hex(col(n)), 16, "0")


def extent_key(ino: Column | str, block_idx: Column | str) -> Column:
    """Key of an extent in the ordered store, in hexadecimal: E, inode, block."""
    return F.concat(F.lit("45"), big_endian(ino), big_endian(block_idx))


def dirent_key(parent: Column | str, name: Column | str) -> Column:
    """D, parent, a zero byte, name."""
    return F.concat(F.lit("44"), big_endian(parent), F.lit("00"), F.hex(F.encode(col(name), "UTF-8")))


def from_hex_long(h: Column) -> Column:
    return F.conv(h, 16, 10).cast("bigint")


def extent_of_key(key: Column | str) -> tuple[Column, Column]:
    """(inode, block) of an extent key; null for keys of another kind or length."""
    k = col(key)
    ok = (F.length(k) == 34) & k.startswith("45")
    return F.when(ok, from_hex_long(F.substring(k, 3, 16))), F.when(ok, from_hex_long(F.substring(k, 19, 16)))


def name_of_dirent_key(key: Column | str) -> Column:
    k = col(key)
    return F.when((F.length(k) > 20) & k.startswith("44"), F.decode(F.unhex(F.substring(k, F.lit(21), F.length(k))), "UTF-8"))


def snapshot_name_of_key(key: Column | str) -> Column:
    """Name in a key S:name; other keys, SYS: among them, have none."""
    k = col(key)
    return F.when(k.startswith("S:"), F.substring(k, F.lit(3), F.length(k)))


def prefix_end(prefix: str) -> str | None:
    """Exclusive upper bound, in hexadecimal, of keys with this hexadecimal prefix; None if there is none."""
    raw = bytearray.fromhex(prefix)
    while raw and raw[-1] == 0xFF:
        raw.pop()
    if not raw:
        return None
    raw[-1] += 1
    return raw.hex().upper()


def parse_kib(line: Column | str) -> Column:
    """Bytes of a line `Key: n kB`."""
    return F.regexp_extract(col(line), r"^\w+:\s+([0-9]+) kB$", 1).try_cast("bigint") * 1024


def is_kind_file() -> Column:
    return F.col("kind") == KIND_FILE

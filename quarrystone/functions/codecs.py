"""Content hashes, compression and checksums that Spark lacks, as Arrow-batched UDFs."""

from __future__ import annotations

import struct
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import VAULT_DOMAIN

RAW, ZSTD = 0, 1


def hash128_bytes(data: bytes | pa.Buffer, domain: int | None = None) -> bytes:
    """XXH3-128 as 16 little-endian bytes; a domain byte goes before the data."""
    import xxhash

    if domain is None:
        return xxhash.xxh3_128_intdigest(data).to_bytes(16, "little")
    own = xxhash.xxh3_128(bytes([domain]))
    own.update(data)
    return own.intdigest().to_bytes(16, "little")


@F.arrow_udf(T.BinaryType())
def _hash128(data: pa.Array, domain: pa.Array) -> pa.Array:
    """Hashes the data where Arrow holds them; hashes of one column in several domains get it once."""
    return pa.array([None if b.as_buffer() is None else hash128_bytes(b.as_buffer(), d) for b, d in zip(data, domain.to_pylist(), strict=True)], pa.binary())


def hash128(data: Column) -> Column:
    return _hash128(data, F.lit(None).cast("int"))


def hash128_with_domain(data: Column, domain: int) -> Column:
    return _hash128(data, F.lit(domain))


def hash_for(data: Column, is_vault: Column) -> Column:
    """Vault content never shares a hash with other content."""
    return _hash128(data, F.when(is_vault, F.lit(VAULT_DOMAIN)))


@cache
def crc32c_tables() -> np.ndarray:
    """Slicing tables of the Castagnoli polynomial (reflected 0x82F63B78), from its rule."""
    t = np.zeros((8, 256), np.uint32)
    for n in range(256):
        c = n
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        t[0, n] = c
    for k in range(1, 8):
        t[k] = (t[k - 1] >> np.uint32(8)) ^ t[0, t[k - 1] & np.uint32(255)]
    return t


def crc32c_many(items: list[bytes]) -> np.ndarray:
    """CRC-32C of many buffers at once: a byte of each still unfinished one at every step, longest first."""
    n = np.array([len(x) for x in items], np.int64)
    order = np.argsort(-n, kind="stable")
    flat = np.frombuffer(b"".join(items) or b"\0", np.uint8)
    start = np.concatenate([[0], np.cumsum(n)])[:-1][order]
    left, table = n[order], crc32c_tables()[0]
    crc = np.full(len(items), 0xFFFFFFFF, np.uint32)
    live = len(items)
    for k in range(int(n.max(initial=0))):
        live = int(np.searchsorted(-left[:live], -k, "left")) if live else 0
        c = crc[:live]
        crc[:live] = table[(c ^ flat[start[:live] + k]) & np.uint32(255)] ^ (c >> np.uint32(8))
    out = np.empty(len(items), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    return pd.Series(crc32c_many([b or b"" for b in data]).astype(np.int64))


def compress(level: int = 3):
    """A UDF: {codec, ulen, clen, payload}; zstd only where it is strictly smaller."""

    @F.pandas_udf("codec int, ulen bigint, clen bigint, payload binary")
    def run(data: pd.Series) -> pd.DataFrame:
        import zstandard

        z = zstandard.ZstdCompressor(level=level)
        rows = []
        for b in data:
            small = z.compress(b)
            codec, payload = (ZSTD, small) if len(small) < len(b) else (RAW, b)
            rows.append((codec, len(b), len(payload), payload))
        return pd.DataFrame(rows, columns=["codec", "ulen", "clen", "payload"])

    return run


@F.pandas_udf(T.BinaryType())
def decompress(codec: pd.Series, ulen: pd.Series, payload: pd.Series) -> pd.Series:
    """The data of a payload; an unknown codec or another length than told is an error."""
    import zstandard

    z = zstandard.ZstdDecompressor()

    def one(c: int, n: int, p: bytes) -> bytes:
        if c not in (RAW, ZSTD):
            raise ValueError(f"unknown codec {c}")
        out = p if c == RAW else z.decompress(p, max_output_size=n)
        if len(out) != n:
            raise ValueError(f"{len(out)} bytes where {n} are told")
        return out

    return pd.Series([one(*x) for x in zip(codec, ulen, payload, strict=True)])


#: Length, version and flags; epoch, pack, hash, bytes, reserved (little-endian); CRC-32C of that second part.
DISCARD_HEAD, DISCARD_BODY, DISCARD_CRC = struct.Struct("<HBB"), struct.Struct("<QQ16sII"), struct.Struct("<I")
DISCARD_LENGTH, DISCARD_VERSION = 48, 1


def encode_discards(epochs: list[int], packs: list[int], digests: list[bytes], sizes: list[int]) -> list[bytes]:
    """Records of 48 bytes."""
    bodies = [DISCARD_BODY.pack(e, p, d, n, 0) for e, p, d, n in zip(epochs, packs, digests, sizes, strict=True)]
    head = DISCARD_HEAD.pack(DISCARD_LENGTH, DISCARD_VERSION, 0)
    return [head + b + DISCARD_CRC.pack(c) for b, c in zip(bodies, crc32c_many(bodies).tolist(), strict=True)]


def decode_discards(raws: list[bytes]) -> list[tuple[int, int, bytes, int] | None]:
    """(epoch, pack, hash, bytes) of each record, or None if its length, version or checksum is wrong."""
    whole = [r if r is not None and len(r) == DISCARD_LENGTH else bytes(DISCARD_LENGTH) for r in raws]
    out = []
    for raw, crc in zip(whole, crc32c_many([r[4:44] for r in whole]).tolist(), strict=True):
        length, version, _ = DISCARD_HEAD.unpack_from(raw)
        ok = length == DISCARD_LENGTH and version == DISCARD_VERSION and DISCARD_CRC.unpack_from(raw, 44)[0] == crc
        out.append(DISCARD_BODY.unpack_from(raw, 4)[:4] if ok else None)
    return out


@F.pandas_udf(T.BinaryType())
def discard_record(epoch: pd.Series, pack_id: pd.Series, digest: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series(encode_discards(epoch.tolist(), pack_id.tolist(), digest.tolist(), size.tolist()), dtype=object)


@F.pandas_udf(T.StructType([T.StructField("epoch", T.LongType()), T.StructField("pack_id", T.LongType()), T.StructField("hash", T.BinaryType()), T.StructField("bytes", T.LongType())]))
def discard_fields(raw: pd.Series) -> pd.DataFrame:
    """The fields of each record; all null where it isn't valid."""
    rows = [x or (None,) * 4 for x in decode_discards(raw.tolist())]
    found = pd.DataFrame(rows, columns=["epoch", "pack_id", "hash", "bytes"], dtype=object)
    return found.astype({"epoch": "Int64", "pack_id": "Int64", "bytes": "Int64"})

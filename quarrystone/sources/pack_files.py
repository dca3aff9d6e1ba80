"""Pack files: records of a 32-byte header and a payload, one after the other.

Files are written by one task a pack, listed by Spark's binaryFile source and read in parts.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PACK_FOLDERS, PACK_MAGIC
from ..functions import scalars
from ..functions.codecs import crc32c_many
from ..operators.packs import last_entries

#: Magic, hash, codec, three zero bytes, uncompressed and compressed length (little-endian).
HEADER, HEADER_SIZE = "<4s16sB3xII", 32


def pack_name(pack_id: int) -> str:
    return f"{PACK_FOLDERS[pack_id % len(PACK_FOLDERS)]}/pack-{pack_id:020d}.vpk"


def encode_header(digest: bytes, codec: int, ulen: int, clen: int, magic: bytes = PACK_MAGIC) -> bytes:
    return struct.pack(HEADER, magic, digest, codec, ulen, clen)


def write_packs(records: DataFrame, root: str) -> DataFrame:
    """(pack_id, length) of the files written from records (pack_id, seq, magic, hash, codec, ulen, payload), in the order of seq.

    A pack's rows stream through one task into a file of another name, which is renamed when complete; hashes are hexadecimal.
    """

    def run(batches):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        files.create_dir(base)
        pack, out, size = None, None, 0

        def closed():
            out.close()
            files.move(f"{base}/{pack_name(pack)}.part", f"{base}/{pack_name(pack)}")
            return pa.RecordBatch.from_pydict({"pack_id": pa.array([pack], pa.int64()), "length": pa.array([size], pa.int64())})

        for batch in batches:
            for p, magic, h, codec, ulen, payload in zip(*(batch.column(c).to_pylist() for c in ("pack_id", "magic", "hash", "codec", "ulen", "payload")), strict=True):
                if p != pack:
                    if out:
                        yield closed()
                    pack, size = p, 0
                    files.create_dir(f"{base}/{pack_name(p).split('/')[0]}")
                    out = files.open_output_stream(f"{base}/{pack_name(p)}.part")
                size += out.write(encode_header(bytes.fromhex(h), codec, ulen, len(payload), magic) + payload)
        if out:
            yield closed()

    rows = records.select("pack_id", "seq", "magic", "hash", "codec", "ulen", "payload")
    return rows.repartition("pack_id").sortWithinPartitions("pack_id", "seq").mapInArrow(run, "pack_id long, length long")


HEADERS = "pack_id long, offset long, magic binary, hash string, codec int, ulen long, clen long"

#: Bytes that are read from a file at once (more only for a longer payload), bytes of payloads and rows of an Arrow batch.
READ_BYTES, BATCH_BYTES, BATCH_ROWS = 4 << 20, 4 << 20, 10_000


def walk(file, size: int, payloads: bool):
    """(offset, magic, hash, codec, ulen, clen, payload or None) of a pack file's records, one after the other; holds one part of the file."""
    raw, start, at = memoryview(b""), 0, 0

    def part(n: int) -> memoryview:
        nonlocal raw, start
        if at < start or at + n > start + len(raw):
            raw, start = memoryview(file.read_at(min(max(n, READ_BYTES), size - at), at)), at
        return raw[at - start : at - start + n]

    while at + HEADER_SIZE <= size:
        magic, digest, codec, ulen, clen = struct.unpack(HEADER, part(HEADER_SIZE))
        if at + HEADER_SIZE + clen > size:
            break
        yield at, magic, digest.hex(), codec, ulen, clen, bytes(part(HEADER_SIZE + clen)[HEADER_SIZE:]) if payloads else None
        if magic != PACK_MAGIC:
            break
        at += HEADER_SIZE + clen


def _scanned(spark: SparkSession, root: str, last: tuple[str, pa.DataType, Callable[[list[bytes]], list]] | None) -> DataFrame:
    """The headers of all records; ``last`` (name, type, function) is a column made from a batch's payloads, which else aren't read.

    Spark lists the files, and one task streams through each, so neither the JVM nor Python holds a file.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "pack-*.vpk").option("recursiveFileLookup", True).load(root)
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    names = [c.split(" ")[0] for c in HEADERS.split(", ")]

    def batch_of(pack_id: int, rows: list) -> pa.RecordBatch:
        *head, payloads = zip(*rows, strict=True)
        columns = [pa.array(list(c), k) for c, k in zip([[pack_id] * len(rows), *head], kinds, strict=True)]
        if last is None:
            return pa.RecordBatch.from_arrays(columns, names)
        return pa.RecordBatch.from_arrays([*columns, pa.array(last[2](list(payloads)), last[1])], [*names, last[0]])

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for p, path in zip(batch.column("pack_id").to_pylist(), batch.column("path").to_pylist(), strict=True):
                files, place = fs.FileSystem.from_uri(quote(path, safe=":/"))
                with files.open_input_file(place) as file:
                    rows, held = [], 0
                    for row in walk(file, file.size(), last is not None):
                        rows.append(row)
                        held += len(row[-1] or b"")
                        if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                            yield batch_of(p, rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(p, rows)

    more = "" if last is None else f", {last[0]} {'binary' if last[1] == pa.binary() else 'long'}"
    return listed.select(scalars.pack_id_of("path").alias("pack_id"), "path").where("pack_id is not null").mapInArrow(run, HEADERS + more)


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """Every record of the pack files under ``root``; a torn tail is left out, as is what follows a header of another magic (told with its magic)."""
    return _scanned(spark, root, ("payload", pa.binary(), list))


def read_headers(spark: SparkSession, root: str) -> DataFrame:
    """As ``read_records``, without the payloads: longer ones are passed over in the file, and none is kept."""
    return _scanned(spark, root, None)


def read_checksums(spark: SparkSession, root: str) -> DataFrame:
    """As ``read_records``, with the CRC-32C of each payload (crc) in its place: made where the file is read, so no payload leaves its task."""
    return _scanned(spark, root, ("crc", pa.int64(), lambda payloads: crc32c_many(payloads).tolist()))


def bad_headers(records: DataFrame) -> DataFrame:
    """(pack_id, offset) of records whose header has another magic."""
    return records.where(F.col("magic") != F.lit(PACK_MAGIC)).select("pack_id", "offset")


def read_payloads(chunks: DataFrame, index: DataFrame, records: DataFrame) -> DataFrame:
    """(hash, pack_id, problem, payload) of chunks (hash, pack_id, codec, ulen, clen): found by the index, then checked against the file.

    ``problem`` tells the first check that fails, index before header; such a chunk has no payload.
    """
    of = lambda df, prefix, *more: df.select("pack_id", *more, *(F.col(c).alias(f"{prefix}_{c}") for c in ("hash", "codec", "ulen", "clen")))
    own = of(last_entries(index), "i", "offset").withColumnRenamed("i_hash", "hash")
    found = chunks.select("hash", "pack_id", "codec", "ulen", "clen").join(own, ["pack_id", "hash"], "left")
    both = found.join(of(records, "r", "offset", "magic", "payload"), ["pack_id", "offset"], "left")
    problem = F.when(F.col("offset").isNull(), "no index entry")
    for c in ("codec", "ulen", "clen"):
        problem = problem.when(F.col(f"i_{c}") != F.col(c), f"index {c}")
    problem = problem.when(F.col("magic").isNull(), "no record").when(F.col("magic") != F.lit(PACK_MAGIC), "magic").when(F.col("r_hash") != F.col("hash"), "hash")
    for c in ("codec", "ulen", "clen"):
        problem = problem.when(F.col(f"r_{c}") != F.col(c), c)
    return both.select("hash", "pack_id", problem.alias("problem"), F.when(problem.isNull(), F.col("payload")).alias("payload"))

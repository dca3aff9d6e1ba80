"""Cost-balanced packing of token sequences.

Each task cuts its documents' token ids into sequences of at most CAPACITY
tokens.  A document costs linear + quadratic (attention) work; in blocks of
about BLOCK_TOKENS tokens, pieces go in descending cost to the cheapest
sequence that still has room, and what fits nowhere whole is cut.  A block of T
tokens gets floor(T / CAPACITY) full sequences, and the rest is laid out in
sequences of power-of-two length, so that no padding remains.  No shuffle: a
block's documents are neighbours of one input partition.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..ship import ship
from .common import map_arrow, small_batches

CAPACITY = 2048
#: Tokens packed together; more of them give better balance, fewer less memory.
BLOCK_TOKENS = 1 << 20
#: Id that ends each document.
END_ID = 1
#: Cost of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
#: Pieces of an Arrow batch from Python: at most 8 MB of ids.
BATCH_PIECES = 1024
#: Texts from this many characters on go to the exact library.
LONG_TEXT = 1 << 20

#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the others follow 255."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


def token_bytes(vocab: dict[str, int]) -> dict[int, bytes]:
    symbols = byte_symbols()
    return {i: bytes(symbols[c] for c in token) for token, i in vocab.items()}


class Encoder:
    """Ids of whole texts, equal to those of ``tokenizers`` for this file (with add_special_tokens=False).

    The same merges run in a faster library; texts that name an added token, or on which that
    library gives up, go to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.added = [t["content"] for t in model["added_tokens"]]
        ids = {b: i for i, b in token_bytes(model["model"]["vocab"]).items()}
        self.fast = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ids, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if len(text) < LONG_TEXT and not any(t in text for t in self.added):
            try:
                return np.array(self.fast.encode_ordinary(text), np.uint32)
            except BaseException as e:  # the library panics on some very long runs
                if isinstance(e, KeyboardInterrupt | SystemExit):
                    raise
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def capacities(tokens: int, capacity: int = CAPACITY) -> np.ndarray:
    """Sequence lengths for so many tokens: full ones, then a power of two for each bit of the rest."""
    full, rest = divmod(tokens, capacity)
    bits = [1 << k for k in range(capacity.bit_length(), -1, -1) if rest >> k & 1]
    return np.array([capacity] * full + bits, np.int64)


def assign(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths; sequences have no gap.

    >>> assign(np.array([3, 2]), 4)
    [(0, 0, 3, 0, 0), (1, 0, 1, 0, 3), (1, 1, 1, 1, 0)]
    """
    room = capacities(int(lengths.sum()), capacity)
    cost, fill = np.zeros(len(room)), np.zeros(len(room), np.int64)
    out = []

    def put(doc: int, start: int, n: int, s: int) -> None:
        out.append((doc, start, n, s, int(fill[s])))
        fill[s] += n
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for doc in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[doc])
        while left:
            n = min(left, capacity)
            fits = np.flatnonzero(room >= n)
            if not len(fits):
                n = min(n, int(room.max()))
                fits = np.flatnonzero(room >= n)
            put(doc, start, n, int(fits[cost[fits].argmin()]))
            start, left = start + n, left - n
    return out


SCHEMA = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents, with their token ids, in sequences of at most ``capacity`` tokens, a power of two.

    A sequence's pieces ordered by ``offset`` are its ids without a gap.  A null or empty text is its
    end id alone.  Repeated rows are packed as documents of their own.
    Sequence ids are unique: the task's partition in the high bits, a counter below.
    """
    schema = pa.schema([(c, pa.list_(pa.int32()) if c == "ids" else pa.int64()) for c in re.findall(r"(\w+) (?:long|array)", SCHEMA)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        base = TaskContext.get().partitionId() << 33
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = made = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, made
            lengths = np.array([len(x) for x in ids], np.int64)
            rows = assign(lengths, capacity)
            for k in range(0, len(rows), BATCH_PIECES):
                part = rows[k : k + BATCH_PIECES]
                own = [ids[d][s : s + n] for d, s, n, *_ in part]
                ends = np.cumsum([0, *map(len, own)], dtype=np.int32)
                columns = [
                    [names[d] for d, *_ in part], [r[1] for r in part], [r[2] for r in part],
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own).astype(np.int32))),
                    [len(ids[d]) for d, *_ in part], [base + made + r[3] for r in part], [r[4] for r in part],
                ]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], schema=schema)
            made += len(capacities(int(lengths.sum()), capacity))
            ids.clear()
            names.clear()
            held = 0

        end = np.array([end_id], "<u4")
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = np.concatenate([encode(text.as_py() or "").astype("<u4"), end])
                names.append(name)
                ids.append(own)
                held += len(own)
                if held >= block_tokens:
                    yield from flush()
        if ids:
            yield from flush()

    ship(documents.sparkSession)
    small_batches(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def checksums(pieces: DataFrame, keep_ids: bool = False) -> DataFrame:
    """``pieces`` with ids_crc32, the CRC-32 of each piece's ids as little-endian 32-bit numbers, in the place of ids or after them."""
    columns = [c for f in pieces.schema for c in ([(f.name, f.dataType.simpleString())] if f.name != "ids" else [("ids", "array<int>")] * keep_ids + [("ids_crc32", "bigint")])]

    def make():
        def add(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("ids")
            values, ends = ids.values.to_numpy().astype("<i4", copy=False), ids.offsets.to_numpy()
            crc = pa.array([zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())
            return pa.RecordBatch.from_arrays([crc if c == "ids_crc32" else batch.column(c) for c, _ in columns], names=[c for c, _ in columns])

        return add

    return map_arrow(pieces, make, ", ".join(f"`{c}` {t}" for c, t in columns))

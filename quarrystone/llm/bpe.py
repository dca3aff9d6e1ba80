"""Byte-pair encoding by segment trees over adjacent pair ranks, and decoding.

A piece's leaves are its symbols; a leaf's key is the rank of the pair it forms
with its right neighbour, then its position.  The root holds the least key,
the leftmost of the lowest-ranked merges; a merge changes three leaves, each
updated along its path in logarithmic time, until no pair can be merged.

Short pieces are merged together, one step of all their trees at a time (numpy);
long ones in a tree each.  Pieces already seen by a task are looked up.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .packing import PIECES, byte_symbols, token_bytes

#: Pieces of at most so many bytes are merged in lockstep.
SHORT = 64
SIZE_CLASS = [0, *((n - 1).bit_length() for n in range(1, SHORT + 1))]
#: Pieces remembered by a task before it forgets them all (about 400 bytes each).
REMEMBERED = 400_000
NONE = (1 << 31) - 1
#: Before an added token's text it makes a name that no piece of text has, as pieces hold no space after a control character.
ADDED = "\0 "
#: Characters of text whose new pieces are merged together.
GROUP = 1 << 20
#: Bits of an id in the key of a pair; more symbols are refused.
ID_BITS = 24


class Merges:
    """Rank and product of each mergeable pair, as sorted arrays and as a dict."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        self.bytes_of = token_bytes(vocab)
        self.byte_id = np.zeros(256, np.int64)
        for c, b in byte_symbols().items():
            self.byte_id[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        a, b = ([vocab[p[k]] for p in pairs] for k in (0, 1))
        made = [vocab[x + y] for x, y in pairs]
        self.of = {(x, y): (r, m) for r, (x, y, m) in enumerate(zip(a, b, made, strict=True))}
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        if max(self.bytes_of) >= 1 << ID_BITS:
            raise ValueError(f"ids from {1 << ID_BITS} on are not supported")
        # look-up tables of falling size: what collides in one goes to the next
        key, rank = np.array(a, np.int64) << ID_BITS | np.array(b, np.int64), np.arange(len(a))
        self.made, self.levels = np.array(made, np.int32), []
        while len(key):
            bits = max(6, (4 * len(key)).bit_length())
            slot = self.slots(key, bits)
            _, own = np.unique(slot, return_index=True)
            keys, ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
            keys[slot[own]], ranks[slot[own]] = key[own], rank[own]
            self.levels.append((bits, keys, ranks))
            key, rank = np.delete(key, own), np.delete(rank, own)

    @staticmethod
    def slots(key: np.ndarray, bits: int) -> np.ndarray:
        return ((key * np.int64(0x1E3779B97F4A7C15 | bits << 1)) >> np.int64(62 - bits)) & ((1 << bits) - 1)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if it can't be merged; negative ids are no symbols."""
        want = np.where((a >= 0) & (b >= 0), a.astype(np.int64) << ID_BITS | b, -2)
        out = np.full(len(want), NONE, np.int32)
        for bits, keys, ranks in self.levels:
            at = self.slots(want, bits)
            np.copyto(out, ranks[at], where=keys[at] == want)
        return out


def encode_long(piece: bytes, merges: Merges) -> list[int]:
    """One segment tree in flat arrays (about 30 bytes for each byte), for a piece of any length; a node is rank * size + place."""
    n = len(piece)
    size = 1 << max(0, n - 1).bit_length()
    symbol = array("i", merges.byte_id[np.frombuffer(piece, np.uint8)].tolist())
    after, before = array("i", [*range(1, n), -1]), array("i", range(-1, n - 1))
    of, none = merges.of, 1 << 62

    def key(i: int) -> int:
        pair = of.get((symbol[i], symbol[after[i]])) if after[i] >= 0 else None
        return none if pair is None else pair[0] * size + i

    tree = array("q", [none]) * (2 * size)
    for i in range(n):
        tree[size + i] = key(i)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                break
            tree[k] = low

    while tree[1] < none:
        i = tree[1] % size
        j = after[i]
        symbol[i] = of[symbol[i], symbol[j]][1]
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        symbol[j] = -1
        put(j, none)
        put(i, key(i))
        if before[i] >= 0:
            put(before[i], key(before[i]))
    return [s for s in symbol if s >= 0]


def encode_short(pieces: list[bytes], merges: Merges) -> list[list[int]]:
    """The trees of many pieces of like length, a merge in each at every step; all arrays are flat."""
    w = len(pieces)
    lengths = np.array([len(p) for p in pieces])[:, None]
    size = max(2, 1 << int(lengths.max() - 1).bit_length())
    width, place = size + 1, np.arange(size + 1)  # place `size` stands for no neighbour
    given = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(w, width)
    symbol = np.where(place < lengths, merges.byte_id[given], -1).astype(np.int32).ravel()
    after = np.where(place + 1 < lengths, place + 1, size).astype(np.int32).ravel()
    before = np.tile(place - 1, w).astype(np.int32)
    tree = np.full((w, 2 * size), NONE, np.int32)
    rank = merges.ranks(symbol, np.append(symbol[1:], np.int32(-1))).reshape(w, width)[:, :size]
    tree[:, size:] = np.where(rank < NONE // size, rank * size + place[:size], NONE)
    for k in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
    flat = tree.ravel()

    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        at, top = rows * width, rows * (2 * size)
        root = flat[top + 1]
        i = root % size
        j = after[at + i]
        k = after[at + j]
        p = before[at + i]
        new = merges.made[root // size]
        symbol[at + i] = new
        symbol[at + j] = -1
        after[at + i] = k
        before[at + k] = i
        left = np.where(p >= 0, symbol[at + np.maximum(p, 0)], -1)
        right = merges.ranks(new, symbol[at + k])
        leaf = merges.ranks(left, new)
        p = np.where(p >= 0, p, i)  # without a left neighbour, the leaf itself once more
        flat[top + size + j] = NONE
        flat[top + size + p] = np.where(leaf < NONE // size, leaf * size + p, NONE)
        flat[top + size + i] = np.where(right < NONE // size, right * size + i, NONE)
        node = np.concatenate([size + i, size + j, size + p])
        base = np.concatenate([top, top, top])
        while node[0] > 1:
            node >>= 1
            down = base + 2 * node
            flat[base + node] = np.minimum(flat[down], flat[down + 1])
        rows = rows[flat[top + 1] < NONE]
    ids, live = symbol.reshape(w, width), symbol >= 0
    ends = np.cumsum(live.reshape(w, width).sum(1)).tolist()
    kept = ids.ravel()[live].tolist()
    return [kept[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """encode() and decode() of whole texts, with what a task remembers of pieces."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.pieces = regex.compile(PIECES)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.merges.added, key=len, reverse=True))) + ")") if self.merges.added else None
        self.long: list[str] = []  # known until other pieces are learned
        self.known: dict[str, list[int]] = {}

    def learn(self, pieces: set[str]) -> None:
        """Remembers the encoding of each of these pieces."""
        for p in self.long:
            self.known.pop(p, None)
        self.long = []
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = pieces
        by: dict[int, list[str]] = {}
        for p in new:
            if p.startswith(ADDED) and p[len(ADDED) :] in self.merges.added:
                self.known[p] = [self.merges.added[p[len(ADDED) :]]]
            else:
                by.setdefault(SIZE_CLASS[len(p)] if p.isascii() and len(p) <= SHORT else -1, []).append(p)
        rest = by.pop(-1, [])
        for p in rest:
            n = len(p.encode("utf-8", "replace"))
            by.setdefault(SIZE_CLASS[n] if n <= SHORT else 99, []).append(p)
        self.long = by.get(99, [])
        for kind, group in by.items():
            raw = [p.encode("utf-8", "replace") for p in group]
            got = [encode_long(b, self.merges) for b in raw] if kind == 99 else encode_short(raw, self.merges)
            self.known.update(zip(group, got, strict=True))

    def parts(self, text: str) -> list[str]:
        """Pieces of a text; added tokens stand as pieces of their own, remembered under their text."""
        if self.split is None or not any(t in text for t in self.merges.added):
            return self.pieces.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.split.split(text)):
            out += [ADDED + part] if k % 2 else self.pieces.findall(part)
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text or ""])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of some texts, whose new pieces are merged together."""
        parts = [self.parts(t) for t in texts]
        self.learn(set().union(*parts))
        known = self.known
        return [[*chain.from_iterable([known[p] for p in pieces])] for pieces in parts]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.merges.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def groups(texts: pa.Array) -> Iterator[list[str]]:
    """The texts, whole and in order, about GROUP characters at a time; nulls are empty."""
    group, size = [], 0
    for t in texts:
        group.append(t.as_py() or "")
        size += len(group[-1])
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode_documents(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded): ids of each whole text and the text they decode to; null is empty."""

    def make():
        codec = Codec(tokenizer)

        def apply(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            at = 0
            for group in groups(batch.column("text")):
                ids = codec.encode_all(group)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(group)), pa.array(ids, pa.list_(pa.int32())), pa.array(map(codec.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])
                at += len(group)

        return apply

    return map_arrow(documents.select("doc_id", "text"), make, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what encode_documents gives."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Removal of long word sequences that an earlier document already holds.

A window is WIDTH consecutive words, named by a Rabin-Karp hash.  Each word
covered by a window that also starts in a document with a smaller id goes;
covered words form maximal intervals.

Two windows of equal words choose the same ANCHOR-word sub-window with the
least hash.  Anchors (one word in sixteen or so) are counted over the whole
corpus first; only windows whose anchor occurs in two documents can repeat,
and just these are hashed, counted and compared.  No window that could repeat
is left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import map_arrow
from .words import mix64, rolling_hash, slices, sliding_argmin

#: Words of a window, and of the sub-window that stands for it in the first count.
WIDTH, ANCHOR = 50, 20
#: Windows of neighbouring documents compared at once before the shuffle, and shared ones that a task remembers.
TOGETHER, REMEMBERED = 1 << 20, 1 << 20


def _anchors(hashes: np.ndarray, width: int, anchor: int) -> np.ndarray:
    """For each window the hash of its anchor."""
    h = rolling_hash(hashes, anchor)
    return h[sliding_argmin(h, width - anchor + 1)]


class Windows:
    """The windows that a task has met, told once a document.

    Where an earlier document of this task holds a window too, the later one's is known to be repeated; it needs no
    comparison and gets a name of its own.  So a window of very many documents makes a few rows a task.
    """

    def __init__(self) -> None:
        self.window, self.least = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def rows(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        """Windows (row, start, hash) as a batch."""
        row, start, window = (np.concatenate(x) for x in zip(*found, strict=True))
        doc = ids[row]
        order = np.lexsort((doc, window))
        w, d = window[order], doc[order]
        new = np.concatenate([[True], w[1:] != w[:-1]])[: len(order)]
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        name, least = w[first], d[first]
        if len(self.window) and len(name):
            at = np.minimum(np.searchsorted(self.window, name), len(self.window) - 1)
            least = np.where(self.window[at] == name, np.minimum(self.least[at], least), least)
        known = np.zeros(len(order), bool)
        known[order] = d > least[group]
        self.remember(name, least, np.maximum.reduceat(d > least[group], first) if len(first) else new)
        own = np.where(known, mix64(window ^ mix64(doc.astype(np.uint64)) ^ start.astype(np.uint64)), window)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(keys[row]), pa.array(start.astype(np.int32)), _longs(own), pa.array(known)], ["doc_id", "text_key", "start", "window", "known"])

    def remember(self, window: np.ndarray, least: np.ndarray, shared: np.ndarray) -> None:
        """Keeps what several documents share; what was kept before goes first when there is too much."""
        window, least = window[shared], least[shared]
        if len(self.window) + len(window) <= REMEMBERED:
            old = ~np.isin(self.window, window)
            window, least = np.concatenate([self.window[old], window]), np.concatenate([self.least[old], least])
        order = np.argsort(window, kind="stable")
        self.window, self.least = window[order], least[order]


def _keyed(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): rows of one id with other texts are kept apart by the key."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def removals(documents: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text_key, starts): where each window of a document that goes starts first, in words."""
    docs = _keyed(documents)
    anchor = min(anchor, width)

    def anchors():
        def apply(batch: pa.RecordBatch):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            keys = batch.column("text_key").to_numpy(zero_copy_only=False)
            live = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for s in slices(batch.column("text")):
                found = [(i, np.unique(_anchors(s.hashes[a:b], width, anchor))) for i in range(s.n) if live[s.first + i] for a, b in [s.text(i)] if b - a >= width]
                if found:
                    rows = np.repeat([s.first + i for i, _ in found], [len(x) for _, x in found])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows].astype(np.int64)), pa.array(keys[rows]), _longs(np.concatenate([x for _, x in found]))], ["doc_id", "text_key", "anchor"])

        return apply

    rows = map_arrow(docs, anchors, "doc_id long, text_key long, anchor long")
    shared = rows.groupBy("anchor").agg(F.min("doc_id").alias("__low"), F.max("doc_id").alias("__high")).where("__low < __high").select("anchor")
    wanted = rows.join(shared, "anchor").groupBy("doc_id", "text_key").agg(F.collect_set("anchor").alias("anchors"))

    def windows():
        met = Windows()

        def apply(batch: pa.RecordBatch):
            some = np.flatnonzero(batch.column("anchors").is_valid().to_numpy(zero_copy_only=False))
            if not len(some):
                return
            batch = batch.take(pa.array(some))
            ids, keys, lists = batch.column("doc_id").to_numpy(), batch.column("text_key").to_numpy(), batch.column("anchors")
            flat, at = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            first_row = {x: i for i, x in reversed([*enumerate(zip(ids.tolist(), keys.tolist(), strict=True))])}
            for s in slices(batch.column("text")):
                for i in range(s.n):
                    a, b = s.text(i)
                    k = s.first + i
                    if first_row[ids[k], keys[k]] != k:  # a repeated row tells nothing new
                        continue
                    keep = np.flatnonzero(np.isin(_anchors(s.hashes[a:b], width, anchor), flat[at[k] : at[k + 1]]))
                    own, first = np.unique(rolling_hash(s.hashes[a:b], width)[keep], return_index=True)
                    found.append((np.full(len(own), k), keep[first], own))
                if sum(len(x) for x, *_ in found) >= TOGETHER:
                    yield met.rows(found, ids, keys)
                    found = []
            if found:
                yield met.rows(found, ids, keys)

        return apply

    possible = map_arrow(docs.join(wanted, ["doc_id", "text_key"], "left"), windows, "doc_id long, text_key long, start int, window long, known boolean")
    first = F.min("doc_id").over(Window.partitionBy("window"))
    repeated = possible.withColumn("__first", first).where("known or __first < doc_id")
    return repeated.groupBy("doc_id", "text_key").agg(F.collect_list("start").alias("starts"))


def covered(starts: np.ndarray, words: int, width: int) -> np.ndarray:
    """Which of ``words`` words a window from ``starts`` covers; repeated starts count once."""
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge)[:-1] > 0


def intervals(mask: np.ndarray) -> np.ndarray:
    """Maximal runs of True, as rows (start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge.reshape(-1, 2)


def _texts(batch: pa.RecordBatch, width: int):
    """Of each text: its slice and bytes, its place there, the bounds of its words and which of them go."""
    lists = batch.column("starts")
    for s in slices(batch.column("text")):
        raw = s.data.tobytes()
        for i in range(s.n):
            a, b = s.text(i)
            starts, mask = lists[s.first + i], np.zeros(b - a, bool)
            if starts.is_valid:  # a window goes wherever the document repeats it
                h = rolling_hash(s.hashes[a:b], width)
                mask = covered(np.flatnonzero(np.isin(h, h[np.array(starts.as_py(), np.int64)])), b - a, width)
            yield s, raw, i, a, b, mask


def digests(documents: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``documents``.

    A null or empty text has no words; a row whose id is null is compared with nothing and keeps all.
    """
    marked = _keyed(documents).join(removals(documents, width, anchor), ["doc_id", "text_key"], "left")

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, gone, sha = [], [], []
            for s, raw, _, a, b, mask in _texts(batch, width):
                n.append(b - a)
                gone.append(int(mask.sum()))
                kept = np.flatnonzero(~mask) + a
                sha.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(s.starts[kept].tolist(), s.ends[kept].tolist(), strict=True)])).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

        return apply

    return map_arrow(marked, make, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(documents: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """``documents`` with repeated intervals cut out of text; all rows and other columns stay.

    An interval goes with the white space after it; a text without any is unchanged.
    A text whose words all go is left empty; a null text stays null.  A column n_chars follows the text.
    """
    if not {"doc_id", "text"} <= set(documents.columns):
        raise ValueError("documents need the columns doc_id and text")
    others = [c for c in documents.columns if c != "text"]
    schema = documents.schema
    packed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text", F.struct(*others).alias("__row"))
    marked = packed.join(removals(documents, width, anchor), ["doc_id", "text_key"], "left")

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for s, raw, i, a, b, mask in _texts(batch, width):
                if not mask.any():
                    out.append(None)
                    continue
                at, to = int(s.offsets[i]), int(s.offsets[i + 1])
                begins = np.append(s.starts[a:b], to)
                parts, last = [], at
                for x, y in intervals(mask).tolist():
                    parts.append(raw[last : begins[x]])
                    last = int(begins[y])
                out.append((b"".join(parts) + raw[last:to]).decode("utf-8"))
            return pa.RecordBatch.from_arrays([batch.column("__row"), batch.column("text"), pa.array(out, pa.string())], ["__row", "text", "__cut"])

        return apply

    result = T.StructType([packed.schema["__row"], packed.schema["text"], T.StructField("__cut", T.StringType())])
    cut = map_arrow(marked.select("__row", "text", "starts"), make, result)
    text = F.coalesce("__cut", "text")
    columns = [text.alias(c) if c == "text" else F.length(text).cast(schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"__row.`{c}`").alias(c) for c in documents.columns]
    return cut.select(*columns)

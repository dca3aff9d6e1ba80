"""Exact Jaccard similarity join of documents as sets of word shingles, in metric regions.

Documents of equal sets are one node, named by a hash of the set.

1. Company.  A linked set shares all but a known number of its shingles with its
   partner, so at least a known number of those with small hashes, which both
   keep.  Nodes with fewer small-hash shingles in company leave; what is common to many
   texts (a passage, a license line) doesn't hold them, and is told about once a task.
2. Sizes.  Two linked sets differ in size by at most the threshold's factor, so
   nodes fall in size classes; a node near a border is replicated into the
   class below (a window), where it may meet smaller partners.
3. Regions.  In a class whose linked pairs differ in at most K shingles, each set
   is dealt by hash into K + 1 + spare slices.  Linked sets then agree on at least
   1 + spare slices, so each may leave out its spare weakest ones (fewest
   shingles) and still agree on one that both show.  A quarter of K is spare: a set
   has fewer empty slices than that, which would make a region of texts that have nothing in
   common.  The least node that shows a slice is the pivot of all nodes that do; a
   pivot and its nodes are a region.
4. Sketches.  A set's counts in hash ranges are a contraction: two sets' counts
   differ (summed) by at most the number of shingles in which the sets differ.  A region
   falls into groups of nodes that are near enough by sketch, before texts are moved;
   nodes alone leave.  A region over SKETCHED nodes is dealt into blocks, and its groups
   are joined from those of each pair of blocks.
5. In a region, distances to a pivot order the nodes, and by the triangle
   inequality only nodes whose distances differ by at most the threshold's are
   compared, exactly.  A region over REGION nodes is dealt into blocks; each is joined
   by itself with the pivot.  What is then in one component with most of the region isn't
   compared any more with its like, only with the rest, block by block.

Links leave a region as a spanning forest, never as all pairs; connected
components join the forests.  (Voronoi regions around pivots by the Jaccard
distance itself don't separate texts: nearly all pairs are at distance 1, so
each document lies in the window of every region.  See the README.)
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import connected_components, map_arrow, possibly_in, written
from .words import U, mix64, range_hash, rolling_hash, slices

#: Slices that every linked pair agrees on beyond one: so many at least, and that share of the shingles in which it may differ.
SPARE, SPARE_SHARE = 3, 4
#: Ratio of a size class's borders.
RATIO = 1.6
#: Nodes of a block of a region; a task holds two blocks.
REGION = 512
#: Sets below so many shingles keep all of them for company, others twice the share in which linked sets may differ.
SMALL = 64
#: Nodes that a task remembers having shown.
SHOWN = 1 << 20
#: Nodes of a region compared by sketch at once; a larger region is dealt into blocks of half as many.
SKETCHED = 2048


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than ``width`` are one shingle, none an empty set."""
    n = len(hashes)
    if n >= width:
        return np.unique(rolling_hash(hashes, width))
    return mix64(range_hash(hashes, np.array([0]), np.array([n])) + U(n)) if n else np.zeros(0, U)


def node_of(s: np.ndarray) -> np.uint64:
    """Name of a set: a hash of its members and size."""
    return mix64(np.array([mix64(s ^ U(0xA0761D6478BD642F)).sum(dtype=U) + U(len(s))]))[0]


@cache
def border(k: int) -> int:
    """Least size of class k."""
    return 1 if k == 0 else max(border(k - 1) + 1, int(np.ceil(border(k - 1) * RATIO)))


@cache
def schemes(n: int, num: int, den: int) -> tuple[tuple[int, int, int], ...]:
    """(class, slices, spare ones) of each class in which a set of n shingles can meet a smaller or equal partner's class.

    Classes whose linked sets must be equal need no slices.
    """
    k = 0
    while border(k + 1) <= n:
        k += 1
    out = []
    while k >= 0 and (border(k + 1) - 1) * den >= num * n:
        differ = (border(k + 1) - 1) * (den - num) // num
        if differ:
            spare = max(SPARE, differ // SPARE_SHARE)
            out.append((k, differ + 1 + spare, spare))
        k -= 1
    return tuple(out)


@cache
def edges(m: int) -> np.ndarray:
    """Lower bounds of m slices of the hash range."""
    return np.array([(j << 64) // m for j in range(m)], U)


def slice_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the slices that a set shows, over its classes."""
    out = []
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix64(s + U(0x9E3779B97F4A7C15)))])
    for k, m, spare in schemes(len(s), num, den):
        at = np.append(np.searchsorted(s, edges(m)), len(s))
        count = np.diff(at)
        key = mix64(total[at[1:]] - total[at[:-1]] + mix64(np.arange(m, dtype=U) + U(k << 32)) + count.astype(U))
        out.append(key[np.lexsort((key, count))[spare:]])
    return np.concatenate(out) if out else np.zeros(0, U)


def sketch(s: np.ndarray) -> np.ndarray:
    """Shingles in each of a power of two of equal hash ranges, about four in each; at most 255 are told."""
    bits = min(11, max(4, (len(s) // 4).bit_length()))
    return np.minimum(np.bincount((s >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def near_groups(sketches: list[np.ndarray], size: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each set the first one of its group; sets that may link, by the summed difference of their sketches, share a group.

    Longer sketches are folded to the shortest's ranges; told counts of 255 make a difference smaller, never larger.
    """
    width = min(map(len, sketches))
    x = np.stack([np.minimum(k.reshape(width, -1).sum(1, dtype=np.int64), 255).astype(np.int16) for k in sketches])
    order = np.argsort(size, kind="stable")
    x, size = x[order], size[order]
    root = np.arange(len(x))
    step = max(1, (1 << 22) // (width * 64))
    for a in range(0, len(x), 64):
        b = min(len(x), a + 64)
        last = int(np.searchsorted(size * num, size[b - 1] * den, "right"))
        for c in range(a, last, step):
            d = min(last, c + step)
            if (root[a:b] == root[a]).all() and (root[c:d] == root[a]).all():
                continue
            apart = np.abs(x[a:b, None, :] - x[None, c:d, :]).sum(2, dtype=np.int64)
            ok = apart * (den + num) <= (size[a:b, None] + size[None, c:d]) * (den - num)
            for i in np.flatnonzero((ok & (root[a:b, None] != root[None, c:d])).any(1)):
                own = np.unique(np.append(root[c:d][ok[i]], root[a + i]))
                if len(own) > 1:
                    root[np.isin(root, own)] = own[0]
    first = np.full(len(x), len(x))
    np.minimum.at(first, root, order)
    out = np.empty(len(x), np.int64)
    out[order] = first[root]
    return out


def _near_nodes(region: DataFrame, num: int, den: int) -> DataFrame:
    """(pivot, node) of the groups of two and more nodes that a region falls into by sketch; rows have n and sketch too.

    The pivot is now the least node of the group.  What is compared at once is named by the column ``region``.
    """

    def run(batches):
        pivot, nodes, size, own = None, [], [], []

        def flush():
            if len(nodes) < 2:
                return None
            group = near_groups(own, np.array(size, np.int64), num, den)
            some = np.flatnonzero(np.bincount(group, minlength=len(nodes))[group] > 1)
            pivots, kept = [nodes[group[k]] for k in some], [nodes[k] for k in some]
            return pa.RecordBatch.from_arrays([pa.array(pivots, pa.int64()), pa.array(kept, pa.int64())], ["pivot", "node"])

        last = None
        for batch in batches:
            for p, c, n, k in zip(*(batch.column(x).to_pylist() for x in ("region", "node", "n", "sketch")), strict=True):
                if p != pivot:
                    if (out := flush()) is not None:
                        yield out
                    pivot, nodes, size, own, last = p, [], [], [], None
                if c == last:
                    continue
                last = c
                nodes.append(c)
                size.append(n)
                own.append(np.frombuffer(k, np.uint8))
        if (out := flush()) is not None:
            yield out

    return region.select("region", "node", "n", "sketch").repartition("region").sortWithinPartitions("region", "node").mapInArrow(run, "pivot long, node long")


def _near_in_large(region: DataFrame, drawn: DataFrame, num: int, den: int) -> DataFrame:
    """_near_nodes of regions (pivot, node, nodes) of too many ``nodes`` to compare at once: pairs of blocks, whose groups are joined."""
    blocks = F.ceil(F.col("nodes") * 2 / SKETCHED).cast("int")
    dealt = region.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    named = pairs.withColumn("region", F.format_string("%d:%d:%d", "pivot", F.least("block", "other"), F.greatest("block", "other")))
    groups = _near_nodes(named.select("region", "node").join(drawn.select("node", "n", "sketch"), "node"), num, den)
    return connected_components(groups, "pivot", "node").select(F.col("root").alias("pivot"), "node")


def kept_below(n: int, num: int, den: int) -> int:
    """Hashes below this are kept of a set of n shingles (2**64: all)."""
    return 1 << 64 if n < SMALL else min(1 << 64, (2 * (den - num) << 64) // den)


def small_hashes(s: np.ndarray, num: int, den: int) -> np.ndarray:
    top = kept_below(len(s), num, den)
    return s if top >> 64 else s[: np.searchsorted(s, U(top))]


def company(s: np.ndarray, num: int, den: int) -> int:
    """Least number of a set's kept shingles that any linked set keeps too.

    The partner keeps at least what the largest possible partner would.
    """
    top = kept_below(len(s) * den // num + 1, num, den)
    both = len(s) if top >> 64 else int(np.searchsorted(s, U(top)))
    return both - (den - num) * len(s) // den


def _sets(documents: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, text_key, n, node, need) of each document; need: its set's least company."""

    def make():
        def apply(batch: pa.RecordBatch):
            keyed = batch.column("text_key")
            for s in slices(batch.column("text"), lower=True):
                n, node, need = [], [], []
                for i in range(s.n):
                    a, b = s.text(i)
                    own = shingle_set(s.hashes[a:b], width)
                    n.append(len(own))
                    node.append(int(node_of(own)) if len(own) else 0)
                    need.append(company(own, num, den) if len(own) else 0)
                names = pa.array(np.array(node, U).view(np.int64), mask=np.array(n) == 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.first, s.n), keyed.slice(s.first, s.n), pa.array(n, pa.int64()), names, pa.array(need, pa.int64())], ["doc_id", "text_key", "n", "node", "need"])

        return apply

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return map_arrow(rows, make, "doc_id long, text_key long, n long, node long, need long")


class Company:
    """The kept shingles that a task has met.

    Where two of its nodes keep a shingle, both are known to be in company and the shingle is told
    with two of them as witnesses for other tasks, once a task.  So a very common shingle makes a few rows a task.
    """

    def __init__(self, task: int) -> None:
        self.shared, self.name = np.zeros(0, U), mix64(np.array([task], U))[0]

    def rows(self, nodes: np.ndarray, own: list[np.ndarray]) -> pa.RecordBatch:
        """(node, shingle, known): shingles that need other tasks (known is null) or are witnesses (0).

        How many a node knows to be in company goes under a number of its own instead of a shingle.
        """
        row, shingle = np.repeat(np.arange(len(nodes)), [len(x) for x in own]), np.concatenate(own)
        order = np.argsort(shingle, kind="stable")
        row, shingle = row[order], shingle[order]
        first = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]])[: len(shingle)])
        size = np.diff(np.append(first, len(shingle)))
        old = np.isin(shingle[first], self.shared)
        known = np.repeat(old | (size > 1), size)
        new = first[~old & (size > 1)]
        witness = np.concatenate([new, new + 1])  # a node keeps a shingle once, so these are two nodes
        count = np.bincount(row[known], minlength=len(nodes))
        some = np.flatnonzero(count)
        self.shared = np.sort(np.concatenate([self.shared, shingle[new]])) if len(self.shared) + len(new) <= SHOWN else np.sort(shingle[new])
        tell = np.concatenate([np.flatnonzero(~known), witness])
        who = np.concatenate([nodes[row[tell]], nodes[some]]).view(np.int64)
        number = np.concatenate([np.full(int((~known).sum()), -1), np.zeros(len(witness), np.int64), count[some]])
        what = pa.array(np.concatenate([shingle[tell], mix64(nodes[some] ^ self.name ^ U(len(self.shared)))]).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(who), what, pa.array(number, pa.int64(), mask=number < 0)], ["node", "shingle", "known"])


def _kept(documents: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, shingle, known) by Company: the kept shingles of each document's set; a task looks at a node once."""

    def make():
        shown: set[int] = set()
        met = Company(TaskContext.get().partitionId())

        def apply(batch: pa.RecordBatch):
            for s in slices(batch.column("text"), lower=True):
                nodes, own = [], []
                for i in range(s.n):
                    a, b = s.text(i)
                    x = shingle_set(s.hashes[a:b], width)
                    if len(x) and (c := int(node_of(x))) not in shown:
                        if len(shown) >= SHOWN:
                            shown.clear()
                        shown.add(c)
                        nodes.append(c)
                        own.append(small_hashes(x, num, den))
                if nodes:
                    yield met.rows(np.array(nodes, U), own)

        return apply

    return map_arrow(documents.select("text"), make, "node long, shingle long, known long")


def _in_company(documents: DataFrame, sets: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, doc_id) of nodes that have the company a link needs, with one document of each.

    A node's company is at most the largest number that a task knew and what other tasks add; it may be told too large, never too small.
    """
    each, ordered = Window.partitionBy("shingle"), Window.partitionBy("shingle").orderBy("node", F.col("known").asc_nulls_first())
    rows = _kept(documents, width, num, den)
    told = rows.withColumn("__before", F.lag("node").over(ordered)).withColumn("__low", F.min("node").over(each)).withColumn("__high", F.max("node").over(each))
    more = F.col("known").isNull() & (F.col("__low") < F.col("__high")) & (F.col("__before").isNull() | (F.col("__before") != F.col("node")))
    shared = told.where(more | (F.col("known") > 0)).groupBy("node").agg((F.count_if(more) + F.coalesce(F.max("known"), F.lit(0))).alias("shared"))
    classes = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("need").alias("need"))
    return classes.join(shared, "node", "left").where(F.coalesce("shared", F.lit(0)) >= F.col("need")).select("node", "doc_id")


def _drawn(texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, n, sketch, slices, text) of rows (node, text); a row whose text has another set (a repeated id) is left out."""

    def make():
        def apply(batch: pa.RecordBatch):
            nodes = batch.column("node").to_numpy().view(U)
            for s in slices(batch.column("text"), lower=True):
                rows, n, drawn, keys = [], [], [], []
                for i in range(s.n):
                    a, b = s.text(i)
                    own = shingle_set(s.hashes[a:b], width)
                    if len(own) and node_of(own) == nodes[s.first + i]:
                        rows.append(s.first + i)
                        n.append(len(own))
                        drawn.append(sketch(own).tobytes())
                        keys.append(slice_keys(own, num, den))
                if rows:
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
                    own = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([own.column("node"), pa.array(n, pa.int64()), pa.array(drawn, pa.binary()), lists, own.column("text")], ["node", "n", "sketch", "slices", "text"])

        return apply

    return map_arrow(texts, make, "node long, n long, sketch binary, slices array<long>, text string")


def region_links(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(root of each set, number of links each has) among these sets, by exact comparison.

    Sets are ordered by their distance to the first, the pivot; rows are compared
    with those whose distance is larger by at most the join distance.
    """
    g = len(sets)
    size = np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(g), size)
    keep = count[column] > 1
    number = np.cumsum(count > 1) - 1
    row, column = row[keep], number[column[keep]]
    width = int((count > 1).sum())
    pivot = np.bincount(row[np.isin(column, column[row == 0])], minlength=g)
    far = 1 - pivot / (size + size[0] - pivot)
    order = np.argsort(far, kind="stable")
    place = np.empty(g, np.int64)
    place[order] = np.arange(g)
    row, size, far = place[row], size[order], far[order]
    left, right = [], []
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    for a in range(0, g, 128):
        b = min(g, a + 128)
        to = int(np.searchsorted(far, far[b - 1] + (den - num) / den + 1e-9, "right"))
        both = np.zeros((b - a, to - a), np.float32)
        for c in range(0, width, 4096):
            x, y = np.searchsorted(column, [c, c + 4096])
            dense = np.zeros((to - a, min(4096, width - c)), np.float32)
            inside = (row[x:y] >= a) & (row[x:y] < to)
            dense[row[x:y][inside] - a, column[x:y][inside] - c] = 1
            both += dense[: b - a] @ dense.T
        union = size[a:b, None] + size[None, a:to] - both
        i, j = np.nonzero(den * both >= num * union)
        own = j > i
        left.append(order[i[own] + a])
        right.append(order[j[own] + a])
    i, j = np.concatenate(left), np.concatenate(right)
    root = np.arange(g)
    while len(i):
        low = np.minimum(root[i], root[j])
        if (low == root[i]).all() and (low == root[j]).all():
            break
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
    return root, np.bincount(np.concatenate([i, j]).astype(np.int64), minlength=g)


def _forests(members: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(a, b): a spanning forest of the links of each region block; rows are (tile, node, text), sorted by tile."""

    def make():
        waiting: list[tuple[int, np.ndarray]] = []
        tile = None

        def links() -> pa.RecordBatch | None:
            nodes = [c for c, _ in waiting]
            if len(nodes) < 2:
                return None
            root, _ = region_links([s for _, s in waiting], num, den)
            some = np.flatnonzero(root != np.arange(len(root)))
            names = np.array(nodes, U).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names[root[some]]), pa.array(names[some])], ["a", "b"]) if len(some) else None

        def apply(batch: pa.RecordBatch | None):
            nonlocal waiting, tile
            if batch is None:
                if (out := links()) is not None:
                    yield out
                return
            tiles, nodes = batch.column("tile").to_pylist(), batch.column("node").to_numpy().view(U)
            for s in slices(batch.column("text"), lower=True):
                for i in range(s.n):
                    k = s.first + i
                    if tiles[k] != tile:
                        if (out := links()) is not None:
                            yield out
                        waiting, tile = [], tiles[k]
                    a, b = s.text(i)
                    own = shingle_set(s.hashes[a:b], width)
                    waiting.append((int(nodes[k]), own))

        return apply

    def run(batches):
        apply = make()
        for batch in batches:
            yield from apply(batch)
        yield from apply(None)

    return members.repartition("tile").sortWithinPartitions("tile", "node").mapInArrow(run, "a long, b long")


def _tiles(region: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, tile): what a task compares at first; (pivot, node) of the regions of which that is a part only.

    Regions that share nodes are compared together, each node once, where they have at most REGION nodes in
    all.  The others stay apart; one of more nodes is dealt into blocks, and each block is a tile, with the pivot.
    """
    joined = connected_components(region.select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    joined = written(joined, "joined")
    sized = written(joined.join(joined.groupBy("root").agg(F.count("*").alias("size")), "root"), "sized")
    together = sized.where(F.col("size") <= REGION).select("node", F.col("root").cast("string").alias("tile"))
    apart = region.join(sized.where(F.col("size") > REGION).select(F.col("node").alias("pivot")), "pivot", "left_semi")
    dealt = written(apart.join(apart.groupBy("pivot").agg(F.ceil(F.count("*") / REGION).cast("int").alias("blocks")), "pivot"), "dealt")
    block = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_block("blocks")))
    tiles = dealt.withColumn("block", F.explode(block)).select("node", F.format_string("%d:%d", "pivot", "block").alias("tile"))
    return together.unionByName(tiles), dealt.where(F.col("blocks") > 1).select("pivot", "node")


def _block(blocks: str) -> Column:
    """The block of a node, of so many."""
    return F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")


def _tiles_of_rest(region: DataFrame, links: DataFrame) -> DataFrame:
    """(node, tile): what is still to be compared in regions (pivot, node), after ``links`` (a, b) were found.

    Of a region's nodes most are in one component already, which needs no more links between them.  Blocks of the
    others are compared with each other and with blocks of these.
    """
    placed = region.join(connected_components(links), "node", "left").select("pivot", "node", F.coalesce("root", "node").alias("root"))
    count = placed.groupBy("pivot", "root").count()
    main = count.groupBy("pivot").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.max("count").alias("most"), F.sum("count").alias("all")).where(F.col("all") > F.col("most"))
    blocks = main.select("pivot", "main", F.ceil(F.col("most") / REGION).cast("int").alias("inner"), F.ceil((F.col("all") - F.col("most")) / REGION).cast("int").alias("outer"))
    split = written(placed.join(blocks, "pivot").withColumn("rest", F.col("root") != F.col("main")), "split")
    rest = split.where("rest").withColumn("block", _block("outer"))
    among = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("outer") - 1))).select("node", F.format_string("%d:%d:%d", "pivot", F.least("block", "other"), F.greatest("block", "other")).alias("tile"))
    out = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("inner") - 1))).select("node", F.format_string("%d:%d:main %d", "pivot", "block", "other").alias("tile"))
    inner = split.where("not rest").withColumn("block", _block("inner")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)))
    return among.unionByName(out).unionByName(inner.select("node", F.format_string("%d:%d:main %d", "pivot", "other", "block").alias("tile")))


def components(documents: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, text_key, node, component_id) for each row of ``documents``.

    Two documents link if den * |intersection| >= num * |union|.  Null and empty texts have no
    shingles, a null node and themselves as component.  Rows with a null id have the component of
    rows of the same set, if there are any, and link with nothing else.
    """
    sets = written(_sets(documents, width, num, den), "sets")
    live = written(_in_company(documents, sets, width, num, den), "company")
    texts = possibly_in(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", live).join(live, "doc_id").select("node", "text")
    drawn = written(_drawn(texts, width, num, den), "drawn")
    shown = drawn.select(F.explode("slices").alias("slice"), "node")
    pivots = shown.groupBy("slice").agg(F.min("node").alias("pivot"), F.max("node").alias("__last")).where("pivot < __last").drop("__last")
    region = written(shown.join(pivots, "slice").select("pivot", "node").distinct(), "shown")
    large = written(region.groupBy("pivot").agg(F.count("*").alias("nodes")).where(F.col("nodes") > SKETCHED), "large")
    near = _near_nodes(region.withColumnRenamed("pivot", "region").join(large.select(F.col("pivot").alias("region")), "region", "left_anti").join(drawn.select("node", "n", "sketch"), "node"), num, den)
    if not large.isEmpty():
        near = near.unionByName(_near_in_large(region.join(large, "pivot"), drawn, num, den))

    def links(tiles: DataFrame) -> DataFrame:
        members = drawn.select("node", "text").join(tiles, "node").select("tile", "node", "text")
        return written(_forests(members, width, num, den), "links")

    tiles, more = _tiles(written(near.distinct(), "regions"))
    linked = links(tiles)
    if not more.isEmpty():
        linked = linked.unionByName(links(_tiles_of_rest(more, linked)))
    classes = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    found = connected_components(linked)
    named = classes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = named.join(least, "root").select("node", "component_id")
    joined = sets.select("doc_id", "text_key", "n", "node").join(of, "node", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "text_key", "node", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``documents`` with only the least id of each component; rows equal in id and text count once.

    Rows with a null id stay, as do texts without words.
    """
    gone = components(documents, width, num, den).where("doc_id <> component_id").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    keyed = documents.withColumn("__text_key", F.xxhash64("text"))
    kept = keyed.join(gone, (F.col("doc_id") == F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left_anti")
    return kept.dropDuplicates(["doc_id", "__text_key"]).drop("__text_key")

"""Near-duplicate vectors by int8 tile products, and exact top-k inner products by MaxScore.

Both compare blocks of vectors in numpy; a task holds two blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..ship import ship
from .common import connected_components, written

#: Vectors of a block, at most: tiles of BLOCK x BLOCK products.  Fewer vectors are dealt into BLOCKS blocks of at least LEAST_BLOCK.
BLOCK, BLOCKS, LEAST_BLOCK = 8192, 8, 2048
#: Rows of a tile multiplied at once.
ROWS = 256
#: Dimensions whose int8 products add up exactly in single precision: 127 * 127 * 1024 < 2**24.
EXACT = 1024
#: Candidates of a shard, and queries taken together.
SHARD, QUERIES = 16384, 2048
#: Candidates scored together within a shard, and up to which share of them (one in so many) candidates are probed one by one.
POSTINGS, FEW = 8192, 4
#: Range of a score.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def usable(vector: str, nonzero: bool) -> Column:
    """A vector that isn't null or empty and whose components are finite (and not all zero)."""
    v = F.col(vector)
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(ok & F.exists(v, lambda x: x != 0) if nonzero else ok, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes and a scale of each unit vector, and the norm of what they leave out."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def code_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of int8 codes, exact: sums in single precision stay below 2**24."""
    if x.shape[1] <= EXACT:
        return x.astype(np.float32) @ y.astype(np.float32).T
    return sum((x[:, k : k + EXACT].astype(np.float32) @ y[:, k : k + EXACT].astype(np.float32).T).astype(np.float64) for k in range(0, x.shape[1], EXACT))


def slack(d: int) -> float:
    """More than rounding in double precision can add to an inner product of two unit vectors of d components, their norms and their errors."""
    return 16 * (d + 16) * 2.0**-53


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with cosine >= threshold: of x with y, or i < j of x with itself.

    |x.y - x'.y'| <= e_x + e_y + e_x e_y for unit vectors with quantised forms x', y' and errors of
    norms e_x, e_y; only pairs that can reach the threshold are recomputed in double precision.
    """
    unit_x, unit_y = (v if v is None else v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    (qx, sx, ex), (qy, sy, ey) = quantise(unit_x), quantise(unit_x if y is None else unit_y)
    least = threshold - slack(x.shape[1])
    left, right = [], []
    worst, scale = ey.max(), sy.astype(np.float32)
    for a in range(0, len(x), ROWS):
        b = min(len(x), a + ROWS)
        first = a if y is None else 0
        products = code_products(qx[a:b], qy[first:])
        # a first sieve in single precision, whose relative error is below 2**-20, with the worst error of y
        floor = (least - (ex[a:b] + worst + ex[a:b] * worst) - 2.0**-20) / sx[a:b]
        i, j = np.nonzero(products * scale[first:] >= floor[:, None].astype(np.float32))
        coarse = products[i, j].astype(np.float64) * sx[i + a] * sy[j + first]
        i, j = i + a, j + first
        maybe = (coarse + ex[i] + ey[j] + ex[i] * ey[j] >= least) & ((i < j) if y is None else True)
        i, j = i[maybe], j[maybe]
        for c in range(0, len(i), 1 << 15):
            p, q = i[c : c + (1 << 15)], j[c : c + (1 << 15)]
            u, v = x[p], (x if y is None else y)[q]
            cos = np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v))
            left.append(p[cos >= threshold])
            right.append(q[cos >= threshold])
    return np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])


def in_range(x: np.ndarray) -> np.ndarray:
    """Vectors of very large or small components multiplied by powers of two, so that squares neither overflow nor vanish; cosines stay."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding).

    Equal vectors are compared once and counted with their number; they are named by two 64-bit hashes.
    Null, empty, zero or non-finite vectors, and those of another length, link with nothing.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", usable("embedding", True).alias("ok"))
    name = [F.xxhash64("embedding").alias("h"), F.xxhash64(F.reverse("embedding"), F.size("embedding")).alias("g")]
    each = rows.where("ok").groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).where("node is not null")
    classes = written(each.select("*", *name), "classes")
    n = classes.count()
    blocks = max(1, math.ceil(n / (block or min(BLOCK, max(LEAST_BLOCK, math.ceil(n / BLOCKS))))))
    dealt = classes.withColumn("block", F.pmod(F.xxhash64("node", "h"), F.lit(blocks)).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.size("embedding").alias("d"), "block", "node", "copies", "embedding")

    def links(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        table = table.take(pa.array(np.lexsort((table["node"].to_numpy(), table["block"].to_numpy() != i))))
        x, nodes, copies = in_range(matrix(table["embedding"])), table["node"].to_numpy(), table["copies"].to_numpy()
        cut = int((table["block"].to_numpy() == i).sum())
        if i == j:
            a, b = tile_links(x, None, threshold)
        else:
            a, b = tile_links(x[:cut], x[cut:], threshold) if 0 < cut < len(x) else (np.zeros(0, np.int64),) * 2
            b = b + cut
        count = np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
        order = np.argsort(nodes, kind="stable")
        rank = np.empty(len(x), np.int64)
        rank[order] = np.arange(len(x))
        root, a, b = np.arange(len(x)), rank[a], rank[b]
        while len(a):
            low = np.minimum(root[a], root[b])
            if (low == root[a]).all() and (low == root[b]).all():
                break
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
        some = np.flatnonzero(count)
        return pa.table({"node": nodes[some], "links": count[some].astype(np.int64), "root": nodes[order[root[rank[some]]]]})

    found = tiles.groupBy("i", "j", "d").applyInArrow(links, "node long, links long, root long")
    found = written(found, "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("root").alias("a"), F.col("node").alias("b")))
    of = classes.join(counts, "node", "left").join(roots, "node", "left").select("h", "g", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    named = rows.select("vec_id", *(F.when(F.col("ok"), c).alias(k) for c, k in zip(name, "hg", strict=True)))
    out = named.join(of, ["h", "g"], "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def best_first(score: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores with their places, ties to smaller places."""
    if len(score) > 4 * k:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        score, at = score[keep], at[keep]
    top = np.lexsort((at, -score))[:k]
    return score[top], at[top]


def max_score(queries: np.ndarray, own: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(scores, places) of the k best of each query among candidates in order of their ids; whole numbers whose products fit in a double.

    A dimension is a term; its postings are the candidates' components.  A term's bound is the
    most that its product can be in these postings.  Terms go by the spread of their postings, least first; the
    first of them are non-essential as long as all of them together can't lift the least
    possible score over the k-th best so far.  Essential postings are traversed; the others are
    probed for candidates that can still compete.  Scores below a query's floor needn't be found.
    """
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    kind = np.float32 if largest < 2**24 else np.float64
    parts, out = [], []
    for a in range(0, len(candidates), POSTINGS):
        part = candidates[a : a + POSTINGS]
        low, high = part.min(0), part.max(0)
        terms = np.argsort(high - low, kind="stable")
        parts.append((a, terms, np.ascontiguousarray(part.T[terms].astype(kind)), low[terms].astype(kind), high[terms].astype(kind)))
    for n, whole_query in enumerate(queries.astype(kind)):
        best, where = np.zeros(0, kind), np.zeros(0, np.int64)
        for a, terms, postings, low, high in parts:
            q = whole_query[terms]
            bound, least = np.maximum(q * low, q * high), np.minimum(q * low, q * high)
            # a candidate with the floor's score may still tie; one that only ties with the k-th here has a larger id
            floor = max(float(floors[n]) - 0.5, float(best[-1]) if len(best) == k else -np.inf)
            reach = least.sum(dtype=np.float64) + np.cumsum(bound - least, dtype=np.float64)
            cut = int(np.searchsorted(reach, floor, "right"))  # these terms alone lift no candidate over the floor
            if cut == len(q):
                continue
            score = q[cut:] @ postings[cut:]
            live = np.flatnonzero(score + bound[:cut].sum() > floor)
            if len(live) * FEW < len(score):
                score = score[live] + q[:cut] @ postings[:cut, live]
            else:
                live, score = np.arange(len(score)), score + q[:cut] @ postings[:cut]
            more = np.flatnonzero(score > floor)
            more = more[ids[live[more] + a] != own[n]]
            best, where = best_first(np.concatenate([best, score[more]]), np.concatenate([where, live[more] + a]), k)
        out.append((best, where))
    return out


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly for large x too."""
    return math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale


def shifted(x: np.ndarray, scale: int) -> tuple[np.ndarray, int]:
    """floor(scale * x) times two to minus a shift, as doubles of at most 2**500."""
    shift = max(0, int(np.frexp(np.abs(x).max(initial=0))[1]) - 480)
    large = np.abs(x) >= 2.0**53
    return np.where(large, np.ldexp(x, -shift) * scale, np.ldexp(np.floor(np.where(large, 0, x) * scale), -shift)), shift


def large_scores(q: np.ndarray, candidates: np.ndarray, other: np.ndarray, k: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, places) of the k best of a query among the candidates flagged ``other``, where products may be too large for a double.

    Products in double precision with a bound on their error choose whom integers must decide.
    """
    place = np.flatnonzero(other)
    if not len(place):
        return np.zeros(0, object), place
    (u, a), (v, b) = shifted(q, scale), shifted(candidates[place], scale)
    near = v @ u
    error = (np.abs(v) @ np.abs(u)) * ((len(q) + 8) * 2.0**-52) + len(q) * 2.0**-1000
    floor = np.partition(near - error, len(near) - k)[len(near) - k] if len(near) > k else -np.inf
    edge = math.ldexp(1.0, max(-1070, 62 - a - b))  # scores beyond it may be cut to the range, and tie
    floor = -np.inf if floor < -edge else min(floor, edge)
    some = place[near + error >= floor]
    mine = [whole(x, scale) for x in q.tolist()]
    score = np.array([min(max(sum(x * whole(y, scale) for x, y in zip(mine, c, strict=True)), LOWEST), HIGHEST) for c in candidates[some].tolist()], object)
    top = np.lexsort((some, -score))[:k]
    return score[top], some[top]


def top_k_block(queries: np.ndarray, own: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int, scale: int = 1, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate index, score) of the k best of each query in one shard; components become floor(scale * x).

    Vectors whose products a double holds exactly go by max_score(), the others by large_scores().  Ties go to the smaller id.
    """
    order = np.argsort(ids, kind="stable")
    candidates, ids = candidates[order], ids[order]
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    limit = math.sqrt(2.0**52 / max(1, queries.shape[1])) / scale
    big_q, big_c = (np.abs(v).max(1, initial=0) >= limit for v in (queries, candidates))
    small = np.flatnonzero(~big_c)
    out = ([], [], [])
    found = dict(zip(np.flatnonzero(~big_q).tolist(), max_score(np.floor(scale * queries[~big_q]), own[~big_q], np.floor(scale * candidates[small]), ids[small], k, floors[~big_q]), strict=True))
    for n in range(len(queries)):
        score, at = found.get(n, (np.zeros(0), np.zeros(0, np.int64)))
        at = small[at]
        if big_q[n] or big_c.any():
            more, where = large_scores(queries[n], candidates, (ids != own[n]) & (big_c | big_q[n]), k, scale)
            score, at = np.concatenate([np.array([int(x) for x in score], object), more]), np.concatenate([at, where])
            top = np.lexsort((at, -score))[:k]
            score, at = score[top], at[top]
        out[0].append(np.full(len(at), n))
        out[1].append(order[at])
        out[2].append(score.astype(np.int64))
    return tuple(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in out)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k largest integer inner products with other ids.

    Components become floor(scale * x).  Scores beyond the range of a long are cut to it, and tie there.
    Vectors that are null, empty or hold null or non-finite components take no part; vectors of another length
    than the query's aren't compared.  Repeated candidate rows count once each.

    A query's k-th score in the first shard is its floor in all others.
    """
    ship(vectors.sparkSession)
    rows = vectors.where(usable("embedding", False) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("is_query"))
    shards, groups = (max(1, math.ceil(n / m)) for n, m in zip(rows.agg(F.count("*"), F.count_if("is_query")).first(), (shard, QUERIES), strict=True))
    spread = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    d = F.size("embedding").alias("d")
    cand = rows.select(spread[0].alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), d, F.lit(None).cast("double").alias("floor"), F.lit(False).alias("is_query"), "vec_id", "embedding")
    asked = rows.where("is_query").dropDuplicates(["vec_id", "embedding"]).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), spread[1].alias("part"), d, F.lit(None).cast("double").alias("floor"), F.lit(True).alias("is_query"), "vec_id", "embedding")

    def best(table: pa.Table) -> pa.Table:
        flag = table["is_query"].to_numpy()
        q, c = np.flatnonzero(flag), np.flatnonzero(~flag)
        ids = table["vec_id"].to_numpy()
        if not len(q) or not len(c):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        x, floor = matrix(table["embedding"]), table["floor"].fill_null(-np.inf).to_numpy()
        a, b, s = top_k_block(x[q], ids[q], x[c], ids[c], k, scale, floor[q])
        return pa.table({"query_id": ids[q][a], "vec_id": ids[c][b], "score": s})

    def searched(cand: DataFrame, asked: DataFrame) -> DataFrame:
        return cand.unionByName(asked).groupBy("shard", "part", "d").applyInArrow(best, "query_id long, vec_id long, score long")

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if shards == 1:
        found = searched(cand, asked)
    else:
        first = written(searched(cand.where("shard = 0"), asked.where("shard = 0")), "first")
        # double of a long may be rounded up, so the floor is put a little lower
        ranked = first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), (F.col("score") - F.abs("score") * 2.0**-50).alias("k_th"))
        known = asked.where("shard > 0").join(ranked, "vec_id", "left").withColumn("floor", F.col("k_th")).select(*cand.columns)
        found = first.unionByName(searched(cand.where("shard > 0"), known))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

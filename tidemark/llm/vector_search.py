"""Operator 4: exact top-k by integer inner product.

Components are scaled and floored to integers. Vectors are turned to the principal axes
of a sample, which keeps distances, and cut into segments at several resolutions: a
segment keeps its mean and its deviation (the norm of what the mean leaves), and the sum
over segments of ``length * (mean difference)^2 + (deviation difference)^2`` never exceeds
the squared distance of two vectors. With the norms this bounds the inner product from
above. The search goes coarse to fine: pairs whose bound at a level is under the k-th
exact score found so far go, a finer level looks at the pairs left alone, and those that
the finest leaves get exact scores, pair by pair. The axes put the vectors' spread into
the first segments, which the finer levels split down to single coordinates.

Queries and candidates meet in tiles of bounded size (``query_tile`` by
``candidate_tile`` rows), each pair of tiles once, keyed and shuffled by Spark; a tile
returns at most k rows a query and a last window merges those.

Defined cases: a null vec_id, a null vector and one with a null or non-finite component
take no part; vectors of unequal length are not compared; rows with the query's own
vec_id are the query; ties go to the smaller vec_id; repeated rows are candidates each;
an empty table gives an empty result; scores beyond a long are cut to its range; columns
of the input beside the id and the vector are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: By level, coarse to fine: the share of the coordinates that are segments of their own, and the longest segment of the rest.
LEVELS = ((0.0, 16), (0.25, 8), (0.625, 4), (0.8125, 4))
SCHEMA = "query_id long, vec_id long, score long"


def integers(rows: pa.Table | pa.RecordBatch, scale: float) -> np.ndarray:
    """floor(scale * x) of a list column, a row a vector."""
    flat = rows.column("vector").combine_chunks() if isinstance(rows, pa.Table) else rows.column("vector")
    return np.floor(scale * flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(flat), -1)


def principal_axes(x: np.ndarray) -> np.ndarray:
    """An orthonormal basis, a column an axis, the axis of the greatest spread first."""
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


def segment_edges(dim: int, level: tuple[float, int]) -> np.ndarray:
    """Where the segments of a level begin, and the end: short ones first, at most twice as long as all before."""
    single, longest = int(dim * level[0]), level[1]
    edges = list(range(min(dim, max(1, single)) + 1))
    while edges[-1] < dim:
        edges.append(min(dim, edges[-1] + min(longest, max(1, edges[-1]))))
    return np.array(edges)


def segment_statistics(x: np.ndarray, level: tuple[float, int]) -> np.ndarray:
    """Means times the root of the segment's length, then deviations of the segments longer than one."""
    if not x.shape[1]:
        return np.zeros((len(x), 1))
    edges = segment_edges(x.shape[1], level)
    size = np.diff(edges)
    total = np.add.reduceat(x, edges[:-1], axis=1)
    squares = np.add.reduceat(x * x, edges[:-1], axis=1)
    deviation = np.sqrt(np.maximum(0, squares - total * total / size))
    return np.concatenate([total / np.sqrt(size), deviation[:, size > 1]], axis=1)


def lower_bounds(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lower bounds of all squared distances from segment statistics."""
    return (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * (q @ x.T)


def _pair_products(q: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray, part: int = 1 << 14) -> np.ndarray:
    """Inner products of the named pairs alone."""
    out = np.empty(len(rows))
    for at in range(0, len(rows), part):
        own = slice(at, at + part)
        out[own] = np.einsum("nd,nd->n", q[rows[own]], x[cols[own]])
    return out


class Tile:
    """One tile of queries against one of candidates; ``compared`` and ``survived`` count pairs and those that got exact scores."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, axes: np.ndarray | None = None):
        order = np.argsort(x_ids, kind="stable")
        self.q, self.q_ids, self.x, self.x_ids, self.k = q, q_ids, x[order], x_ids[order], k
        turned = (q, self.x) if axes is None else (q @ axes, self.x @ axes)
        self.levels = [tuple(segment_statistics(v, level) for v in turned) for level in LEVELS]
        self.qn, self.xn = (q * q).sum(axis=1), (self.x * self.x).sum(axis=1)
        # beyond this doubles could round sums of products, and scores are worked out in Python integers
        self.small = not len(q) or not len(x) or np.sqrt(self.qn.max() * self.xn.max()) < 2.0**52
        self.compared = self.survived = 0

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, candidate ids and scores of the k best candidates of each query."""
        found: list[list[np.ndarray]] = [[], [], []]
        step = max(1, (1 << 21) // max(1, len(self.x)))
        for at in range(0, len(self.q), step):
            rows, cols, score = self._block(at, min(len(self.q), at + step))
            best = np.lexsort((cols, -score, rows))  # x is in order of id
            rows, cols, score = rows[best], cols[best], score[best]
            top = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
            for out, part in zip(found, (self.q_ids[rows[top]], self.x_ids[cols[top]], score[top].astype(np.int64))):
                out.append(part)
        return tuple(np.concatenate(f) if f else np.empty(0, np.int64) for f in found)

    def _block(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Survivors of queries [start, end) with their exact scores."""
        q, qn = self.q[start:end], self.qn[start:end]
        alive = self.q_ids[start:end, None] != self.x_ids
        self.compared += int(alive.sum())
        least = np.full(len(q), -np.inf)
        levels = iter(self.levels)
        for qs, xs in levels:  # as long as most pairs are left, a product of matrices over the candidates that any query has left
            cols = np.flatnonzero(alive.any(axis=0))
            own = alive[:, cols]
            most = qs[start:end] @ xs[cols].T + self._slack(qn[:, None], self.xn[cols])
            most[~own] = -np.inf
            if self.small and len(cols) > 2 * self.k:  # exact scores of the most promising settle what to beat
                seeds = np.argpartition(-most, 2 * self.k - 1, axis=1)[:, : 2 * self.k]
                score = np.einsum("nd,nsd->ns", q, self.x[cols[seeds]])
                score[~np.take_along_axis(own, seeds, axis=1)] = -np.inf
                least = np.maximum(least, np.partition(score, -self.k, axis=1)[:, -self.k])
                own = own & (most >= least[:, None] - 1)
            alive[:, cols] = own
            if 3 * own.sum() < own.size:
                break
        rows, cols = np.nonzero(alive)
        for qs, xs in levels:  # pair by pair
            if not len(rows) or not self.small:
                break
            most = _pair_products(qs[start:end], xs, rows, cols) + self._slack(qn[rows], self.xn[cols])
            seeds = self._best(rows, most, 2 * self.k)
            score = _pair_products(q, self.x, rows[seeds], cols[seeds])
            kth = self._best(rows[seeds], score, self.k, last=True)
            least[rows[seeds[kth]]] = np.maximum(least[rows[seeds[kth]]], score[kth])
            left = most >= least[rows] - 1
            rows, cols = rows[left], cols[left]
        self.survived += len(rows)
        if self.small:
            return rows + start, cols, _pair_products(q, self.x, rows, cols)
        whole = np.vectorize(int, otypes=[object])
        score = [max(-(2**63), min(2**63 - 1, int(whole(q[r]) @ whole(self.x[c])))) for r, c in zip(rows, cols)]
        return rows + start, cols, np.array(score, np.int64)

    @staticmethod
    def _slack(qn: np.ndarray, xn: np.ndarray) -> np.ndarray:
        """What rounding may take from a bound."""
        return 1 + 1e-9 * (qn + xn)

    @staticmethod
    def _best(rows: np.ndarray, values: np.ndarray, k: int, last: bool = False) -> np.ndarray:
        """Places of each row's k highest values, or of its k-th where it has so many; rows ascend."""
        order = np.lexsort((-values, rows))
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        return np.sort(order[rank == k - 1 if last else rank < k])


def _sample_axes(rows: DataFrame, scale: float, sample: int) -> dict[int, np.ndarray]:
    """Principal axes by dimension, from at most ``sample`` rows."""
    held = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("vector").limit(sample).collect()
    by_dim: dict[int, list] = {}
    for r in held:
        by_dim.setdefault(len(r["vector"]), []).append(r["vector"])
    return {d: principal_axes(np.floor(scale * np.array(v, np.float64))) for d, v in by_dim.items() if d}


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding", query_tile: int = 8_192, candidate_tile: int = 8_192, sample: int = 2_048) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every query row.

    ``sample`` vectors, by a hash of the id, choose the axes that segments are cut along;
    whatever they are, the result is the same.
    """
    usable = F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), is_query.alias("asks"))
    counts = rows.agg(F.count("*").alias("all"), F.count_if("asks").alias("queries")).first()
    q_tiles, x_tiles = max(1, -(-counts["queries"] // query_tile)), max(1, -(-counts["all"] // candidate_tile))
    spread = F.xxhash64("vec_id")
    axes = _sample_axes(rows, scale, sample)
    tiled = rows.withColumn("dim", F.size("vector"))
    asking = tiled.where("asks").select("vec_id", "vector", "dim", F.lit(True).alias("asks"), F.pmod(spread, F.lit(q_tiles)).alias("qt"), F.explode(F.expr(f"sequence(0L, {x_tiles - 1}L)")).alias("xt"))
    asked = tiled.select("vec_id", "vector", "dim", F.lit(False).alias("asks"), F.explode(F.expr(f"sequence(0L, {q_tiles - 1}L)")).alias("qt"), F.pmod(spread, F.lit(x_tiles)).alias("xt"))

    def tile(t: pa.Table) -> pa.Table:
        mask = t.column("asks")
        q, x = t.filter(mask), t.filter(pc.invert(mask))
        if not len(q) or not len(x):
            return pa.table([pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])
        q_rows, x_rows = integers(q, scale), integers(x, scale)
        found = Tile(q_rows, q.column("vec_id").to_numpy(), x_rows, x.column("vec_id").to_numpy(), k, axes.get(x_rows.shape[1])).top()
        return pa.table([pa.array(f, pa.int64()) for f in found], names=["query_id", "vec_id", "score"])

    tiles = asking.unionByName(asked).repartition(q_tiles * x_tiles, "dim", "qt", "xt")
    best = tiles.groupBy("dim", "qt", "xt").applyInArrow(tile, SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

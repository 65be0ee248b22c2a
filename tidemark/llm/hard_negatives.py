"""Operator 13: hard negatives by dual-tree search.

Components are scaled and floored to integers. Candidates and anchors are each dealt to the
leaves of a tree whose splits come from a bounded sample; a node keeps the centre and the
radius of all its rows and their largest norm, so the inner products of two nodes lie in
an interval. Tree against tree, pairs of nodes whose interval can't hold what any anchor
below still needs are dropped at once, and only rows of the pairs of leaves that are left
meet. Where they meet, the rows of each label form trees of their own down to a few
rows, searched in the same way, best interval first; leaf pairs are scored exactly.

Two searches: the first finds each anchor's positives, rows of its label; the second finds,
for each anchor and positive, the best rows of other labels in the band that the
positive's score sets. Each begins with the leaf that promises most for a group of anchors,
whose exact scores set what the others must reach.

Leaves are cut into blocks of at most ``candidate_tile`` rows (anchors: ``anchor_tile``), so
a vector that repeats a million times fills many tasks; Spark deals pairs of blocks.

Defined cases: rows with a null vec_id or label, a null vector, or a null component or one
that isn't finite when scaled take no part; vectors of unequal length are not compared; rows with an anchor's
own vec_id are neither its positives nor its negatives; of anchor rows that repeat a vec_id
the least by label and vector counts; repeated rows are candidates each; ties go to the
smaller vec_id; a band without rows gives none, so a negative positive score gives none; an
empty table gives an empty result; scores beyond a long are cut to its range; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vector_search import integers

#: Below any score.
NONE = -(1 << 63)


@dataclass(frozen=True)
class MineSpec:
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: float = 256.0
    sample: int = 4_096
    most_leaves: int = 256
    anchor_tile: int = 4_096
    candidate_tile: int = 8_192
    anchor_leaf: int = 32
    candidate_leaf: int = 128


# Trees -------------------------------------------------------------------------------------


class Tree:
    """Nodes in heap order over ``leaves`` leaves (a power of two): splits by a direction and a cut, centres, radii and norms."""

    def __init__(self, sample: np.ndarray, leaves: int):
        dim = sample.shape[1]
        self.leaves = leaves
        self.directions, self.cuts = np.zeros((leaves, dim)), np.zeros(leaves)
        self.centres = np.zeros((2 * leaves, dim))
        self.radii, self.norms, self.rows = np.zeros(2 * leaves), np.zeros(2 * leaves), np.zeros(2 * leaves, np.int64)
        below = {1: sample}
        for node in range(1, 2 * leaves):
            own = below.pop(node)
            self.centres[node] = own.mean(axis=0) if len(own) else self.centres[node // 2]
            if node < leaves:
                spread = own - self.centres[node]
                if len(own) > 1:
                    self.directions[node] = np.linalg.eigh(spread.T @ spread)[1][:, -1]
                along = own @ self.directions[node]
                self.cuts[node] = np.median(along) if len(own) else 0.0
                low = along < self.cuts[node]
                below[2 * node], below[2 * node + 1] = own[low], own[~low]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        while self.leaves > 1 and len(x) and node[0] < self.leaves:
            node = 2 * node + (np.einsum("nd,nd->n", x, self.directions[node]) >= self.cuts[node])
        return node

    def statistics(self, x: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By level: nodes, their rows, largest distance to the centre and largest norm."""
        node, norm = leaf.copy(), np.sqrt((x * x).sum(axis=1))
        while len(node) and node[0]:
            far = np.sqrt(((x - self.centres[node]) ** 2).sum(axis=1))
            own, at = np.unique(node, return_inverse=True)
            most = np.zeros((2, len(own)))
            np.maximum.at(most[0], at, far)
            np.maximum.at(most[1], at, norm)
            yield own, np.bincount(at), *most
            node = node // 2


def intervals(centres: np.ndarray, radii: np.ndarray, norms: np.ndarray, others: np.ndarray, other_radii: np.ndarray, other_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of any two rows of two nodes, for all pairs of nodes; widened for rounding."""
    middle = centres @ others.T
    size, other_size = np.sqrt((centres**2).sum(axis=1)), np.sqrt((others**2).sum(axis=1))
    reach = np.outer(size, other_radii) + np.outer(radii, other_size) + np.outer(radii, other_radii)
    most = np.outer(norms, other_norms)
    slack = 1 + 1e-9 * (most + reach)
    return np.maximum(middle - reach, -most) - slack, np.minimum(middle + reach, most) + slack


def descend(low: np.ndarray, high: np.ndarray, children: tuple[list, list], root: tuple[int, int], needed: Callable[[int, float, float], bool]) -> Iterator[tuple[int, int]]:
    """Pairs of leaves of two trees, the highest interval first, but for pairs of nodes that ``needed`` (the first's node, interval) turns down.

    ``children``: for each tree, each node's two children or None.
    """
    stack = [root]
    while stack:
        a, b = stack.pop()
        if not needed(a, low[a, b], high[a, b]):
            continue
        ca, cb = children[0][a], children[1][b]
        if ca is None and cb is None:
            yield a, b
        elif cb is not None:  # candidates first: their nodes are the larger
            stack += sorted(((a, c) for c in cb), key=lambda p: high[p])
        else:
            stack += sorted(((c, b) for c in ca), key=lambda p: high[p])


# What anchors need ---------------------------------------------------------------------------


class Wanted:
    """The best ``k`` so far of each band of each anchor; bands are [low, high] of scores."""

    def __init__(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, k: int):
        self.low, self.high, self.least, self.k = low, high, least, k  # [anchors, bands]; least: what the k-th reaches at least
        self.best = np.full((*low.shape, k), NONE, np.int64)
        self.found: list[tuple[np.ndarray, ...]] = []

    def floor(self, rows: np.ndarray | slice) -> np.ndarray:
        return np.maximum(self.low[rows], self.least[rows])

    def take(self, rows: slice, ids: np.ndarray, score: np.ndarray, own: np.ndarray) -> None:
        """Exact scores of anchors ``rows`` with candidates ``ids``; not where ``own``."""
        for j in range(self.low.shape[1]):
            fits = (score >= self.floor(rows)[:, j, None]) & (score <= self.high[rows][:, j, None]) & ~own
            at = np.flatnonzero(fits.any(axis=1))
            if not len(at):
                continue
            held = np.where(fits[at], score[at], NONE)
            mine = np.concatenate([self.best[rows][at, j], held], axis=1)
            top = np.partition(mine, mine.shape[1] - self.k, axis=1)[:, -self.k :]
            self.best[rows.start + at, j] = top
            self.least[rows.start + at, j] = np.maximum(self.least[rows.start + at, j], top.min(axis=1))
            a, c = np.nonzero(held >= np.maximum(self.floor(rows)[at, j], NONE + 1)[:, None])
            self.found.append((rows.start + at[a], np.full(len(a), j), ids[c], held[a, c]))

    def result(self) -> tuple[np.ndarray, ...]:
        """anchor, band, id, score of the k best of each band."""
        if not self.found:
            return tuple(np.empty(0, np.int64) for _ in range(4))
        a, j, ids, score = (np.concatenate(c) for c in zip(*self.found))
        left = score >= self.least[a, j]
        a, j, ids, score = a[left], j[left], ids[left], score[left]
        order = np.lexsort((ids, -score, j, a))
        a, j, ids, score = a[order], j[order], ids[order], score[order]
        band = a * self.low.shape[1] + j
        top = np.arange(len(band)) - np.searchsorted(band, band) < self.k
        return a[top], j[top], ids[top], score[top]


class Local:
    """Trees over the rows of one task, one for each label: rows in the order of the leaves, nodes as ranges of rows."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, leaf: int):
        self.order = np.argsort(labels, kind="stable")
        sorted_labels = labels[self.order]
        self.ranges: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        self.roots: dict[int, int] = {}
        ends = [*np.flatnonzero(np.diff(sorted_labels, prepend=sorted_labels[:1] - 1)), len(labels)]
        for s, e in zip(ends[:-1], ends[1:]):
            self.roots[int(sorted_labels[s])] = self._node(x, s, e, leaf)
        self.x = x[self.order]
        norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.centres = np.array([self.x[s:e].mean(axis=0) for s, e in self.ranges]).reshape(len(self.ranges), x.shape[1])
        self.radii = np.array([np.sqrt(((self.x[s:e] - c) ** 2).sum(axis=1).max()) for (s, e), c in zip(self.ranges, self.centres)])
        self.norms = np.array([norm[s:e].max() for s, e in self.ranges])

    def _node(self, x: np.ndarray, s: int, e: int, leaf: int) -> int:
        node = len(self.ranges)
        self.ranges.append((s, e))
        self.children.append(None)
        if e - s > leaf:
            own = x[self.order[s:e]]
            half = (e - s) // 2
            widest = int(own.var(axis=0).argmax()) if x.shape[1] else 0
            if x.shape[1]:
                self.order[s:e] = self.order[s:e][np.argpartition(own[:, widest], half)]
            self.children[node] = (self._node(x, s, s + half, leaf), self._node(x, s + half, e, leaf))
        return node


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as longs: exact, and cut to a long's range where they pass it."""
    if not q.size or not x.size or np.sqrt((q * q).sum(axis=1).max()) * np.sqrt((x * x).sum(axis=1).max()) < 2.0**52:
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q) @ whole(x).T, NONE + 1, 2**63 - 1).astype(np.int64)


def search(anchors: Local, ids: np.ndarray, candidates: Local, candidate_ids: np.ndarray, wanted: Wanted, same: bool) -> int:
    """Fill ``wanted`` (in the order of ``anchors``) from the trees of equal (or of other) labels; how many pairs were scored."""
    low, high = intervals(anchors.centres, anchors.radii, anchors.norms, candidates.centres, candidates.radii, candidates.norms)
    scored = 0

    def needed(a: int, least: float, most: float) -> bool:
        rows = slice(*anchors.ranges[a])
        return bool(((wanted.floor(rows) <= most) & (wanted.high[rows] >= least)).any())

    pairs = [(a, c) for la, a in anchors.roots.items() for lc, c in candidates.roots.items() if (la == lc) == same]
    for root in sorted(pairs, key=lambda p: -high[p]):
        for a, c in descend(low, high, (anchors.children, candidates.children), root, needed):
            rows, s, e = slice(*anchors.ranges[a]), *candidates.ranges[c]
            wanted.take(rows, candidate_ids[s:e], exact_products(anchors.x[rows], candidates.x[s:e]), ids[rows, None] == candidate_ids[s:e])
            scored += (rows.stop - rows.start) * (e - s)
    return scored


# On Spark ------------------------------------------------------------------------------------


def _usable(vectors: DataFrame, vec_id: str, vector: str, label: Column, scale: float) -> DataFrame:
    good = F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & label.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) * scale < float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).alias("vector"), F.size(vector).alias("dim"))


def _trees(rows: DataFrame, tile: int, spec: MineSpec) -> dict[int, Tree]:
    """A tree a dimension, of as many leaves as tiles are filled (at most ``most_leaves``), from at most ``sample`` rows."""
    counts = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(64).collect()}
    held = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("vector", "dim").limit(spec.sample).collect()
    out = {}
    for dim in {r["dim"] for r in held if r["dim"]}:
        sample = np.floor(spec.scale * np.array([r["vector"] for r in held if r["dim"] == dim], np.float64))
        leaves = min(spec.most_leaves, 1 << max(0, -(-counts.get(dim, 1) // tile) - 1).bit_length())
        out[dim] = Tree(sample, leaves)
    return out


def _routed(rows: DataFrame, trees: dict[int, Tree], spec: MineSpec) -> DataFrame:
    """Rows with their leaf, the root where no tree was made; written, so that later reads agree with the statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            leaf = np.ones(len(dims), np.int64)
            for dim in np.unique(dims):
                if (tree := trees.get(int(dim))) is not None:
                    at = np.flatnonzero(dims == dim)
                    leaf[at] = tree.leaf(integers(b.take(pa.array(at)), spec.scale))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=[*b.schema.names, "leaf"])

    return rows.mapInArrow(run, f"{rows._jdf.schema().toDDL()}, leaf long")


def _measure(routed: DataFrame, trees: dict[int, Tree], spec: MineSpec) -> None:
    """Give the trees' nodes the rows, radii and norms of all rows; at most two rows a leaf reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                if (tree := trees.get(int(dim))) is not None:
                    own = b.take(pa.array(np.flatnonzero(dims == dim)))
                    for node, rows, far, norm in tree.statistics(integers(own, spec.scale), own.column("leaf").to_numpy()):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), dim, np.int32)), pa.array(node), pa.array(rows), pa.array(far), pa.array(norm)], names=["dim", "node", "n", "far", "norm"])

    parts = routed.select("vector", "dim", "leaf").mapInArrow(run, "dim int, node long, n long, far double, norm double")
    for r in parts.groupBy("dim", "node").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect():
        tree, node = trees[r["dim"]], r["node"]
        tree.rows[node], tree.radii[node], tree.norms[node] = r["n"], r["far"], r["norm"]


def _leaf_pairs(anchors: dict[int, Tree], candidates: dict[int, Tree], need: dict[tuple[int, int], tuple[float, float]] | None) -> list[tuple[int, int, int]]:
    """dim, anchor leaf and candidate leaf that must meet: for each anchor leaf the most promising one where ``need`` is None, else all whose interval meets it.

    ``need``: for each anchor leaf the least that any of its anchors needs and the most it can use.
    """
    out = []
    for dim in anchors.keys() & candidates.keys():
        a, c = anchors[dim], candidates[dim]
        low, high = intervals(a.centres, a.radii, a.norms, c.centres, c.radii, c.norms)
        if need is None:
            for leaf in np.flatnonzero(a.rows[a.leaves :]) + a.leaves:
                full = np.flatnonzero(c.rows[c.leaves :]) + c.leaves
                if len(full):
                    out.append((dim, int(leaf), int(full[(a.centres[leaf] @ c.centres[full].T).argmax()])))
            continue
        floor, ceil = np.full(2 * a.leaves, np.inf), np.full(2 * a.leaves, -np.inf)
        for (d, leaf), (least, most) in need.items():
            if d == dim:
                floor[leaf], ceil[leaf] = least, most
        for node in range(a.leaves - 1, 0, -1):
            floor[node], ceil[node] = min(floor[2 * node : 2 * node + 2]), max(ceil[2 * node : 2 * node + 2])
        children = tuple([None, *((2 * n, 2 * n + 1) if n < t.leaves else None for n in range(1, 2 * t.leaves))] for t in (a, c))
        c_empty = c.rows == 0
        for x, y in descend(low, high, children, (1, 1), lambda n, least, most: floor[n] <= most and ceil[n] >= least):
            if not c_empty[y]:
                out.append((dim, x, y))
    return out


_BANDS = "lows array<long>, highs array<long>, leasts array<long>"
_FOUND = "anchor_id long, band int, vec_id long, score long"


def _meet(anchors: DataFrame, candidates: DataFrame, pairs: list[tuple[int, int, int]], trees: tuple[dict[int, Tree], dict[int, Tree]], k: int, same: bool, spec: MineSpec) -> DataFrame:
    """anchor_id, band, vec_id, score: the k best of each pair of blocks for each anchor's bands."""
    spark = anchors.sparkSession
    tiles = [(d, a, c, -(-int(trees[0][d].rows[a]) // spec.anchor_tile), -(-int(trees[1][d].rows[c]) // spec.candidate_tile)) for d, a, c in pairs]
    plan = spark.createDataFrame(tiles, "dim int, a long, c long, a_blocks long, c_blocks long")
    deal = F.xxhash64("vec_id", "vector")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asking = anchors.join(plan.withColumnRenamed("a", "leaf"), ["dim", "leaf"]).withColumn("a_block", F.pmod(deal, F.col("a_blocks"))).withColumn("c_block", every("c_blocks")).withColumnRenamed("leaf", "a")
    asked = candidates.join(plan.withColumnRenamed("c", "leaf"), ["dim", "leaf"]).withColumn("c_block", F.pmod(deal, F.col("c_blocks"))).withColumn("a_block", every("a_blocks")).withColumnRenamed("leaf", "c")
    keys = ["dim", "a", "c", "a_block", "c_block"]
    none = F.lit(None).cast("array<long>")
    both = asking.select(*keys, "vec_id", "label", "vector", "lows", "highs", "leasts", F.lit(True).alias("asks"))
    both = both.unionByName(asked.select(*keys, "vec_id", "label", "vector", none.alias("lows"), none.alias("highs"), none.alias("leasts"), F.lit(False).alias("asks")))

    def tile(t: pa.Table) -> pa.Table:
        mask = t.column("asks").to_numpy()
        q, x = t.filter(pa.array(mask)), t.filter(pa.array(~mask))
        if not len(q) or not len(x):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())], names=["anchor_id", "band", "vec_id", "score"])
        own = Local(integers(q, spec.scale), q.column("label").to_numpy(), spec.anchor_leaf)
        others = Local(integers(x, spec.scale), x.column("label").to_numpy(), spec.candidate_leaf)
        ids = q.column("vec_id").to_numpy()[own.order]
        low, high, least = (q.column(c).combine_chunks().flatten().to_numpy().reshape(len(q), -1)[own.order] for c in ("lows", "highs", "leasts"))
        wanted = Wanted(low, high, least.copy(), k)
        search(own, ids, others, x.column("vec_id").to_numpy()[others.order], wanted, same)
        a, j, found, score = wanted.result()
        return pa.table([pa.array(ids[a]), pa.array(j.astype(np.int32)), pa.array(found), pa.array(score)], names=["anchor_id", "band", "vec_id", "score"])

    return both.groupBy(*keys).applyInArrow(tile, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _searched(anchors: DataFrame, candidates: DataFrame, trees: tuple[dict[int, Tree], dict[int, Tree]], k: int, same: bool, spec: MineSpec) -> DataFrame:
    """anchor_id, band, vec_id, score, rank: the k best of each band, seeds first and then what they leave open."""
    seeds = _leaf_pairs(*trees, None)
    first = stored(_ranked(_meet(anchors, candidates, seeds, trees, k, same, spec), k), "mined-seeds")
    kth = first.where(F.col("rank") == k).groupBy("anchor_id", "band").agg(F.max("score").alias("kth"))
    by_band = kth.groupBy("anchor_id").agg(F.map_from_arrays(F.collect_list("band"), F.collect_list("kth")).alias("kths"))  # a band each
    raised = F.transform("leasts", lambda least, j: F.coalesce(F.try_element_at("kths", j.cast("int")), least))
    told = anchors.join(by_band, anchors["vec_id"] == by_band["anchor_id"], "left").withColumn("leasts", raised).drop("anchor_id", "kths")
    told = stored(told, "mined-anchors")
    floors = told.select("dim", "leaf", F.explode(F.zip_with(F.arrays_zip("lows", "leasts"), "highs", lambda b, high: F.struct(F.greatest(b["lows"], b["leasts"]).alias("low"), high.alias("high")))).alias("b")).where("b.low <= b.high")
    need = {(r["dim"], r["leaf"]): (r["low"], r["high"]) for r in floors.groupBy("dim", "leaf").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high")).collect()}
    rest = sorted(set(_leaf_pairs(*trees, need)) - set(seeds))
    if not rest:
        return first
    more = _meet(told, candidates, rest, trees, k, same, spec)
    return _ranked(first.drop("rank").unionByName(more), k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, spec: MineSpec = MineSpec(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Each anchor's positives are its ``positives`` best rows of the same label; for each
    of them the ``negatives`` best rows of other labels with ``low`` to ``high`` hundredths
    of its score.
    """
    rows = _usable(vectors, vec_id, vector, label, spec.scale)
    chosen = _usable(vectors.where(is_anchor), vec_id, vector, label, spec.scale).groupBy("vec_id").agg(F.min(F.struct("label", "vector", "dim")).alias("r")).select("vec_id", "r.*")
    trees = _trees(chosen, spec.anchor_tile, spec), _trees(rows, spec.candidate_tile, spec)
    anchors, candidates = (stored(_routed(d, t, spec), n) for d, t, n in ((chosen, trees[0], "anchors"), (rows, trees[1], "candidates")))
    for routed, tree in zip((anchors, candidates), trees):
        _measure(routed, tree, spec)
    longs = lambda *v: F.array(*(F.lit(x).cast("long") for x in v))
    open_ = anchors.withColumns({"lows": longs(NONE), "highs": longs((1 << 63) - 1), "leasts": longs(NONE)})
    near = stored(_searched(open_, candidates, trees, spec.positives, True, spec), "positives")
    by_anchor = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))  # ``positives`` at most
    score = lambda p: p["score"].cast("decimal(20,0)")
    lows = F.transform("p", lambda p: F.ceil(score(p) * spec.low / F.lit(100)).cast("long"))
    highs = F.transform("p", lambda p: F.floor(score(p) * spec.high / F.lit(100)).cast("long"))
    banded = anchors.join(by_anchor, anchors["vec_id"] == by_anchor["anchor_id"]).withColumns({"lows": lows, "highs": highs, "leasts": F.transform("p", lambda p: F.lit(NONE).cast("long"))})
    # a leaf's anchors have as many bands each: those with fewer positives get bands that nothing fits
    pad = lambda c, v: F.slice(F.concat(c, F.array_repeat(F.lit(v).cast("long"), spec.positives)), 1, spec.positives)
    padded = banded.withColumns({"lows": pad("lows", 1), "highs": pad("highs", 0), "leasts": pad("leasts", NONE)}).drop("p", "anchor_id")
    found = _searched(padded, candidates, trees, spec.negatives, False, spec)
    positives = near.select("anchor_id", (F.col("rank") - 1).alias("band"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = found.join(positives, ["anchor_id", "band"])
    return joined.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

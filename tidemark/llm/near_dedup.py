"""Operator 10: near duplicates by MinHash with one permutation.

A document's set is its distinct word shingles. Documents with equal sets form a class,
represented by its smallest doc_id; only classes go on. One hash permutation splits a
set into bins, each bin keeps its smallest hash, and empty bins borrow from others in a
fixed random order (optimal densification). Bands of bins give bucket keys. A bucket
links its smallest class to each other one, a star, so candidate pairs grow with the
rows and never with the square of a bucket. Every edge is confirmed on the full sets.

A star compares no two classes but with its centre. Where a bucket then still holds
classes of different components, they meet too: of a bucket with at most ``pairs`` classes
each pair of different components is confirmed; the classes of larger ones form clusters
whose chunks of bounded size are compared, pair of chunks by pair of chunks and only
those whose set sizes allow a link and whose classes aren't of one component, and return
the edges that join components. So any two classes that share a bucket are in one
component or have been compared. No bucket, bin or cluster is capped.

Shingle hashes have 64 bits. Bands of 8 of 320 bins find a pair at similarity 0.85 with
probability above 0.99999; a pair that shares no bucket is not found.

Defined cases: a null text and one without words have the empty set and link with
nothing, fewer words than a shingle form one shingle; rows with a null doc_id are
dropped; rows that repeat a doc_id give one result, of one of their texts; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STORED, arrow_map, discard, release_shuffles, split_words, stored, whole_texts
from .graph import components


@dataclass(frozen=True)
class NearSpec:
    words: int = 3
    percent: int = 85
    bands: int = 40
    rows: int = 8
    pairs: int = 32
    chunk: int = 400
    chunk_shingles: int = 400_000
    seed: int = 11

    @property
    def bins(self) -> int:
        return self.bands * self.rows

    @cached_property
    def borrow(self) -> np.ndarray:
        """For each bin the order in which it tries others: [bins, bins]."""
        random = np.random.default_rng(self.seed)
        return np.argsort(random.random((self.bins, self.bins)), axis=1).astype(np.int32)

    @cached_property
    def mixers(self) -> np.ndarray:
        return np.random.default_rng(self.seed + 1).integers(0, 1 << 63, self.bins, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (constants of the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of whole texts."""

    def __init__(self, spec: NearSpec):
        self.spec = spec

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        import xxhash

        k = self.spec.words
        words, numbers, ends = split_words(texts, None)
        # bytes.lower() lowers A-Z alone; words that differ in case get equal hashes
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode().lower()) for w in words), np.uint64, len(words))[numbers]
        run = np.zeros(len(hashes), np.uint64)  # the hash of the k words that begin here
        for i in range(min(k, len(hashes))):
            run[: len(hashes) - i] = mix(run[: len(hashes) - i] * np.uint64(0x9E3779B97F4A7C15) + hashes[i:])
        out = []
        for a, b in zip(ends[:-1], ends[1:]):
            if b - a >= k:
                out.append(np.unique(run[a : b - k + 1]))
            elif b > a:
                short = np.array([b - a], np.uint64)
                for h in hashes[a:b]:
                    short = mix(short * np.uint64(0xD1B54A32D192ED03) + h)
                out.append(short)
            else:
                out.append(np.empty(0, np.uint64))
        return out


def signature(own: np.ndarray, spec: NearSpec) -> np.ndarray:
    """One value a bin: the smallest hash in it, or what a full bin lends."""
    at = (own >> np.uint64(32)) * np.uint64(spec.bins) >> np.uint64(32)  # ascending, as hashes are
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    full, out = np.zeros(spec.bins, bool), np.zeros(spec.bins, np.uint64)
    used = at[first].astype(np.int64)
    full[used], out[used] = True, own[first]
    empty = np.flatnonzero(~full)
    if len(empty):
        lender = np.argmax(full[spec.borrow[empty]], axis=1)
        out[empty] = out[spec.borrow[empty, lender]]
    return out


def band_keys(own: np.ndarray, spec: NearSpec) -> np.ndarray:
    """One 64-bit bucket key a band."""
    mixed = mix(signature(own, spec) * spec.mixers)
    return mix(mixed.reshape(spec.bands, spec.rows).sum(axis=1, dtype=np.uint64) + np.arange(spec.bands, dtype=np.uint64))


def _longs(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _signed_pair(digest: int) -> tuple[int, int]:
    return (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)


def fingerprints(docs: DataFrame, spec: NearSpec) -> DataFrame:
    """doc_id, n (size of its set), hi and lo (128-bit hash of the set), bands (bucket keys, none for the empty set)."""
    import xxhash

    def make():
        shingler = Shingler(spec)
        def one(b):
            sets = shingler.sets(whole_texts(b.column("text")))
            pairs = [_signed_pair(xxhash.xxh3_128_intdigest(s.tobytes())) for s in sets]
            keys = [band_keys(s, spec) if len(s) else np.empty(0, np.uint64) for s in sets]
            return pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([hi for hi, _ in pairs], pa.int64()), pa.array([lo for _, lo in pairs], pa.int64()), _longs(keys)],
                names=["doc_id", "n", "hi", "lo", "bands"],
            )

        return one

    return arrow_map(docs.where("doc_id is not null"), ["doc_id", "text"], make, "doc_id long, n long, hi long, lo long, bands array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, spec: NearSpec) -> DataFrame:
    """id, n, shingles of the documents named in ``ids`` (id, hi, lo), those rows whose set it is."""
    import xxhash

    def make():
        shingler = Shingler(spec)

        def one(b):
            sets = shingler.sets(whole_texts(b.column("text")))
            wanted = zip(b.column("hi").to_pylist(), b.column("lo").to_pylist())
            same = [_signed_pair(xxhash.xxh3_128_intdigest(s.tobytes())) == w for s, w in zip(sets, wanted)]
            b, sets = b.filter(pa.array(same, pa.bool_())), [s for s, x in zip(sets, same) if x]
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), _longs(sets)], names=["id", "n", "shingles"])

        return one

    wanted = docs.select("doc_id", "text").join(ids.select(F.col("id").alias("doc_id"), "hi", "lo"), "doc_id")
    return arrow_map(wanted, ["doc_id", "text", "hi", "lo"], make, "id long, n long, shingles array<long>")


def shared_keys(rows: DataFrame) -> DataFrame:
    """Rows (key, id, n, need) whose key another class has too, with its ``members`` and its smallest class, ``centre``."""
    dealt = rows.repartition("key")  # one shuffle for the counts and the rows that they are joined to
    keys = dealt.groupBy("key").agg(F.min(F.struct("id", "n", "need")).alias("centre"), F.count("*").alias("members")).where("members > 1")
    return dealt.join(keys, "key")


def _fits(n, m, spec):
    return F.least(n, m) * 100 >= F.greatest(n, m) * spec.percent


def star_edges(shared: DataFrame, spec) -> DataFrame:
    """a, b: a key's smallest class and every other one in it, if their sizes allow a link and they meet in as many keys as either needs."""
    edges = shared.where((F.col("id") != F.col("centre.id")) & _fits(F.col("n"), F.col("centre.n"), spec))
    met = edges.groupBy(F.col("centre.id").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("times"), F.min(F.least("need", "centre.need")).alias("need"))
    return met.where("times >= need").select("a", "b")


def open_pairs(opened: DataFrame, spec) -> DataFrame:
    """a, b: pairs of different components that meet in as many keys of at most ``pairs`` members as either needs, and whose sizes allow a link."""
    row = F.struct("id", "n", "need", "comp")
    lists = opened.where(F.col("members") <= spec.pairs).groupBy("key").agg(F.collect_list(row).alias("m"))
    met = lists.select("m", F.explode("m").alias("x"))
    met = met.select("x", F.explode(F.filter("m", lambda y: (y["id"] > F.col("x.id")) & (y["comp"] != F.col("x.comp")) & _fits(y["n"], F.col("x.n"), spec))).alias("y"))
    met = met.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count("*").alias("times"), F.min(F.least("x.need", "y.need")).alias("need"))
    return met.where("times >= need").select("a", "b")


def confirm(edges: DataFrame, sets: DataFrame, spec: NearSpec) -> DataFrame:
    """a, b, common, n_a, n_b on the full sets.

    A centre's edges are dealt in chunks of bounded size, and each chunk gets the
    centre's set once; the tasks stream through chunks that sort the centre first.
    """
    salt = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("degree") / 64)))
    degree = edges.groupBy("a").agg(F.count("*").alias("degree"))
    dealt = stored(edges.join(degree, "a").withColumn("chunk", salt), "star-edges")
    members = dealt.join(sets.withColumnRenamed("id", "b"), "b").select("a", "chunk", "b", "n", "shingles")
    centres = dealt.select("a", "chunk").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "n", "shingles")
    streamed = members.unionByName(centres).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())

    def compare(batches):
        key, own = None, None
        for b in batches:
            lists = b.column("shingles")
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            out = []
            for i, (a, chunk, other) in enumerate(zip(*(b.column(c).to_pylist() for c in ("a", "chunk", "b")))):
                found = flat[ends[i] : ends[i + 1]].view(np.uint64)
                if other is None:
                    key, own = (a, chunk), found.copy()
                elif key == (a, chunk):
                    at = np.searchsorted(own, found)
                    common = int((own[np.minimum(at, len(own) - 1)] == found).sum())
                    out.append((a, other, common, len(own), len(found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], names=["a", "b", "common", "n_a", "n_b"])

    return streamed.mapInArrow(compare, "a long, b long, common long, n_a long, n_b long")


def _reaches(percent: int):
    return F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent


def _dealt_join(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", share: int = 256) -> DataFrame:
    """``rows`` with the one row of ``few`` for their keys; a cluster is dealt by id to as many tasks as its ``members`` fill, and only so often is its row copied."""
    deals = F.ceil(F.col("members") / share)
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64("id"), deals))
    copies = few.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), deals - 1))).drop("members")
    return dealt.join(copies, [*keys, "_deal"], how).drop("_deal")


def missed_links(clusters: DataFrame, sets: DataFrame, spec: NearSpec) -> DataFrame:
    """a, b: links between members of one cluster that are in different components so far.

    ``clusters``: id, n, cluster, comp. Members are ranked by set size and dealt into
    chunks of ``chunk`` rows; two chunks meet only if their sizes allow a link, and a
    meeting returns a forest of at most as many edges as it has members.
    """
    from pyspark.sql import Window

    split = clusters.groupBy("cluster").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members")).where("low <> high")
    deals = 8  # before a cluster's members are known
    copies = split.select("cluster", "members", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))).alias("_deal"))
    kept = clusters.withColumn("_deal", F.pmod(F.xxhash64("id"), F.lit(deals))).join(copies, ["cluster", "_deal"]).drop("_deal")
    # size classes: the powers of the size ratio a link allows, so a link spans two neighbours at most
    ratio = 100 / spec.percent
    sized = kept.withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / float(np.log(ratio)) + 1e-9))
    groups = sized.groupBy("cluster", "size_class").agg(F.count("*").alias("own"), F.sum("n").alias("shingles"), F.first("members").alias("members"))
    groups = groups.withColumn("chunks", F.greatest(F.ceil(F.col("own") / spec.chunk), F.ceil(F.col("shingles") / spec.chunk_shingles)))
    placed = _dealt_join(sized, groups.select("cluster", "size_class", "chunks", "members"), ["cluster", "size_class"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    near = groups.select("cluster", "members", (F.col("size_class") + 1).alias("size_class"), F.col("chunks").alias("below"))
    over = groups.select("cluster", "members", (F.col("size_class") - 1).alias("size_class"), F.col("chunks").alias("above"))
    for beside in (near, over):
        placed = _dealt_join(placed, beside, ["cluster", "size_class"], "left")
    cell = lambda s1, c1, s2, c2: F.struct(s1.alias("s1"), c1.alias("c1"), s2.alias("s2"), c2.alias("c2"))
    s, c = F.col("size_class"), F.col("chunk")
    own_type = "array<struct<s1: bigint, c1: bigint, s2: bigint, c2: bigint>>"
    own = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda o: cell(s, F.least(c, o), s, F.greatest(c, o)))
    none = F.expr(f"cast(array() as {own_type})")
    below = F.when(F.col("below").isNotNull(), F.transform(F.sequence(F.lit(0).cast("long"), F.col("below") - 1), lambda o: cell(s - 1, o, s, c))).otherwise(none)
    above = F.when(F.col("above").isNotNull(), F.transform(F.sequence(F.lit(0).cast("long"), F.col("above") - 1), lambda o: cell(s, c, s + 1, o))).otherwise(none)
    meetings = placed.repartition("id").select("cluster", "id", "comp", F.explode(F.array_distinct(F.concat(own.cast(own_type), below, above))).alias("cell"))
    useful = meetings.groupBy("cluster", "cell").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("cluster", "cell")
    rows = meetings.join(useful, ["cluster", "cell"]).join(sets, "id").select("cluster", "cell", "id", "comp", "shingles")

    def meet(t: pa.Table) -> pa.Table:
        lists = t.column("shingles").combine_chunks()
        ids, comp = t.column("id").to_numpy(), t.column("comp").to_numpy()
        a, b = forest(lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), comp, spec.percent)
        return pa.table([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return rows.groupBy("cluster", "cell").applyInArrow(meet, "a long, b long")


def forest(flat: np.ndarray, sizes: np.ndarray, comp: np.ndarray, percent: int) -> tuple[list[int], list[int]]:
    """Links between rows of different components that suffice to join all that links join."""
    n = len(sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = times[column] > 1
    names, column = np.unique(column[shared], return_inverse=True)
    common = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[shared][order]
    for at in range(0, len(names), 4096):  # blocks of shingles, so the matrix stays small
        i, j = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((n, min(4096, len(names) - at)), np.float32)
        m[row[i:j], column[i:j] - at] = 1
        common += m @ m.T
    linked = (common * 100 >= (sizes[:, None] + sizes - common) * percent) & (comp[:, None] != comp)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out_a, out_b = [], []
    for a, b in zip(*np.nonzero(np.triu(linked))):
        x, y = find(int(comp[a])), find(int(comp[b]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out_a.append(int(a))
            out_b.append(int(b))
    return out_a, out_b


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, comp) after further links (a, b)."""
    ends = comp.select("id", "comp")
    joined = links.join(ends.select(F.col("id").alias("a"), F.col("comp").alias("x")), "a", "left").join(ends.select(F.col("id").alias("b"), F.col("comp").alias("y")), "b", "left")
    further = components(joined.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    alone = further.join(comp.select(F.col("comp").alias("id")).distinct(), "id", "left_anti")
    return comp.join(further.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")).unionByName(alone)


def linked(shared: DataFrame, classes: DataFrame, docs: DataFrame, spec) -> DataFrame:
    """id, comp of the classes that have links, where classes meet in the keys of ``shared`` (``shared_keys``).

    Two classes are taken as candidates if they meet in at least as many keys as the less
    demanding of them needs. All candidates end in one component or have been compared.
    """
    print_of = classes.select("id", "hi", "lo")

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        return stored(full_sets(docs, print_of.join(ids, "id", "left_semi"), spec), name)

    ends = lambda pairs: pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    stars = stored(star_edges(shared, spec), "candidates")
    sets = sets_of(ends(stars), "sets")
    release_shuffles(docs.sparkSession)  # all texts were shuffled
    checked = stored(confirm(stars, sets, spec), "checked")
    release_shuffles(docs.sparkSession)
    comp = components(checked.where(_reaches(spec.percent)))
    # keys that still hold several components
    placed = shared.select("key", "id", "n", "need", "members", F.col("centre.id").alias("centre")).join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    held = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    opened = stored(placed.join(held, "key", "left_semi"), "open-keys")
    pairs = stored(open_pairs(opened, spec).join(checked.select("a", "b"), ["a", "b"], "left_anti"), "open-pairs")
    large = opened.where(F.col("members") > spec.pairs)
    clusters = components(large.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct())
    clusters = stored(clusters.select("id", F.col("comp").alias("cluster")).join(large.groupBy("id").agg(F.first("n").alias("n"), F.first("comp").alias("comp")), "id"), "clusters")
    more_ids = ends(pairs).union(clusters.select("id")).distinct().join(sets.select("id"), "id", "left_anti")
    sets = sets.unionByName(sets_of(more_ids, "more-sets"))
    release_shuffles(docs.sparkSession)
    links = stored(confirm(pairs, sets, spec).where(_reaches(spec.percent)).select("a", "b"), "pair-links")
    release_shuffles(docs.sparkSession)
    links = links.unionByName(stored(missed_links(clusters, sets.join(clusters.select("id"), "id", "left_semi"), spec), "missed"))
    return merged(comp, links) if links.limit(1).count() else comp


def classes_of(prints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From one row a document (doc_id, n, hi, lo, need, keys): documents with ``own`` (the doc_id of those with empty sets, which are classes of their own), classes, and the keys that two classes or more share (``shared_keys``).

    The rows with their keys are the bulk; they are removed as soon as what needs them is written.
    """
    spark, prints = prints.sparkSession, stored(prints, "fingerprints")
    path = STORED[-1]
    again = stored(prints.groupBy("doc_id").agg(F.count("*").alias("times"), F.min(F.struct("hi", "lo")).alias("only")).where("times > 1").select("doc_id", "only"), "repeated")
    single = prints
    if again.limit(1).count():
        single = prints.join(again, "doc_id", "left").where("only is null or (only.hi = hi and only.lo = lo)").drop("only")
    single = single.withColumn("own", F.when(F.col("n") == 0, F.col("doc_id")))
    full = stored(single.groupBy("hi", "lo", "own").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("n", "need", "keys"))), "keyed-classes")
    full_path = STORED[-1]
    named = stored(single.drop("need", "keys"), "named")
    discard(spark, path)
    release_shuffles(spark)
    rows = full.where("n > 0").select(F.explode("keys").alias("key"), "id", "n", "need")
    shared = stored(shared_keys(rows), "shared-keys")
    classes = stored(full.drop("need", "keys"), "classes")
    discard(spark, full_path)
    release_shuffles(spark)
    return named, classes, shared


def by_document(named: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row a document."""
    reached = classes.join(comp.withColumnRenamed("comp", "reached"), "id", "left").select("hi", "lo", F.col("own").alias("empty_id"), F.coalesce("reached", "id").alias("component_id"))
    full = named.where("n > 0").join(reached.where("empty_id is null").drop("empty_id"), ["hi", "lo"]).select("doc_id", "n", "component_id")
    empty = named.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).distinct().select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def near_duplicates(docs: DataFrame, spec: NearSpec = NearSpec()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a document."""
    prints = fingerprints(docs, spec).select("doc_id", "n", "hi", "lo", F.lit(1).alias("need"), F.col("bands").alias("keys"))
    named, classes, shared = classes_of(prints)
    found = by_document(named, classes, linked(shared, classes, docs, spec))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))

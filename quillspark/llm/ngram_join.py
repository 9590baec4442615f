"""N-gram Jaccard join with count-vector R-trees.

A document's set is its distinct word shingles, as 64-bit hashes. Hashes fall into groups by their first bits; the numbers
of a set's hashes by group are its point. Large sets have finer groups (2 to 4 hashes each), which nest in coarser ones.
The overlap of two sets is at most the sum of the smaller coordinates, and that of any two sets below two tree nodes at
most the same sum over the nodes' upper corners: pairs of nodes that can't reach the overlap that the similarity asks for
are left out, and surviving pairs are verified with their whole sets.

One tree over all documents would compare each document with most others of its size (points of unrelated documents of
500 words lie within the bound at few dimensions, and at many a tree has no small nodes), so trees are built for blocks:
documents that share a shingle of their prefixes. In one order of all shingles, rare ones first, two sets of similarity s
share 3 of their first n - ceil(s * n) + 3 members (n: size of each; sets too small for that equal each other or share
all). The order is by how far a shingle's counter stands above the others in a count sketch over all documents, then by
hash: every task knows it, and it only decides how large blocks get, not what is found. The sketch is broadcast and grows
with the corpus up to 2**24 counters; beyond that, shingles count as frequent by the spread of its counters.

1. Equal sets are made one class (fingerprints of 128 bits and the size); one representative goes on.
2. Blocks of SMALL representatives or fewer give all their pairs; pairs met in three blocks are candidates. A larger
   block is joined with itself by an R-tree over its points; of the pairs that the bounds leave, a spanning forest goes
   on. In a block of more than `large`, all are candidates with one of them. Components of all these candidates are
   clusters: no link leaves one.
3. The texts of a cluster go to one task once, if it has `cluster_rows` members and `cluster_shingles` in all at most. There an R-tree is built over
   its points and joined with itself. Pairs that the bounds leave are verified best first, unless the links found so far
   connect them already.
4. A cluster beyond that size stays dealt out by blocks. Its candidates are bounded and verified as pairs; then blocks
   that still hold several components are joined by an R-tree each. For each member and other component the few best
   bounds are verified, then all that are left. A node pair within one component is left out.

So groups of near copies never give all their pairs, and no link between components is lost.

Links inside a component are not all listed: the result is the class id of each document (its smallest reachable id).
A null or empty text has no shingles and no links; a text with fewer words than a shingle is one shingle. A row with a
null doc_id has n_shingles but no component. Rows that repeat, or repeat an id with another text, are placed by their
texts. Very long texts are whole sets. An empty table gives none. Ids are integers. 64-bit hashes of different shingles collide within a
pair of sets of 1,000 with a probability of 5e-14.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import COUNT_SCHEMA, GAP_SPACE, Bloom, Scratch, batch_rows, count_rows, hash_words, joined, mix64, pack_counts, slices, small_batches, sum_counts, tidy, unpack_counts, xxhash_longs
from .components import components

SMALL, LARGE, LEAF, SHARED = 8, 512, 16, 3
#: Members of a cluster that one task joins, and rows that a task of a shuffle has, on average.
CLUSTER_ROWS, ROWS_A_TASK = 10_000, 20_000
_MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of num / den or more."""

    num: int = 75
    den: int = 100
    words: int = 5

    def links(self, overlap: int, a: int, b: int) -> bool:
        return self.den * overlap >= self.num * (a + b - overlap)

    def may_link(self, bound, a, b):
        """Whether sets of sizes a and b whose overlap is at most bound can link; elementwise."""
        return (self.den + self.num) * bound >= self.num * (a + b)

    def sizes_fit(self, a, b):
        """Whether sets of these sizes can link; elementwise."""
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)

    def prefix(self, n: int) -> int:
        return min(n, n - math.ceil(self.num * n / self.den) + SHARED)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, begins = joined(texts)
    h, start, _ = hash_words(data, GAP_SPACE)
    first = np.searchsorted(start, begins)  # the first word of each text
    out = []
    n = len(h) - words + 1
    sums = np.zeros(max(0, n), np.uint64)
    for k in range(words):
        sums += h[k : k + max(0, n)] * _MULTIPLIERS[k]
    sums = mix64(sums)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(sums[a : b - words + 1]))
        elif b > a:
            out.append(mix64((h[a:b] * _MULTIPLIERS[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def point(s: np.ndarray) -> np.ndarray:
    """Counts of the hashes by their first bits, 2 to 4 a group: a few groups for small sets, many for large ones."""
    bits = min(16, max(4, (max(1, len(s) - 1) >> 2).bit_length()))
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


read_point = unpack_counts


def coarse(p: np.ndarray, groups: int) -> np.ndarray:
    """The same set's counts by fewer groups."""
    return p if len(p) == groups else p.reshape(groups, -1).sum(1)


def _sketch(bits: int, words: int):
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((1, 1 << bits), np.int32)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in slices(texts):
                sets = shingle_sets(texts[part], words)
                np.add.at(counts[0], (np.concatenate(sets) & np.uint64((1 << bits) - 1)).astype(np.int64), np.int32(1))
        yield count_rows(counts)

    return run


def levels_of(counts: np.ndarray) -> np.ndarray:
    """0 for counters about as high as most; one more for each doubling of what exceeds that by eight times their spread."""
    middle = float(np.median(counts))
    spread = max(1.0, float(np.median(np.abs(counts - middle))))
    return np.floor(np.log2(np.maximum((counts - middle) / (8 * spread), 0.5)) + 1).clip(0, 60).astype(np.uint8)


def _profiles(broadcast, sim: Similarity):
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels = broadcast.value
        mask = np.uint64(len(levels) - 1)
        for pdf in batches:
            texts, rows = pdf["text"].tolist(), []
            for part in slices(texts):
                for s in shingle_sets(texts[part], sim.words):
                    level = levels[(s & mask).astype(np.int64)]
                    order = s if not level.any() else s[np.argsort(level, kind="stable")]
                    keys = order[: sim.prefix(len(s))] if len(s) >= SHARED else s[:0]
                    a, b = mix64(s ^ np.uint64(0x5851F42D4C957F2D)), mix64(s + np.uint64(0x14057B7EF767814F))
                    rows.append((len(s), int(a.sum(dtype=np.uint64).view(np.int64)), int(b.sum(dtype=np.uint64).view(np.int64)), pack_counts(point(s)), keys.view(np.int64)))
            out = pd.DataFrame(rows, columns=["n", "f1", "f2", "point", "keys"])
            yield out.assign(doc_id=pdf["doc_id"].to_numpy(), known=pdf["known"].to_numpy())

    return run


def _blocks(sim: Similarity, large: int, most: int = 100_000):
    """large: blocks beyond it get no tree; most: rows of a block that a task holds."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by key. Pairs of small blocks (kind 0); members of larger ones (1: name of the block, doc); members
        of the largest (2), which are candidates with one of them (3) without a look at their points."""
        held_k, held, passing = np.empty(0, np.int64), np.empty((0, 2), np.int64), None

        def frame(kind: int, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"kind": np.full(len(a), kind, np.int32), "a": a, "b": b})

        def largest(name: int, anchor: int, own: np.ndarray) -> list[pd.DataFrame]:
            others = own[own != anchor]
            return [frame(2, np.full(len(own), name), own), frame(3, np.minimum(others, anchor), np.maximum(others, anchor))]

        def emit(k: np.ndarray, docs: np.ndarray) -> pd.DataFrame | None:
            cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
            sizes = np.diff(cut)
            parts, rows = [], []
            for m in range(2, SMALL + 1):
                begin = cut[:-1][sizes == m]
                if len(begin):
                    i, j = np.triu_indices(m, 1)
                    parts.append((0, docs[begin[:, None] + i].reshape(-1, 2), docs[begin[:, None] + j].reshape(-1, 2)))
            for begin, m in zip(cut[:-1][sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                own = np.ascontiguousarray(docs[begin : begin + m])
                # named by its members: blocks of the same members are one
                name = mix64(mix64(own[:, 0].astype(np.uint64)).sum(dtype=np.uint64, keepdims=True) + np.uint64(m)).view(np.int64)
                if m > large:
                    rows += largest(int(name[0]), int(own[:, 0].min()), own[:, 0])
                else:
                    parts.append((1, np.column_stack((np.repeat(name, m), own[:, 1])), own))
            for kind, x, y in parts:
                if kind == 0:  # no link between sizes so far apart
                    fits = sim.sizes_fit(x[:, 1], y[:, 1]) & (x[:, 0] != y[:, 0])
                    a, b = np.minimum(x[fits, 0], y[fits, 0]), np.maximum(x[fits, 0], y[fits, 0])
                else:
                    a, b = x[:, 0], y[:, 0]
                rows.append(frame(kind, a, b))
            return pd.concat(rows, ignore_index=True) if rows else None

        for pdf in batches:
            k = np.concatenate((held_k, pdf["key"].to_numpy()))
            docs = np.concatenate((held, pdf[["doc", "n"]].to_numpy(np.int64)))
            if passing is not None and len(k):  # more of a block that is too large to hold
                key, anchor = passing
                go = int(np.searchsorted(k, key, side="right"))
                yield from largest(key, anchor, docs[:go, 0])
                passing, k, docs = passing if go == len(k) else None, k[go:], docs[go:]
            stop = np.searchsorted(k, k[-1]) if len(k) else 0  # the last block may go on
            if stop and (out := emit(k[:stop], docs[:stop])) is not None:
                yield out
            held_k, held = k[stop:], docs[stop:]
            if len(held) > most:
                passing = int(held_k[0]), int(held[0, 0])
                yield from largest(*passing, held[:, 0])
                held_k, held = held_k[:0], held[:0]
        if len(held_k) and (out := emit(held_k, held)) is not None:
            yield out

    return run


def _within_bound(sim: Similarity):
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bound = []
            for p, q in zip(map(read_point, pdf["point_a"]), map(read_point, pdf["point_b"]), strict=True):
                groups = min(len(p), len(q))
                bound.append(np.minimum(coarse(p, groups), coarse(q, groups)).sum())
            yield pdf.loc[sim.may_link(np.array(bound, np.int64), pdf["n_a"].to_numpy(), pdf["n_b"].to_numpy()), ["a", "b"]]

    return run


def _verified(sim: Similarity):
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for at in range(0, len(pdf), 128):
                part = pdf.iloc[at : at + 128]
                texts = list(dict.fromkeys([*part["text_a"], *part["text_b"]]))
                sets = dict(zip(texts, shingle_sets(texts, sim.words), strict=True))
                for a, b, x, y in zip(part["a"].tolist(), part["b"].tolist(), part["text_a"], part["text_b"], strict=True):
                    s, t = sets[x], sets[y]
                    overlap = len(s) + len(t) - len(np.unique(np.concatenate((s, t))))
                    if overlap and sim.links(overlap, len(s), len(t)):
                        found.append((a, b))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


class RTree:
    """Bulk-loaded over points: split at the median of the widest coordinate until LEAF points are left. A node has the
    upper corner of its points, their smallest size, and their component if they have one in common (else -1)."""

    def __init__(self, at: np.ndarray, sizes: np.ndarray, component: np.ndarray):
        self.at, self.sizes, self.component = at, sizes, component
        self.corner, self.least, self.common, self.rows, self.children = [], [], [], [], []
        self._load(np.arange(len(at)))

    def _load(self, rows: np.ndarray) -> int:
        node = len(self.corner)
        own = self.at[rows]
        self.corner.append(own.max(0))
        self.least.append(int(self.sizes[rows].min()))
        c = self.component[rows]
        self.common.append(int(c[0]) if (c == c[0]).all() else -1)
        self.rows.append(rows)
        self.children.append(None)
        if len(rows) > LEAF:
            wide = int(np.argmax(own.max(0) - own.min(0)))
            by = rows[np.argsort(own[:, wide], kind="stable")]
            self.children[node] = (self._load(by[: len(by) // 2]), self._load(by[len(by) // 2 :]))
        return node

    def join(self, sim: Similarity) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of rows of different components that the bound leaves, and how far it is above what is asked for."""
        todo = [(0, 0)]
        while todo:
            a, b = todo.pop()
            if self.common[a] >= 0 and self.common[a] == self.common[b]:
                continue
            if a != b and not sim.may_link(np.minimum(self.corner[a], self.corner[b]).sum(), self.least[a], self.least[b]):
                continue
            ca, cb = self.children[a], self.children[b]
            if ca is None and cb is None:
                x, y = self.rows[a], self.rows[b]
                bound = np.minimum(self.at[x][:, None], self.at[y][None]).sum(2)
                total = self.sizes[x][:, None] + self.sizes[y][None]
                keep = sim.may_link(bound, self.sizes[x][:, None], self.sizes[y][None]) & (self.component[x][:, None] != self.component[y][None])
                if a == b:
                    keep &= np.arange(len(x))[:, None] < np.arange(len(y))[None]
                i, j = np.nonzero(keep)
                if len(i):
                    yield x[i], y[j], bound[i, j] / total[i, j]
            elif a == b:
                todo += [(ca[0], ca[0]), (ca[0], ca[1]), (ca[1], ca[1])]
            elif cb is None or (ca is not None and len(self.rows[a]) >= len(self.rows[b])):
                todo += [(ca[0], b), (ca[1], b)]
            else:
                todo += [(a, cb[0]), (a, cb[1])]


def tree_join(at: list[np.ndarray], sizes: np.ndarray, component: np.ndarray, sim: Similarity) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What RTree.join yields, over points of different numbers of groups: a tree for each number, with the points that
    have it and those up to `span` doublings finer, which all sets are that can link with its own."""
    groups = np.array([len(p) for p in at])
    span = math.ceil(math.log2(sim.den / sim.num))
    for g in np.unique(groups):
        rows = np.flatnonzero((groups >= g) & (groups <= g << span))
        if len(rows) > 1:
            tree = RTree(np.stack([coarse(at[i], int(g)) for i in rows]), sizes[rows], component[rows])
            for x, y, gain in tree.join(sim):
                x, y = rows[x], rows[y]
                own = (groups[x] == g) | (groups[y] == g)
                yield x[own], y[own], gain[own]


def best(x: np.ndarray, y: np.ndarray, other: np.ndarray, gain: np.ndarray, k: int | None) -> np.ndarray:
    """Which pairs are among the k best of their x and the component of y."""
    if k is None:
        return np.arange(len(x))
    by = np.lexsort((-gain, other, x))
    new = np.concatenate(([True], (x[by][1:] != x[by][:-1]) | (other[by][1:] != other[by][:-1])))
    start = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    return by[np.arange(len(by)) - start < k]


def _by_block(emit):
    """emit: from the rows of a block to pairs; rows come sorted by key."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            if pdf["key"].iloc[-1] == held[0]["key"].iloc[0]:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = rows["key"].iloc[-1]
            held = [rows[rows["key"] == last]]
            for _, block in rows[rows["key"] != last].groupby("key", sort=False):
                yield emit(block)
        if held:
            for _, block in pd.concat(held, ignore_index=True).groupby("key", sort=False):
                yield emit(block)

    return run


def _pair_frame(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _tree_forest(sim: Similarity):
    """Of the pairs that the bounds leave, as many as connect what all of them connect."""

    def emit(block: pd.DataFrame) -> pd.DataFrame:
        docs, up, found = block["doc"].to_numpy(), list(range(len(block))), []

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        at = [read_point(p) for p in block["point"]]
        for x, y, _ in tree_join(at, block["n"].to_numpy(), np.arange(len(block)), sim):
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                if (a := root(i)) != (b := root(j)):
                    up[b] = a
                    found.append((i, j))
        found = np.array(found, np.int64).reshape(-1, 2)
        return _pair_frame(docs[found[:, 0]], docs[found[:, 1]])

    return _by_block(emit)


def _tree_pairs(sim: Similarity, k: int | None):
    """Pairs of different components that the bounds leave; k: the best for each member and other component."""

    def emit(block: pd.DataFrame) -> pd.DataFrame:
        docs, component = block["doc"].to_numpy(), block["component"].to_numpy()
        numbers = np.unique(component, return_inverse=True)[1]
        found = list(tree_join([read_point(p) for p in block["point"]], block["n"].to_numpy(), numbers, sim))
        if not found:
            return _pair_frame(docs[:0], docs[:0])
        x, y, gain = (np.concatenate(c) for c in zip(*found, strict=True))
        # of the two, the one whose component is smaller in this block looks for the other
        weight = np.bincount(numbers)
        swap = weight[numbers[x]] > weight[numbers[y]]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        own = best(x, y, numbers[y], gain, k)
        return _pair_frame(docs[x[own]], docs[y[own]])

    return _by_block(emit)


def join_cluster(docs: list[int], sets: list[np.ndarray], sim: Similarity) -> list[tuple[int, int]]:
    """doc and component of each distinct member that has a link."""
    up = list(range(len(docs)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    sizes = np.array([len(s) for s in sets], np.int64)

    def try_link(x: int, y: int) -> None:
        x_, y_ = root(x), root(y)
        if x_ != y_ and sim.sizes_fit(sizes[x], sizes[y]):
            overlap = len(sets[x]) + len(sets[y]) - len(np.unique(np.concatenate((sets[x], sets[y]))))
            if sim.links(overlap, len(sets[x]), len(sets[y])):
                up[max(x_, y_)] = min(x_, y_)

    for k in range(4):  # for a start, neighbours in the order of a minimal hash
        order = np.argsort(np.array([(s * _MULTIPLIERS[k]).min() for s in sets], np.uint64))
        for x, y in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
            try_link(x, y)
    for x, y, gain in tree_join([point(s) for s in sets], sizes, np.array([root(x) for x in range(len(docs))]), sim):
        for i in np.argsort(-gain, kind="stable").tolist():
            try_link(int(x[i]), int(y[i]))
    least: dict[int, int] = {}
    for x, d in enumerate(docs):
        r = root(x)
        least[r] = min(least.get(r, d), d)
    return [(d, least[root(x)]) for x, d in enumerate(docs) if least[root(x)] != d]


def _cluster_links(sim: Similarity):
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by cluster."""
        cluster, docs, sets = None, [], []

        def emit() -> pd.DataFrame:
            return pd.DataFrame(join_cluster(docs, sets, sim) if len(docs) > 1 else [], columns=["node", "component"], dtype="int64")

        for pdf in batches:
            texts = pdf["text"].tolist()
            own = [s for part in slices(texts) for s in shingle_sets(texts[part], sim.words)]
            for c, d, s in zip(pdf["cluster"].tolist(), pdf["doc"].tolist(), own, strict=True):
                if c != cluster and docs:
                    yield emit()
                    docs, sets = [], []
                cluster = c
                docs.append(d)
                sets.append(s)
        if docs:
            yield emit()

    return run


class Join:
    def __init__(self, spark: SparkSession, docs: DataFrame, sim: Similarity, cluster_shingles: int, cluster_rows: int, large: int):
        self.spark, self.sim, self.large, self.scratch = spark, sim, large, Scratch(spark, "jaccard")
        self.cluster_shingles, self.cluster_rows = cluster_shingles, cluster_rows
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.rows = self.docs.count()
        self.shuffles = max(int(spark.conf.get("spark.sql.shuffle.partitions")), self.rows // ROWS_A_TASK)

    def profiles(self) -> DataFrame:
        spark, sim = self.spark, self.sim
        bits = min(24, max(16, (self.rows * 16).bit_length()))
        counts = sum_counts(spark, self.docs.select("text").mapInPandas(_sketch(bits, sim.words), COUNT_SCHEMA), 1, 1 << bits)[0]
        levels = spark.sparkContext.broadcast(levels_of(counts))
        # ids without nulls, which pandas would turn to floats
        whole = self.docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text")
        made = whole.mapInPandas(_profiles(levels, sim), "n long, f1 long, f2 long, point binary, keys array<long>, doc_id long, known boolean")
        return self.scratch.stash(made.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known"), "profiles")

    def texts(self, ids: DataFrame, n: int) -> DataFrame:
        """Texts of the ids (one column, n rows), and a few others: only what passes a filter needs to be shuffled."""
        passing = self.spark.sparkContext.broadcast(Bloom(ids.select(F.xxhash64(ids.columns[0])), n))

        def passes(ids: pd.Series) -> pd.Series:
            return pd.Series(passing.value.holds(xxhash_longs(ids.to_numpy(np.int64))))

        passes.__annotations__ = {"ids": pd.Series, "return": pd.Series}
        return self.docs.filter(F.col("doc_id").isNotNull() & F.pandas_udf(passes, "boolean")(F.coalesce("doc_id", F.lit(0))))

    def run(self) -> DataFrame:
        sim, scratch = self.sim, self.scratch
        profiles = self.profiles()
        kind = ["n", "f1", "f2"]
        real = profiles.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
        classes = scratch.stash(real.groupBy(*kind).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
        # joined by id too, so that a class of many copies is no hot key
        reps = (
            profiles.join(classes.select(F.col("rep").alias("doc_id"), *kind), ["doc_id", *kind], "left_semi").dropDuplicates(["doc_id", *kind])
            .select(F.col("doc_id").alias("doc"), "n", "point", "keys"))
        reps = scratch.stash(reps, "reps")
        keyed = reps.select(F.explode("keys").alias("key"), "doc", "n")
        keyed = keyed.repartition(self.shuffles, "key").sortWithinPartitions("key")
        with batch_rows(self.spark, 20_000):
            blocks = scratch.stash(keyed.mapInPandas(_blocks(sim, self.large), "kind int, a long, b long"), "blocks")
        pairs = blocks.filter("kind = 0").groupBy("a", "b").agg(F.count("*").alias("times")).filter(F.col("times") >= SHARED).select("a", "b")
        members = scratch.stash(blocks.filter("kind IN (1, 2)").select("kind", F.col("a").alias("key"), F.col("b").alias("doc")).distinct(), "members")
        rows = members.filter("kind = 1").drop("kind").join(reps.select("doc", "n", "point"), "doc").repartition(self.shuffles, "key").sortWithinPartitions("key")
        trees = rows.mapInPandas(_tree_forest(sim), "a long, b long").distinct()
        pairs = scratch.stash(pairs.unionByName(trees).unionByName(blocks.filter("kind = 3").select("a", "b").distinct()), "pairs")
        clusters = components(scratch, pairs, "cluster").select(F.col("node").alias("doc"), F.col("component").alias("cluster"))
        clusters = scratch.stash(clusters.unionByName(clusters.select(F.col("cluster").alias("doc"), "cluster").distinct()), "clusters")
        scratch.drop("blocks")
        sizes = clusters.join(classes.select(F.col("rep").alias("doc"), "n"), "doc").groupBy("cluster").agg(F.sum("n").alias("shingles"), F.count("*").alias("rows"))
        sizes = scratch.stash(sizes, "sizes")
        small = (F.col("shingles") <= self.cluster_shingles) & (F.col("rows") <= self.cluster_rows)
        fits = clusters.join(sizes.filter(small), "cluster", "left_semi")
        texts = self.texts(fits.select("doc"), fits.count()).join(fits, F.col("doc_id") == F.col("doc")).select("cluster", "doc", "text")
        found = texts.repartition(self.shuffles, "cluster").sortWithinPartitions("cluster").mapInPandas(_cluster_links(sim), "node long, component long")
        part = scratch.stash(found, "components")
        large = clusters.join(sizes.filter(~small), "cluster", "left_semi").select("doc")
        if not large.isEmpty():
            part = part.unionByName(Spread(self, reps, members, pairs, large).run())
        part = part.groupBy("node").agg(F.min("component").alias("component"))  # ids that repeat with another text
        part = scratch.stash(part, "found")
        for name in ("reps", "members", "pairs", "clusters", "sizes", "components"):
            scratch.drop(name)
        # Classes of at least 1/65536 of all rows, which are 65536 at most, are broadcast, the others joined by shuffle; rows
        # without shingles or without id need no class.
        hot = F.col("copies") * 65536 >= self.rows
        rep_of = classes.join(part.withColumnRenamed("node", "rep"), "rep", "left").select(*kind, "copies", F.coalesce("component", "rep").alias("component_id"))
        rows = profiles.select("doc_id", *kind)
        classed = F.col("doc_id").isNotNull() & (F.col("n") > 0)
        near = rows.filter(classed).join(F.broadcast(rep_of.filter(hot).drop("copies").withColumnRenamed("component_id", "hot_id")), kind, "left")
        far = near.filter("hot_id IS NULL").drop("hot_id").join(rep_of.filter(~hot).drop("copies"), kind, "left")
        out = near.filter("hot_id IS NOT NULL").withColumnRenamed("hot_id", "component_id").unionByName(far)
        out = out.unionByName(rows.filter(~classed).withColumn("component_id", F.col("doc_id")))
        return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


class Spread:
    """The join of clusters too large for one task, dealt out by pairs and blocks."""

    def __init__(self, join: Join, reps: DataFrame, members: DataFrame, pairs: DataFrame, docs: DataFrame):
        self.join, self.sim, self.scratch = join, join.sim, join.scratch
        self.reps = self.scratch.stash(reps.select("doc", "n", "point").join(docs, "doc", "left_semi"), "large")
        self.pairs = pairs.join(docs.toDF("a"), "a", "left_semi")
        self.members = members.drop("kind").join(docs, "doc", "left_semi")
        self.links: DataFrame | None = None
        self.rounds = 0

    def verify(self, pairs: DataFrame) -> None:
        """Adds the pairs (a < b) that link to the links."""
        r = self.rounds = self.rounds + 1
        side = lambda s: self.reps.select(F.col("doc").alias(s), F.col("n").alias(f"n_{s}"), F.col("point").alias(f"point_{s}"))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_within_bound(self.sim), "a long, b long").distinct()
        pairs = self.scratch.stash(pairs, f"verify-{r}")
        if pairs.isEmpty():
            return
        texts = self.join.texts(self.reps.select("doc"), self.reps.count())
        both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
            texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        links = self.scratch.stash(both.mapInPandas(_verified(self.sim), "a long, b long"), f"links-{r}")
        self.links = links if self.links is None else self.links.unionByName(links)

    def components(self) -> DataFrame:
        if self.links is None:
            return self.join.spark.createDataFrame([], "node long, component long")
        return components(self.scratch, self.links, f"components-{self.rounds}")

    def run(self) -> DataFrame:
        self.verify(self.pairs)
        tested = self.pairs
        for k in (4, None):
            part = self.components().withColumnRenamed("node", "doc")
            placed = self.members.join(part, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
            placed = self.scratch.stash(placed, f"placed-{k}")
            parts = placed.groupBy("key", "component").agg(F.count("*").alias("size")).groupBy("key").agg(
                F.sum("size").alias("all"), F.max(F.struct("size", "component")).alias("main"), F.count("*").alias("parts"))
            open_ = self.cells(placed.join(parts.filter("parts > 1"), "key")).join(self.reps, "doc")
            rows = open_.repartition(self.join.shuffles, "key").sortWithinPartitions("key")
            found = rows.mapInPandas(_tree_pairs(self.sim, k), "a long, b long").distinct().join(tested, ["a", "b"], "left_anti")
            found = self.scratch.stash(found, f"found-{k}")
            tested = tested.unionByName(found)
            self.verify(found)
        return self.components()


    def cells(self, rows: DataFrame) -> DataFrame:
        """Blocks of several components, cut to cells of at most about twice `large` rows. Pairs within the main component
        need no look. So its members are dealt over cells, each with a piece of the others, and pieces of the others meet
        each other."""
        large = self.join.large
        others = F.col("all") - F.col("main.size")
        chunks, pieces = (F.ceil(c / large).cast("int") for c in (F.col("main.size"), others))
        hashed = F.xxhash64(F.lit(3), "doc")
        chunk, piece = F.pmod(hashed, chunks).cast("int"), F.pmod(hashed, pieces).cast("int")
        cell = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"))
        upto = lambda n: F.sequence(F.lit(0), n - 1)
        zero = F.lit(0)
        at = (
            F.when(F.col("all") <= 2 * large, F.array(cell(0, zero, zero)))
            .when(F.col("component") == F.col("main.component"), F.transform(upto(pieces), lambda p: cell(1, chunk, p)))
            .otherwise(F.concat(
                F.transform(upto(chunks), lambda c: cell(1, c, piece)),
                F.transform(upto(pieces), lambda p: cell(2, F.least(p, piece), F.greatest(p, piece))))))
        return rows.select("key", "doc", "component", F.explode(at).alias("cell")).select(F.xxhash64("key", "cell").alias("key"), "doc", "component")


def jaccard_components(
    spark: SparkSession, docs: DataFrame, similarity: Similarity = Similarity(), cluster_shingles: int = 4_000_000,
    cluster_rows: int = CLUSTER_ROWS, large: int = LARGE,
) -> DataFrame:
    """doc_id, text in; doc_id, n_shingles, component_id out, a row for each row."""
    small_batches(spark)
    return Join(spark, docs, similarity, cluster_shingles, cluster_rows, large).run()

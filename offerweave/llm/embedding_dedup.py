"""Embedding near-dedup with a forest of random-projection trees.

Each tree splits space again and again by a random direction (one a level) at a random quantile
near the middle. Vectors within ``margin`` of a split go to both sides (spill), so that a linked
pair seldom parts; several independent trees make it rarer still. In each leaf vectors are
compared in blocks by cosine in double precision, all with all. A pair is counted only in the
first leaf (by tree, then leaf) that both ends share, so links are counted exactly once without
sending pairs anywhere; a leaf returns counts and the edges of a spanning forest.

Trees are as deep as leaves of bounded size need. Their upper levels are fitted on the projections
of a bounded sample; what lies below is fitted by one task for each node there, on a share of all
vectors, so that only thresholds (one a leaf) reach the driver. Equal vectors are one node with a
weight. Vectors of each length have a forest of their own. Every vector is indexed and compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerweave.llm import packed
from offerweave.llm.components import connected_components
from offerweave.llm.shared import table

#: Trees at least; so many more that a pair at the limit is missed less often than MISSED.
TREES, MISSED = 6, 1e-4
#: Vectors whose projections fit the upper levels at most, that a leaf should hold, and that a
#: leaf needs to be fitted on.
SAMPLE, LEAF, LEAST = 16_384, 1_024, 16
#: Spill on each side of a split, in standard deviations of a linked pair's projected distance, and
#: the share of pairs at the limit that a level parts then: the excess of a normal difference over
#: twice the spill (0.17 deviations of 0.32) times the density of projections at the middle (0.4).
SPILL, PARTED = 0.5, 0.021
#: Numbers of a block of comparisons.
BLOCK = 4_000_000


class Tree:
    """A full binary tree of depth ``depth``: a direction a level, a threshold an inner node."""

    def __init__(self, size: int, depth: int, seed: int, margin: float):
        rng = np.random.default_rng([seed, size])
        self.seed, self.depth, self.margin = seed, depth, margin
        self.direction = rng.standard_normal((depth, size))
        self.direction /= np.linalg.norm(self.direction, axis=1, keepdims=True)
        self.threshold = np.zeros((1 << depth) - 1)

    def projections(self, x: np.ndarray, level: int = 0) -> np.ndarray:
        """Of unit vectors on the directions from ``level`` on."""
        return np.stack([project(x, d) for d in self.direction[level:]], 1) if self.depth > level else np.zeros((len(x), 0))

    def fit(self, p: np.ndarray, level: int, node: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        """(inner nodes, thresholds) below ``node`` of ``level`` down to level ``to``; p are the
        projections, from ``level`` on, of vectors that lie there."""
        at, nodes, cuts = [np.arange(len(p))], [], []
        for k in range(to - level):
            below = []
            for i, rows in enumerate(at):
                here = (1 << (level + k)) - 1 + (node << k) + i
                share = np.random.default_rng([self.seed, here]).uniform(0.4, 0.6)
                cut = np.quantile(p[rows, k], share) if len(rows) else 0.0
                nodes.append(here)
                cuts.append(cut)
                below += [rows[p[rows, k] <= cut], rows[p[rows, k] > cut]]
            at = below
        return np.array(nodes, np.int64), np.array(cuts)

    def place(self, x: np.ndarray, to: int) -> np.ndarray:
        """The node of level ``to`` that each vector lies in."""
        node = np.zeros(len(x), np.int64)
        for level in range(to):
            node = 2 * node + (project(x, self.direction[level]) > self.threshold[(1 << level) - 1 + node])
        return node

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each place of each vector."""
        rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(self.depth):
            cut = self.threshold[(1 << level) - 1 + node]
            p = project(x, self.direction[level])[rows]
            low, high = p <= cut + self.margin, p >= cut - self.margin
            rows, node = np.r_[rows[low], rows[high]], np.r_[2 * node[low], 2 * node[high] + 1]
        return rows, node


def project(x: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """Row by row, so that a vector's projection doesn't depend on what it is computed with."""
    return (x * direction).sum(1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


class Forest:
    """Trees for ``rows`` vectors of one length; one without a split if they fit a leaf. ``first``
    is the number of its first bucket."""

    def __init__(self, size: int, rows: int, least: float, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, first: int = 0):
        self.size, self.rows, self.first = size, rows, first
        self.depth = depth = max(0, int(np.ceil(np.log2(max(1, rows) / leaf))))
        self.top = min(depth, max(0, int(np.log2(max(1, min(rows, sample) / LEAST)))))
        if depth:
            trees = max(trees, int(np.ceil(np.log(MISSED) / np.log(1 - (1 - PARTED) ** depth))))
        margin = SPILL * np.sqrt(max(0.0, 2 - 2 * least) / size)
        self.trees = [Tree(size, depth, seed, margin) for seed in range(trees if depth else 1)]

    @property
    def buckets(self) -> int:
        return len(self.trees) << self.depth


def vectors_of(batch: pa.RecordBatch):
    """(length, rows, vectors) for each length in a batch."""
    column = batch.column("_v")
    lengths = np.diff(np.asarray(column.offsets))
    flat, at = np.asarray(column.flatten()), np.r_[0, np.cumsum(lengths)]
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield int(length), rows, flat[at[rows][:, None] + np.arange(length)]


def _share(classes: DataFrame, of: dict[int, float]) -> DataFrame:
    """About this share of the vectors of each length, chosen by their hash."""
    share = F.lit(0.0)
    for size, part in of.items():
        share = F.when(F.size("_v") == size, F.lit(part)).otherwise(share)
    return classes.filter((F.shiftrightunsigned(F.xxhash64("_key"), 11) / float(1 << 53)) < share)


def fit(forests: list[Forest], classes: DataFrame, sample: int = SAMPLE) -> None:
    """Thresholds of all trees."""
    by_size = {f.size: f for f in forests if f.depth}
    if not by_size:
        return

    def project_all(batches):
        for batch in batches:
            for size, _, v in vectors_of(batch):
                if size in by_size:
                    x = unit(v)
                    yield size, packed.pack(*(t.projections(x)[:, : by_size[size].top].astype(np.float32).ravel() for t in by_size[size].trees))

    got = {}
    for r in packed.map_rows(_share(classes, {f.size: min(1.0, sample / f.rows) for f in by_size.values()}), project_all).collect():
        got.setdefault(r["part"], []).append(packed.unpack(bytes(r["blob"])))
    for size, blobs in got.items():
        f = by_size[size]
        for t, p in zip(f.trees, zip(*blobs, strict=True), strict=True):
            nodes, cuts = t.fit(np.concatenate(p).astype(float).reshape(-1, f.top), 0, 0, f.top)
            t.threshold[nodes] = cuts

    deep = [f for f in forests if f.top < f.depth]
    if not deep:
        return
    by_size, first = {f.size: f for f in deep}, np.cumsum([0, *(len(f.trees) << f.top for f in deep)]).tolist()
    begin = {f.size: b for f, b in zip(deep, first, strict=False)}

    def place_all(batches):
        for batch in batches:
            for size, _, v in vectors_of(batch):
                f = by_size.get(size)
                x = unit(v) if f else None
                for k, t in enumerate(f.trees if f else ()):
                    p, node = t.projections(x, f.top).astype(np.float32), t.place(x, f.top)
                    for n, i in packed.by_part(node, 1 << f.top):
                        yield begin[size] + (k << f.top) + n, packed.pack(np.array([size, k, n]), p[i].ravel())

    def fit_below(batches):
        got = {}
        for blob in packed.blobs(batches):
            where, p = packed.unpack(blob)
            got.setdefault(tuple(where.tolist()), []).append(p)
        for (size, k, n), p in got.items():
            f = by_size[size]
            nodes, cuts = f.trees[k].fit(np.concatenate(p).astype(float).reshape(-1, f.depth - f.top), f.top, n, f.depth)
            yield size, packed.pack(np.array([k]), nodes, cuts)

    some = _share(classes, {f.size: min(1.0, LEAST * (1 << f.depth) / f.rows) for f in deep})
    sent = packed.send(packed.map_rows(some, place_all), first[-1])
    for r in packed.map_rows(sent, packed.by_bucket(fit_below, first[-1])).toLocalIterator():
        (k,), nodes, cuts = packed.unpack(bytes(r["blob"]))
        by_size[r["part"]].trees[k].threshold[nodes] = cuts


def pairs_within(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of unit vectors with cosine >= least, compared in blocks."""
    heads, tails = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(16, BLOCK // max(1, len(x)))
    for at in range(0, len(x), step):
        i, j = np.nonzero(x[at : at + step] @ x[at:].T >= least - 1e-9)
        a, b = at + i, at + j
        ok = a < b
        a, b = a[ok], b[ok]
        # one way of rounding for every pair
        exact = np.concatenate([(x[a[k : k + step]] * x[b[k : k + step]]).sum(1) >= least for k in range(0, len(a), step)] or [np.zeros(0, bool)])
        heads.append(a[exact])
        tails.append(b[exact])
    return np.concatenate(heads), np.concatenate(tails)


def _spread(forests: list[Forest]):
    by_size = {f.size: f for f in forests}

    def run(batches):
        for batch in batches:
            node, key, weight = (np.asarray(batch.column(c), np.int64) for c in ("_node", "_key", "_n"))
            for size, rows, v in vectors_of(batch):
                f, x = by_size[size], unit(v)
                for t, tree in enumerate(f.trees):
                    row, leaf = tree.route(x)
                    for p, i in packed.by_part(leaf, 1 << f.depth):
                        r = row[i]
                        yield f.first + (t << f.depth) + p, packed.pack(np.array([size, t, p]), v[r].ravel(), node[rows][r], key[rows][r], weight[rows][r], level=1)

    return run


def earlier(trees: list[Tree], tree: int, leaf: int, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share a leaf of an earlier tree, or an earlier leaf of this one."""
    out = np.zeros(len(a), bool)
    used, at = np.unique(np.r_[a, b], return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    for t in range(tree + 1):
        row, place = trees[t].route(x[used])
        if t == tree:
            row, place = row[place < leaf], place[place < leaf]
        leaves, column = np.unique(place, return_inverse=True)
        held = np.zeros((len(used), len(leaves)), bool)
        held[row, column] = True
        step = max(1, 4 * BLOCK // max(1, len(leaves)))
        for s in range(0, len(a), step):
            out[s : s + step] |= (held[i[s : s + step]] & held[j[s : s + step]]).any(1)
    return out


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each of n reaches over the pairs."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        m = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], m)
        np.minimum.at(label, label[b], m)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
    return label


COUNTS = "a long, b long, key long, links long"


def _compare(forests: list[Forest], least: float):
    by_size = {f.size: f for f in forests}

    def run(batches):
        held = {}
        for blob in packed.blobs(batches):
            x = packed.unpack(blob)
            held.setdefault(tuple(x[0].tolist()), []).append(x[1:])
        for (length, tree, leaf), got in held.items():
            v, node, key, weight = (np.concatenate(c) for c in zip(*got, strict=True))
            order = np.lexsort((key, node))
            x, node, key, weight = unit(v.reshape(-1, length)[order]), node[order], key[order], weight[order]
            a, b = pairs_within(x, least)
            if tree or leaf:
                new = ~earlier(by_size[length].trees, tree, leaf, x, a, b)
                a, b = a[new], b[new]
            links = np.bincount(a, weight[b], len(x)) + np.bincount(b, weight[a], len(x))
            label = least_labels(len(x), a, b)
            met = np.flatnonzero(links)
            yield pa.record_batch([pa.array(node[label[met]]), pa.array(node[met]), pa.array(key[met]), pa.array(links[met].astype(np.int64))], ["a", "b", "key", "links"])

    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Two vectors link if their cosine is ``least`` or more. A vector links with nothing if it is
    null, empty, zero, or holds a null or non-finite component, or if its id is null (then
    component_id is null and it isn't kept). Vectors of different lengths never link. Rows with
    equal vectors are linked copies, repeated rows too. Rows of one id with other vectors are one
    node of the components, but each counts the links of its own vector. An empty table gives no
    rows. Other columns are ignored.
    """
    v = F.col("_v")
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.transform(F.col(vector_col), lambda x: x + F.lit(0).cast("float")).alias("_v"))
    sound = (
        F.col("_id").isNotNull()
        & v.isNotNull()
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    rows = table(rows.withColumn("_v", F.when(sound, v)).withColumn("_key", F.when(F.col("_v").isNotNull(), F.xxhash64("_v"))))
    classes = table(rows.filter("_v is not null").groupBy("_key", "_v").agg(F.min("_id").alias("_node"), F.count(F.lit(1)).alias("_n")))
    forests, parts = [], 0
    for size, many in sorted(classes.groupBy(F.size("_v")).count().collect()):
        forests.append(Forest(size, many, least, trees, leaf, sample, parts))
        parts += forests[-1].buckets
    fit(forests, classes, sample)
    parts = max(1, parts)
    sent = packed.send(packed.map_rows(classes, _spread(forests)), parts)
    found = table(packed.map_batches(sent, packed.by_bucket(_compare(forests, least), parts), COUNTS))
    roots = connected_components(found.select("a", "b"))
    links = table(found.groupBy("b", "key").agg(F.sum("links").alias("_links")))
    named = table(
        classes.join(links, (classes["_node"] == links["b"]) & (classes["_key"] == links["key"]), "left")
        .join(roots, F.col("_node") == F.col("node"), "left")
        .select("_key", "_v", (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("n_links"), F.coalesce("root", "_node").alias("component_id"))
    )
    return rows.join(named, ["_key", "_v"], "left").select(
        F.col("_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "_id").alias("component_id"),
        F.coalesce(F.col("_id") == F.coalesce("component_id", "_id"), F.lit(False)).alias("kept"),
    )

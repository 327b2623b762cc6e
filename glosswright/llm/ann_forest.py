"""Approximate nearest neighbours: a forest of random-projection trees.

Trees are fitted on a bounded sample: a node parts its points by the hyperplane
midway between two of them, down to leaves of about ``LEAF`` points.  Every vector is
indexed, in one leaf of each tree.  A query walks all trees through one shared
priority queue, always into the subtree that the least margin keeps it from, until
it has met a share of all vectors (or all trees are walked); the leaves' vectors are
then compared exactly.

How many trees, and which share, is measured when the forest is fitted: some of the
sample's vectors look for their neighbours within the sample, and the setting that
finds ``AIM`` of them for the least share is taken.  Vectors that cluster need a
hundredth or so; vectors without near neighbours need most of the table, as any
index does, and the search then costs what comparing in blocks costs.

The forest (trees x nodes x width floats, a bound set by the sample) goes to the
workers once.  Queries are joined to leaves in blocks; each block returns only its
queries' best, so no list of candidates is ever gathered.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswright.llm import vectors
from glosswright.llm._shared import cut

#: Bounds of the index: vectors that trees are fitted on, numbers of trees tried, points aimed at in a leaf.
SAMPLE, TREES, LEAF = 16_384, (2, 4, 8), 128
#: Queries of the sample that measure the share, and the part of their neighbours that it must find.
TRIALS, AIM = 96, 0.95
#: Entries of each tree that a query meets at least, and queries of a block that meets a leaf.
LEAST, QUERIES = 512, 256


@dataclass
class Tree:
    """Node k splits by ``normal[k] @ x - offset[k]``; ``child[k]`` are nodes, or leaves as ~number."""

    normal: np.ndarray
    offset: np.ndarray
    child: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (open_ := at >= 0).any():
            k = at[open_]
            side = (np.einsum("ij,ij->i", x[open_], self.normal[k]) > self.offset[k]).astype(int)
            at[open_] = self.child[k, side]
        return ~at


def grow(x: np.ndarray, seed: int, leaf: int = LEAF) -> Tree:
    rng = np.random.default_rng(seed)
    normal, offset, child, leaves = [], [], [], 0
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        at, parent, side = todo.pop()
        cut_ = None
        if len(at) > leaf or parent < 0:
            for _ in range(4):
                a, b = x[rng.choice(at, 2, replace=len(at) < 2)] if len(at) else (np.ones(x.shape[1]), np.zeros(x.shape[1]))
                w = a - b
                size = np.linalg.norm(w)
                if size > 0:
                    w = w / size
                    mid = float(w @ (a + b) / 2)
                    right = x[at] @ w > mid
                    if parent < 0 or 0 < right.sum() < len(at):
                        cut_ = w, mid, right
                        break
            if cut_ is None and parent < 0:
                cut_ = np.ones(x.shape[1]), 0.0, x[at].sum(axis=1) > 0  # the root always splits
        if cut_ is None:
            child[parent][side] = ~leaves
            leaves += 1
            continue
        k = len(normal)
        normal.append(cut_[0])
        offset.append(cut_[1])
        child.append([0, 0])
        if parent >= 0:
            child[parent][side] = k
        todo += [(at[cut_[2]], k, 1), (at[~cut_[2]], k, 0)]
    return Tree(np.array(normal), np.array(offset), np.array(child))


def walk(forest: list[Tree], sizes: list[np.ndarray], q: np.ndarray, budget: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of one queue over all trees, nearest margins first, until ``budget`` vectors are met."""
    heap = [(0.0, t, 0) for t in range(len(forest))]
    found, met = [], 0
    side = [tree.normal @ q - tree.offset for tree in forest]
    while heap and met < budget:
        far, t, k = heapq.heappop(heap)
        tree = forest[t]
        while k >= 0:
            m = side[t][k]
            near = int(m > 0)
            heapq.heappush(heap, (max(far, abs(m)), t, int(tree.child[k, 1 - near])))
            k = int(tree.child[k, near])
        if sizes[t][~k]:
            found.append((t, ~k))
            met += int(sizes[t][~k])
    return found


def needed(forest: list[Tree], x: np.ndarray, k: int) -> float:
    """The share of the sample's entries that finds AIM of the ``k`` nearest of its trial queries."""
    if len(x) <= k + 1:
        return float(len(forest))
    leaf = np.array([t.leaves(x) for t in forest])
    sizes = [np.bincount(n) for n in leaf]
    met = []
    for q in np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        best = np.argpartition(d, k)[:k]
        seen, at = 0, {}
        for t, n in walk(forest, sizes, x[q], np.inf):
            seen += int(sizes[t][n])
            at[t, n] = seen
        met += [min(at[t, n] for t, n in enumerate(leaf[:, b])) for b in best.tolist()]
    return float(np.quantile(met, AIM, method="higher")) / len(x)


def search(
    rows: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
    trees: tuple[int, ...] = TREES, share: float | None = None, sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, key, score): each query's k nearest found by Euclidean distance, nearest first.

    ``is_query`` tells the queries among the rows; a query's own row is no candidate.
    Equal distances go to the smaller key.  Rows without a key, and vectors that are
    null, zero, or hold null or non-finite components, take no part.  Vectors of
    another width have no distance to each other: each width has a forest of its own.
    Rows that repeat a key and its vector are one; of other rows with one key each is
    a candidate.  With fewer than k candidates all are returned if met.  An empty
    table gives an empty table.  ``share`` replaces the measured share.
    """
    base = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q")).where("id is not null")
    # of a vector's copies none but the k + 1 smallest keys can be among anyone's k nearest
    v = cut(vectors.usable(base).groupBy("id", "v").agg(F.max("q").alias("q")))
    places = Window.partitionBy("h", "v").orderBy("id")
    numbered = v.withColumn("h", vectors.packed("v")).withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = numbered.withColumn("r", F.row_number().over(Window.partitionBy("h", "v", "slot").orderBy("id"))).where(F.col("r") <= k + 1)
    points = cut(some.withColumn("r", F.row_number().over(places)).where(F.col("r") <= k + 1).select("id", "v"))
    asked = v.where("q").select("id", "v")
    totals = {r["d"]: r["n"] for r in points.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # a number a width
    wide = {d: (points.where(F.size("v") == d), asked.where(F.size("v") == d)) for d in sorted(totals)}
    found = [_search(*wide[d], d, totals[d], k, trees, share, sample) for d in wide] or [_search(points, asked, 1, 0, k, trees, share, sample)]
    return reduce(DataFrame.union, found).select("query_id", "rank", F.col("id").alias(key), "score")


def _search(points: DataFrame, asked: DataFrame, width: int, total: int, k: int, trees: tuple[int, ...], share: float | None, sample: int) -> DataFrame:
    """(query_id, rank, id, score) among ``total`` points of one width."""
    spark = points.sparkSession
    draw = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = points.where(draw < min(1.0, sample / max(1, total))).orderBy("id").toPandas()
    x = np.array(drawn["v"].tolist()).reshape(len(drawn), width)
    every = [grow(x, 100 + t) for t in range(max(trees))]
    if share is None:
        share, count = min((needed(every[:t], x, k), t) for t in trees)
    else:
        count = trees[0]
    forest = every[:count]
    sent = spark.sparkContext.broadcast(forest)

    def matrix(column):
        return np.array(column.tolist()).reshape(len(column), width)

    def index(batches):
        for pdf in batches:
            if len(pdf):
                m = matrix(pdf["v"])
                blob = [r.tobytes() for r in m]
                for t, tree in enumerate(sent.value):
                    yield pd.DataFrame({"tree": t, "leaf": tree.leaves(m), "id": pdf["id"].to_numpy(), "x": blob})

    indexed = points.mapInPandas(index, "tree int, leaf int, id long, x binary")
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, total // (8 * sample))))  # a leaf outgrows its block only beyond the sample
    leaves = cut(
        indexed.groupBy("tree", "leaf", part.alias("part"))
        .agg(F.collect_list(F.struct("id", "x")).alias("members")).withColumn("n", F.size("members"))
    )
    counts = leaves.groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect()  # a number for each leaf of the forest
    sizes = [np.zeros(len(t.normal) + 1, np.int64) for t in forest]
    for r in counts:
        sizes[r["tree"]][r["leaf"]] = r["n"]
    known = spark.sparkContext.broadcast(sizes)
    budget = max(share * total, count * LEAST)

    def ask(batches):
        for pdf in batches:
            out = []
            for i, q in zip(pdf["id"], matrix(pdf["v"])) if len(pdf) else ():
                out += [(i, t, n, q.tobytes()) for t, n in walk(sent.value, known.value, q, budget)]
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=["query_id", "tree", "leaf", "y"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["query_id", "tree", "leaf", "y"])

    walks = asked.mapInPandas(ask, "query_id long, tree int, leaf int, y binary")
    group = F.pmod(F.xxhash64("query_id"), F.lit(max(1, total // (100 * QUERIES))))
    blocks = walks.groupBy("tree", "leaf", group.alias("g")).agg(F.collect_list(F.struct("query_id", "y")).alias("queries"))
    met = blocks.join(leaves, ["tree", "leaf"]).select("queries", "members")

    def best(batches):
        for pdf in batches:
            out = []
            for queries, members in zip(pdf["queries"], pdf["members"]):
                qi, q = np.array([r["query_id"] for r in queries]), np.frombuffer(b"".join(r["y"] for r in queries)).reshape(len(queries), width)
                ci, c = np.array([r["id"] for r in members]), np.frombuffer(b"".join(r["x"] for r in members)).reshape(len(members), width)
                qq, cc = (q * q).sum(1), (c * c).sum(1)
                rough = qq[:, None] + cc[None] - 2 * q @ c.T
                rough[qi[:, None] == ci[None]] = np.inf
                most = min(k, len(ci))
                i, j = np.nonzero(np.isfinite(rough))
                if len(ci) > most:
                    # rounding is relative to the norms, not to the distance: what may be nearer than the k-th comes too
                    edge = np.partition(rough, most - 1, axis=1)[:, most - 1]
                    room = 8e-16 * (width + 8) * (qq + cc.max())
                    i, j = np.nonzero((rough <= (edge + room)[:, None]) & np.isfinite(rough))
                square = np.zeros(len(i))
                for place in range(width):  # in the order of the places, whatever the library's sums do
                    square += (q[i, place] - c[j, place]) ** 2
                d = np.sqrt(square)
                order = np.lexsort((ci[j], d, i))
                i, j, d = i[order], j[order], d[order]
                near = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append(pd.DataFrame({"query_id": qi[i[near]], "id": ci[j[near]], "score": d[near]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    near = met.mapInPandas(best, "query_id long, id long, score double").groupBy("query_id", "id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

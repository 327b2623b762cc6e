"""Embedding near-duplicates: an exact metric range join.

Cosine c between unit vectors is the distance r = sqrt(2 - 2c).  Pivots (a bounded
sample of each label's vectors) part the vectors into cells, each vector's home
being its nearest pivot.  If x lives with pivot p and y is within r of x, then

* d(y, p) <= R + r by the triangle inequality, where R is the largest distance of
  p's residents, and d(y, p) <= d(y, q) + 2 r for every other pivot q;
* the border between p and q lies within r of y: (d(y, p)^2 - d(y, q)^2) / (2 d(p, q))
  <= r.  This follows from the same inequality in Euclidean space and is tighter.

y is replicated to every cell that these bounds allow, so each cell finds all
partners of its residents on its own.  Residents and visitors of a cell are both
cut into blocks of a bounded size, and every pair of blocks is joined by itself,
so no task gathers more than two blocks, however large a cell is.

Copies of one vector are joined as one, with a count.  A pair of blocks returns
counts and at most one link a vector (to the least vector of its part within the
blocks), never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswright.llm import vectors
from glosswright.llm._shared import connected_components, cut, local_components

#: Pivots of all labels together, and residents of a cell that are aimed at.
PIVOTS, CELL = 4_096, 2_048
#: Vectors of a block, and bytes that the vectors of a block may take.
BLOCK, BLOCK_BYTES = 8_192, 32 << 20
#: More than distances of unit vectors are wrong by; pivots nearer to each other than _CLOSE have no border.
_SLACK, _CLOSE = 1e-7, 1e-3


def _pivots(v: DataFrame) -> dict:
    """space -> matrix of unit vectors; a space gets a pivot for about CELL of its vectors."""
    counts = [(r[0], r[1]) for r in v.groupBy("space").agg(F.count("*")).orderBy(F.desc("count(1)"), "space").limit(PIVOTS).collect()]
    total = max(1, sum(n for _, n in counts))
    aim = max(CELL, math.ceil(total / PIVOTS))
    share = F.lit(0.0)
    for space, n in counts:
        share = F.when(F.col("space") == F.lit(space), F.lit(min(1.0, max(1, n // aim) * 4 / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(5), "class"), F.lit(1 << 30)) / float(1 << 30)
    got = v.where(draw < share).select("space", "class", "v").toPandas()  # about 4 PIVOTS vectors
    out = {}
    for space, n in counts:
        m = got[got["space"] == space].sort_values("class")
        if len(m):
            x = np.array(m["v"].tolist())
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            far, at = np.full(len(x), np.inf), [0]  # farthest-first: pivots spread out
            while len(at) < min(max(1, n // aim), len(x)):
                far = np.minimum(far, 2 - 2 * x @ x[at[-1]])
                at.append(int(far.argmax()))
            out[space] = x[at]
    return out


def _unit(column) -> np.ndarray:
    x = np.array(column.tolist())
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def allowed(d: np.ndarray, between: np.ndarray, radius: float) -> np.ndarray:
    """Which cells a vector must be sent to, by its distances to the pivots and theirs to each other.

    By the border nearest to it on the far side: against q, its own pivot, the tightest
    in practice, so that the bounds cost no more than the distances.
    """
    home = d.argmin(axis=1)
    own = d[np.arange(len(d)), home]
    apart = between[home]
    border = (d**2 - own[:, None] ** 2) / (2 * np.maximum(apart, _CLOSE))
    near = ((border <= radius + _SLACK) | (apart < _CLOSE)) & (d <= own[:, None] + 2 * radius + _SLACK)
    near[np.arange(len(d)), home] = True
    return near


def near_duplicates(rows: DataFrame, cosine: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept): links within a label at ``cosine`` or more, and what they connect.

    Rows whose vector is null, zero, or holds null or non-finite components, and rows
    without a label, link with nothing: they have no links and are their own
    component.  Vectors of another width are of another space and don't link with
    each other.  Rows that repeat a key are vectors of their own; as each other's
    partners they count as links, and they share the key.  A row with a null key
    takes part; it counts as a link, and its component is the smallest key that
    isn't null.  An empty table gives an empty table.
    """
    if not 0 < cosine <= 1:
        raise ValueError("a cosine over 0 and up to 1")
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK
    spark = rows.sparkSession
    base = rows.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    # a vector's space, of its label and width: nothing links across; null where it takes no part
    space = F.when(vectors.is_usable("v") & F.col("label").isNotNull(), F.concat(F.size("v").cast("string"), F.lit(":"), F.col("label").cast("string")))
    base = base.withColumn("space", space)
    one = F.xxhash64("space", F.transform("v", lambda x: x + F.lit(0.0)), F.lit(1))
    # the least key stands for all copies of a vector
    each = cut(base.where("space is not null").withColumn("class", one).groupBy("space", "class")
               .agg(F.min("key").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v")))
    pivots = _pivots(each)
    # PIVOTS vectors at most, and their distances to each other within a space
    sent = spark.sparkContext.broadcast({s: (p, np.sqrt(np.maximum(0.0, 2 - 2 * p @ p.T))) for s, p in pivots.items()})

    def distances(pdf):
        """(space, rows, unit vectors, distances to their space's pivots, where they must go), a few rows at a time."""
        for name, part in pdf.groupby("space", sort=False):
            p, between = sent.value.get(name, (None, None))
            few = max(16, (1 << 21) // (1 if p is None else len(p)))
            for a in range(0, len(part), few):
                some = part.iloc[a : a + few]
                x = _unit(some["v"])
                if p is None:  # a rare space: one cell
                    d = np.zeros((len(x), 1))
                    yield name, some, x, d, np.ones(d.shape, bool)
                else:
                    d = np.sqrt(np.maximum(0.0, 2 - 2 * x @ p.T))
                    yield name, some, x, d, allowed(d, between, radius)

    def homes(batches):
        for pdf in batches:
            for name, part, x, d, near in distances(pdf):
                at = d.argmin(axis=1)
                yield pd.DataFrame({"space": name, "cell": at, "far": d[np.arange(len(at)), at]})

    def visits(batches):
        for pdf in batches:
            for name, part, x, d, near in distances(pdf):
                far = np.array([known.value.get((name, c), (-1.0, 0))[0] for c in range(d.shape[1])])
                n = (near & (d <= far + radius + _SLACK)).sum(axis=0)
                cell = np.flatnonzero(n)
                yield pd.DataFrame({"space": name, "cell": cell, "n": n[cell]})

    vecs = each.select("space", "class", "copies", "v")
    # numbers for each pivot: the farthest resident, how many live there, how many visit
    reach = {
        (r["space"], r["cell"]): (r["far"], r["n"])
        for r in vecs.mapInPandas(homes, "space string, cell int, far double").groupBy("space", "cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()
    }
    known = spark.sparkContext.broadcast(reach)
    seen = {
        (r["space"], r["cell"]): r["n"]
        for r in vecs.mapInPandas(visits, "space string, cell int, n long").groupBy("space", "cell").agg(F.sum("n").alias("n")).collect()
    }
    guests = spark.sparkContext.broadcast(seen)

    def deal(batches):
        for pdf in batches:
            for name, part, x, d, near in distances(pdf):
                size = max(1, min(BLOCK, BLOCK_BYTES // (8 * x.shape[1])))
                cells = range(d.shape[1])
                far, n = np.array([known.value.get((name, c), (-1.0, 0)) for c in cells]).T
                left = -(-n.astype(np.int64) // size)
                right = -(-np.array([guests.value.get((name, c), 0) for c in cells]) // size)
                turn = part["class"].to_numpy().view(np.uint64) >> np.uint64(8)
                # a resident meets every block of visitors (residents among them), a visitor every block of residents
                home = d.argmin(axis=1)
                who, cell = np.nonzero(near & (d <= far + radius + _SLACK) & (n > 0))
                for side, row, c, mine, others in ((0, np.arange(len(x)), home, left, right[home]), (1, who, cell, right, left[cell])):
                    block = (turn[row] % mine[c].astype(np.uint64)).astype(np.int64)
                    at = np.repeat(np.arange(len(row)), others)
                    other = np.arange(len(at)) - np.repeat(np.cumsum(others) - others, others)
                    for k in range(0, len(at), 20_000):
                        z, o = at[k : k + 20_000], other[k : k + 20_000]
                        a, b = (block[z], o) if side == 0 else (o, block[z])
                        yield pd.DataFrame({
                            "space": name, "cell": c[z], "a": a, "b": b, "side": side, "class": part["class"].to_numpy()[row[z]],
                            "copies": part["copies"].to_numpy()[row[z]], "x": [x[r].tobytes() for r in row[z]],
                        })

    dealt = vecs.mapInPandas(deal, "space string, cell int, a int, b int, side int, class long, copies long, x binary")

    def join(pdf):
        pdf = pdf.sort_values("class")
        here, there = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(here) or not len(there):
            return pd.DataFrame({"a": [], "b": [], "links": []}, dtype=np.int64)
        x, y = (np.frombuffer(b"".join(p["x"]), np.float64).reshape(len(p), -1) for p in (here, there))
        cls = np.unique(np.concatenate([here["class"], there["class"]]))
        i_of, j_of = np.searchsorted(cls, here["class"]), np.searchsorted(cls, there["class"])
        copies = there["copies"].to_numpy()
        links = np.zeros(len(x), np.int64)
        root = np.arange(len(cls))
        for a in range(0, len(y), 1024):
            sim = x @ y[a : a + 1024].T
            i, j = np.nonzero((sim >= cosine) | (i_of[:, None] == j_of[None, a : a + 1024]))  # a vector always meets itself
            j += a
            links += np.bincount(i, weights=copies[j], minlength=len(x)).astype(np.int64)
            root = local_components(len(cls), np.r_[root, i_of[i]], np.r_[np.arange(len(cls)), j_of[j]])
        tied = np.flatnonzero(root != np.arange(len(root)))
        own = here["class"].to_numpy()
        return pd.DataFrame({"a": np.r_[own, cls[tied]], "b": np.r_[own, cls[root[tied]]], "links": np.r_[links, np.zeros(len(tied), np.int64)]})

    found = cut(dealt.groupBy("space", "cell", "a", "b").applyInPandas(join, "a long, b long, links long"))
    parts = connected_components(found.select("a", "b"), "a", "b").select(F.col("node").alias("class"), F.col("component").alias("part"))
    links = found.where("a = b").groupBy(F.col("a").alias("class")).agg((F.sum("links") - 1).alias("n_links"))
    tied = each.select("class", "least").join(links, "class", "left").join(parts, "class", "left").withColumn("part", F.coalesce("part", "class"))
    first = cut(tied.groupBy("part").agg(F.min("least").alias("component_id")))
    of = tied.join(first, "part").select("class", "n_links", "component_id")
    # every row either takes part or not, whatever rows share its key
    inside = base.where("space is not null").select("key", one.alias("class")).join(of, "class").select("key", "n_links", "component_id")
    outside = base.where("space is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return inside.union(outside).select(
        F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept")
    )

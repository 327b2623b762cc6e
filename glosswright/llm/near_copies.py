"""Near copies of texts: an exact similarity join on sets of word shingles.

Two texts link if their sets of shingles have a Jaccard similarity of 4/5 or more.
Candidates come from SimHash fingerprints first, up to 5 bits apart and found by their
Golay keys (``golay_simhash.candidates``); they are compared exactly, and those that
link to one form a part.  But no distance of fingerprints bounds that similarity, so
what they leave in different parts goes through prefix filtering, which loses none:
in any one order of all shingles, two sets of n and m shingles that similar share a
shingle among the first n - ceil(4n/5) + 1 and m - ceil(4m/5) + 1.  The order puts
shingles that are common in a sample last, which costs or saves time only.  As
similar sets are of similar size, sets meet by shingle and class of size.

Candidates must pass a bound before their texts are compared: with a bitmap whose
bits are toggled by a set's shingles, the bits in which two bitmaps differ are at
most the shingles in which the sets differ.

A large group of near copies is not paired out.  First the sets that share a
shingle, unless they are one part already, are compared with one of them only, whose
shingles are the most shared: of copies with edits of their own that is the original.  Then, of the sets that share a
shingle, just those that this left in different components are paired, and compared
exactly as well.  Two sets that share many shingles of their prefixes would meet at each;
so sets with many shingles that lead to other components look for each other apart, by
prefixes in the order of how many of them have a shingle (``_rarest``), which is exact in the same way.
To be compared, the texts of a pair's second member travel to the first, which is read
once for many of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswright.llm import golay_simhash
from glosswright.llm._shared import connected_components, cut, local_components, slices
from glosswright.llm.byte_windows import mix

#: Texts sampled for common shingles, and the most shingles that are kept as common.
SAMPLE, COMMON = 16_384, 65_536
#: Bits of the filter that keeps texts at home which no pair names, and pairs that one task compares with a text.
NAMED, TASK = 1 << 24, 1_024
#: Shingles in classes of size that lead a set to other components, from which on its order is by their exact number.
MANY = 64
#: Links whose components one task finds.
LINKS = 1 << 20
#: Bytes of text that are hashed at once, in arrays of some thirty times their size.
PIECE = 1 << 19
#: Sizes of a class are within this factor; a hair over 5/4, so that similar sets are at most one class apart.
CLASS = 1.250001
#: Bits of every set's bitmap, and of the widest that a large set has beside it: twice its size, so that it isn't full.
_WIDE, WIDEST = 512, 1 << 17
_BITS = [f"b{k}" for k in range(_WIDE // 64)]
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_POWER = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _pieces(raw: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
    """Texts laid end to end, PIECE bytes or so at a time, longer ones cut at white space: (bytes, words' owners' ends)."""
    held, ends, size = [], [], 0
    for x in raw:
        a = 0
        while len(x) - a > PIECE:
            cut_ = re.compile(rb"[ \t-\r]").search(x, a + PIECE // 2)
            if cut_ is None:
                break
            held.append(x[a : cut_.start()] + b"\n")
            size += len(held[-1])
            a = cut_.end()
            yield b"".join(held), [*ends, -1]
            held, ends, size = [], [], 0
        held.append(x[a:] + b"\n")
        size += len(held[-1])
        ends.append(size)
        if size >= PIECE:
            yield b"".join(held), ends
            held, ends, size = [], [], 0
    if held:
        yield b"".join(held), ends


def _word_hashes(raw: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """The hashes of all texts' words, one after the other, and the number of words up to each text's end."""
    hashes, upto, n = [], [], 0
    for piece, ends in _pieces(raw):
        data = np.frombuffer(piece, np.uint8)
        gap = _GAP[data]
        head = ~gap
        head[1:] &= gap[:-1]
        begin = np.flatnonzero(head)
        if len(begin):
            with np.errstate(over="ignore"):
                place = np.arange(len(data), dtype=np.int32) - begin.astype(np.int32)[np.maximum(np.cumsum(head, dtype=np.int32) - 1, 0)]
                place &= 63
                value = _POWER[place]
                value *= _LOWER[data]
                value[gap] = 0
                size = np.add.reduceat((~gap).astype(np.int32), begin)
                hashes.append(mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * _STEP))
        upto += [n + int(np.searchsorted(begin, e)) for e in ends if e >= 0]
        n += len(begin)
    return np.concatenate([*hashes, np.empty(0, np.uint64)]), upto


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; of all its words where they are fewer.

    Words are as in ``golay_simhash.fingerprint``: only A-Z change case, only ASCII
    white space parts them.
    """
    h, upto = _word_hashes([(t or "").encode() for t in texts])
    n = max(len(h) - words + 1, 0)
    run = np.zeros(n, np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for k in range(words if n else 0):
            run = mix(run * _STEP + h[k : k + n])
        for a, b in zip([0, *upto[:-1]], upto):
            if b - a >= words:
                out.append(np.unique(run[a : b - words + 1]))
            else:
                x = np.full(min(b - a, 1), b - a, np.uint64)
                for k in range(a, b):
                    x = mix(x * _STEP + h[k])
                out.append(x)
    return out


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    return shingle_sets([text], words)[0]


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 4/5 or more."""
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))


def _wide(h: np.ndarray) -> bytes | None:
    """A large set's own bitmap; narrower ones are its halves laid over each other."""
    if 2 * len(h) <= _WIDE:
        return None
    size = min(WIDEST, 1 << (2 * len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def _least_apart(a: bytes, b: bytes) -> int:
    """How many shingles two large sets differ in at least."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _common(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in ascending order, texts of the sample that have them): those of two texts or more."""
    share = min(1.0, SAMPLE / max(1, rows.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(b.column(0).to_pylist(), words)).view(np.int64))], names=["h"])

    draw = F.pmod(F.xxhash64(F.lit(7), "row"), F.lit(1 << 30)) < int(share * (1 << 30))
    got = (
        rows.where(draw).select("text").mapInArrow(run, "h long")
        .groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    )
    h, n = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _sets(words: int, common):
    """(row, two halves of the set's hash, size, fingerprint, bitmap, prefix) of every text."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = common.value
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            fp = np.array([golay_simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
            name, size, bits, wide, prefix = [], [], [], [], []
            for h in shingle_sets(texts, words):
                name.append(xxhash.xxh3_128_digest(h.tobytes()))
                size.append(len(h))
                bits.append(np.packbits(np.bincount((h & np.uint64(_WIDE - 1)).astype(np.int64), minlength=_WIDE) & 1))
                wide.append(_wide(h))
                n = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    n = np.where(known[at] == h, often[at], 0)
                first = np.argsort(n, kind="stable")[: len(h) - (4 * len(h) + 4) // 5 + 1]  # h ascends: of equals the least first
                prefix.append(h[first].view(np.int64))
            name = np.frombuffer(b"".join(name), np.int64).reshape(-1, 2)
            bits = np.stack(bits).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), *(pa.array(np.ascontiguousarray(x)) for x in (*name.T, np.array(size, np.int64), fp, *bits.T)),
                    pa.array(wide, pa.binary()), pa.array(prefix, pa.list_(pa.int64())),
                ],
                names=["row", "h1", "h2", "n", "fp", *_BITS, "wide", "prefix"],
            )

    return run


def _named(rows: DataFrame) -> np.ndarray:
    """A filter of NAMED bits, set for the numbers ``row``: bounded, whatever they are."""
    at = F.pmod(F.xxhash64("row"), F.lit(NAMED)).alias("at")
    got = rows.select(at).selectExpr("at div 64 AS w", "shiftleft(1L, cast(at % 64 AS int)) AS bit").groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(NAMED // 64, np.int64)
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def _let_through(sent):
    """(row, text) of those (row, text, at) that a filter of ``_named`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(2).to_numpy()
            keep = sent.value[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)
            yield b.select([0, 1]).filter(pa.array(keep.astype(bool)))

    return run


def _verified(pairs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose texts are similar."""
    sent = rows.sparkSession.sparkContext.broadcast(_named(pairs.select(F.explode(F.array("a", "b")).alias("row"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.empty(0, np.uint64)
        for b in slices(batches, 3):
            sets = shingle_sets(b.column(3).to_pylist(), words)
            keep = []
            for a, other, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), sets):
                if other is None:
                    at, own = a, s
                keep.append(other is not None and at == a and similar(own, s))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)], names=["a", "b"]).filter(pa.array(keep))

    texts = rows.select("row", "text", F.pmod(F.xxhash64("row"), F.lit(NAMED)).alias("at")).mapInArrow(_let_through(sent), "row long, text string")
    turns = pairs.groupBy("a").agg(F.ceil(F.count("*") / TASK).cast("int").alias("turns"))
    turn = F.pmod(F.xxhash64("b"), F.col("turns")).cast("int").alias("turn")
    asked = pairs.join(turns, "a").select("a", turn, "b").join(texts.select(F.col("row").alias("b"), "text"), "b").select("a", "turn", "b", "text")
    own = texts.withColumnRenamed("row", "a").join(turns, "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(None).cast("long").alias("b"), "text"
    )
    met = asked.unionByName(own).repartition("a", "turn").sortWithinPartitions("a", "turn", F.asc_nulls_first("b"))
    return cut(met.select("a", "turn", "b", "text").mapInArrow(run, "a long, b long"))


def _rarest(dense: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(token, node, part): the prefixes of the sets of ``dense`` (node, part), as far as a shingle is in several parts.

    The order puts shingles that are in one part only first, then those that fewer of
    these sets have; both are counted over all their shingles, so similar sets in
    different parts share one that is left here.
    """
    sent = rows.sparkSession.sparkContext.broadcast(_named(dense.select(F.col("node").alias("row"))))
    named = _let_through(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(named(batches)):
            sets = [h.view(np.int64) for h in shingle_sets(b.column(1).to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "tokens"])

    every = rows.select("row", "text", F.pmod(F.xxhash64("row"), F.lit(NAMED)).alias("at")).mapInArrow(run, "node long, tokens array<long>")
    every = every.join(dense, "node").select("node", "part", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    by_token, by_node = Window.partitionBy("token"), Window.partitionBy("node")
    often = (
        every.withColumn("low", F.min("part").over(by_token)).withColumn("high", F.max("part").over(by_token))
        .withColumn("often", F.count("*").over(by_token)).where("low < high")
    )
    ranked = often.withColumn("rank", F.row_number().over(by_node.orderBy("often", "token"))).withColumn("several", F.count("*").over(by_node))
    return cut(ranked.where("rank <= several - (4 * n + 4) div 5 + 1").select("token", "node", "part"), slim=True)


def _components(links: DataFrame) -> DataFrame:
    """(node, component) of the links (a, b): in one task where they are few, else by rounds."""
    if links.count() > LINKS:
        return connected_components(links, "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [b.column(k).to_numpy() for b in batches for k in (0, 1)]
        a, b = (np.concatenate([np.empty(0, np.int64), *ends[k::2]]) for k in (0, 1))
        node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        least = node[local_components(len(node), at[: len(a)], at[len(a) :])]
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], names=["node", "component"])

    return cut(links.select("a", "b").coalesce(1).mapInArrow(run, "node long, component long"), slim=True)


def groups(docs: DataFrame, key: str, text: str = "text", words: int = 5) -> DataFrame:
    """(key, group): the smallest key that is reachable over links, for every row.

    ``key`` must be a long that is unique and not null, and the same whenever
    ``docs`` is computed.  A text of up to ``words`` words is one shingle.  Null,
    empty and blank texts have no shingle; they are one group.
    An empty table gives an empty table.
    """
    rows = docs.select(F.col(key).alias("row"), F.col(text).cast("string").alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(_common(rows, words))
    kinds = ", ".join(f"{c} long" for c in ("row", "h1", "h2", "n", "fp", *_BITS))
    sets = cut(rows.mapInArrow(_sets(words, common), f"{kinds}, wide binary, prefix array<long>"))
    # equal sets are one node
    same = cut(sets.groupBy("h1", "h2").agg(F.min("row").alias("node")), slim=True)
    nodes = sets.join(same.select(F.col("node").alias("row")), "row", "left_semi")
    info = nodes.select(F.col("row").alias("node"), "n", *_BITS, "wide")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*(F.col(c).alias(name if c == "node" else f"{name}_{c}") for c in df.columns))

    apart: Column = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _BITS), F.lit(0))
    may = (5 * F.least("a_n", "b_n") >= 4 * F.greatest("a_n", "b_n")) & (9 * apart <= F.col("a_n") + F.col("b_n"))

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [x is None or y is None or 9 * _least_apart(x, y) <= n for n, x, y in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def plausible(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side(info, "a"), "a").join(side(info, "b"), "b").where(may)
        return cut(both.select("a", "b", F.col("a_n") + F.col("b_n"), "a_wide", "b_wide").mapInArrow(wide, "a long, b long"), slim=True)

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # by fingerprints: of sets with the same one each meets the least, which stands for it among near ones
    prints = nodes.select(F.col("row").alias("node"), "fp")
    least = cut(prints.groupBy("fp").agg(F.min("node").alias("least")), slim=True)
    near = golay_simhash.candidates(least).join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a")
    near = near.join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    alike = prints.join(least, "fp").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    tried = plausible(ordered(near.union(alike)))
    links = _verified(tried, rows, words)
    # sets whose least neighbour is one are connected: parts of components, without rounds
    parts = links.union(links.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    # a set is at home in its class of size and a guest in the next
    kind = F.floor(F.log("n") / float(np.log(CLASS))).cast("int")
    by_token, by_class = Window.partitionBy("token"), Window.partitionBy("token", "kind")
    classes = F.explode(F.array(F.struct(F.col("kind"), F.lit(True).alias("home")), F.struct((F.col("kind") + 1).alias("kind"), F.lit(False).alias("home")))).alias("k")
    part = F.coalesce("component", "node").alias("part")
    shared = cut(
        nodes.select(F.col("row").alias("node"), kind.alias("kind"), "prefix").join(parts, "node", "left")
        .select("node", "kind", part, F.explode("prefix").alias("token")).repartition("token")
        .withColumn("lo", F.min("part").over(by_token)).withColumn("hi", F.max("part").over(by_token)).where("lo < hi")
        .select("token", "node", "part", classes).select("token", "node", "part", "k.kind", "k.home")
        .withColumn("met", F.count("*").over(by_class)).withColumn("homes", F.max("home").over(by_class)).where("met > 1 and homes").drop("homes")
    )
    weight = shared.groupBy("node").agg(F.sum("met").alias("weight"))
    shared = cut(shared.drop("met").join(weight, "node"))
    best = F.max(F.struct("weight", (-F.col("node")).alias("minus"), "home", "part")).over(by_class)
    stars = shared.withColumn("best", best).where((F.col("best.part") != F.col("part")) & (F.col("best.home") | F.col("home")))
    stars = cut(ordered(stars.select(F.col("node").alias("a"), (-F.col("best.minus")).alias("b"))), slim=True)
    links = links.union(_verified(plausible(stars.join(tried, ["a", "b"], "left_anti")), rows, words))
    tried = tried.union(stars)
    parts = _components(links)
    members = cut(shared.drop("part").join(parts, "node", "left").select("token", "kind", "node", "home", part))
    del shared, stars

    def parted(met: DataFrame, *by: str) -> DataFrame:
        """Those that meet in different components; of two such sets, one at least isn't in the main component of those that meet."""
        main = met.groupBy(*by).agg(F.mode("part", deterministic=True).alias("main"), F.min("part").alias("low"), F.max("part").alias("high"))
        return cut(met.join(main.where("low < high").select(*by, "main"), [*by]), slim=True)

    def across(met: DataFrame, where: Column, *by: str) -> DataFrame:
        met = met.join(info.drop("wide"), "node")
        few, every = side(met.where("part != main").drop("main"), "a"), side(met.drop("main"), "b")
        meet = (F.col("a_part") != F.col("b_part")) & where & may
        return few.join(every, [F.col(f"a_{c}") == F.col(f"b_{c}") for c in by] + [meet]).select("a", "b")

    open_ = parted(members, "token", "kind")
    del members
    dense = cut(open_.groupBy("node").agg(F.first("part").alias("part"), F.count("*").alias("n")).where(F.col("n") > MANY).select("node", "part"), slim=True)
    open_ = open_.join(dense.select("node", F.lit(True).alias("dense")), "node", "left").withColumn("dense", F.coalesce("dense", F.lit(False)))
    rest = across(open_, (F.col("a_home") | F.col("b_home")) & ~(F.col("a_dense") & F.col("b_dense")), "token", "kind")
    if not dense.isEmpty():
        rest = rest.union(across(parted(_rarest(dense, rows, words), "token"), F.lit(True), "token"))
    rest = plausible(ordered(rest).join(tried, ["a", "b"], "left_anti"))
    del open_, dense
    if not rest.isEmpty():
        parts = _components(links.union(_verified(rest, rows, words)))
    tied = same.join(parts, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("group"))
    return sets.join(tied, ["h1", "h2"]).select(F.col("row").alias(key), "group")

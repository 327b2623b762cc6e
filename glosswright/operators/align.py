"""Passages found in full texts, exactly or with insertions and deletions; positions between text versions.

The cost of a match is the number of characters inserted or deleted, a
substitution counting as both.  Candidates come from pairs of words that a passage
and a text share, an equality join; such pairs name places of the text, and only
windows around these are aligned, in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswright.functions import text as t
from glosswright.operators import intervals

#: Words of a seed, and seeds of all passages up to which workers get them to drop what can't join.
SEED, KNOWN = 2, 1 << 20
#: Letters of the longest chunk that is aligned at once, and the gap over which chunks' places become one.
CHUNK, CHUNK_GAP = 500, 100
#: Letters of all chunks up to which workers hold the chunks, and of texts that they look through at once.
HELD, AT_ONCE = 1 << 21, 1 << 21
#: Hits of seeds that are looked at together, windows side by side, letters of a stretch of a window, and classes of letters.
HITS, LANES, STRETCH, LETTERS = 1 << 21, 8192, 2048, 128
_POWER = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def plain(x: str | Column) -> Column:
    """Text with white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(x, "\\s+", " "))


def shingles(text: str | Column, n: int) -> Column:
    """Runs of n words of a plain text, none if it has fewer.

    The words are laid beside themselves shifted, so the text is split n times,
    not once for every position.
    """
    w = F.split(text, " ")
    shifted = F.arrays_zip(*(F.slice(w, k + 1, F.greatest(F.size(w), F.lit(1))).alias(f"w{k}") for k in range(n)))
    runs = F.transform(shifted, lambda z: F.concat_ws(" ", *(z[f"w{k}"] for k in range(n))))
    return F.slice(runs, 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))


def shingle_keys(text: str | Column, n: int) -> Column:
    """Hashes of the runs of n words of a plain text, without writing them out."""
    w = F.split(text, " ")
    shifted = F.arrays_zip(*(F.slice(w, k + 1, F.greatest(F.size(w), F.lit(1))).alias(f"w{k}") for k in range(n)))
    keys = F.transform(shifted, lambda z: F.xxhash64(*(z[f"w{k}"] for k in range(n))))
    return F.slice(keys, 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))


def containing(docs: DataFrame, passages: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", words: int = 5) -> DataFrame:
    """(doc, item): texts that hold a passage word for word (J10, exact tier).

    A text that holds a passage holds its first ``words`` words (all of a shorter
    one), so texts are compared with passages that they share these with only.
    Texts are read once for the words and looked up once for the comparison.
    """
    p = passages.where(F.col(text).isNotNull()).select(item, plain(text).alias("p")).where("p <> ''").withColumn("w", F.split("p", " "))
    p = p.withColumn("n", F.least(F.size("w"), F.lit(words)))
    # as many words as the passage has, up to ``words``: the key of a short one hashes fewer
    key = F.coalesce(*(F.when(F.col("n") == n, F.xxhash64(*(F.col("w")[k] for k in range(n)))) for n in range(1, words + 1)))
    p = p.withColumn("key", key)
    lengths = sorted(r["n"] for r in p.select("n").distinct().collect())  # at most ``words`` numbers
    d = docs.where(F.col(text).isNotNull()).select(doc, plain(text).alias("d"))
    keys = F.array_distinct(F.flatten(F.array(*(shingle_keys("d", n) for n in lengths or [words]))))
    met = d.select(doc, F.explode(keys).alias("key")).join(p.select("key", item), "key").groupBy(doc).agg(F.collect_set(item).alias("items"))
    pairs = d.join(met, doc).select(doc, "d", F.explode("items").alias(item)).join(p.select(item, "p"), item)
    found = pairs.where(F.instr(F.concat(F.lit(" "), F.col("d"), F.lit(" ")), F.concat(F.lit(" "), F.col("p"), F.lit(" "))) > 0)
    return found.select(doc, item).distinct()


def word_seeds(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, place) of every run of SEED words of plain texts, places in characters."""
    data = np.frombuffer("".join([x + "\n" for x in texts]).encode(), np.uint8)
    line = np.flatnonzero(data == 10)
    gap = (data == 10) | (data == 32)
    start = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1]))[: len(data)])
    if len(start) < SEED:
        return (np.empty(0, np.int64),) * 3
    nth = np.cumsum(np.isin(np.arange(len(data)), start, assume_unique=True)) - 1
    at = np.arange(len(data)) - start[np.maximum(nth, 0)]
    with np.errstate(over="ignore"):
        h = np.add.reduceat(np.where(gap, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * _POWER[at & 63]), start)
        h ^= h >> np.uint64(29)
        key = h[: len(h) - SEED + 1].copy()
        for k in range(1, SEED):
            key = key * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - SEED + 1 + k]
    row = np.searchsorted(line, start)
    same = row[: len(key)] == row[SEED - 1 :]
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    begin = np.concatenate(([0], char[line[:-1]] + 1))
    row, start = row[: len(key)][same], start[: len(key)][same]
    return row, key[same].view(np.int64), char[start] - begin[row]


def seeds(rows: DataFrame, key: str, text: str, known: np.ndarray | None = None) -> DataFrame:
    """(key, seed, place) of a table's plain texts, of those that are ``known`` only if they are given."""
    sent = None if known is None else rows.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                row, seed, place = word_seeds(part.column(1).to_pylist())
                if sent is not None:
                    at = np.minimum(np.searchsorted(sent.value, seed), max(0, len(sent.value) - 1))
                    keep = sent.value[at] == seed if len(sent.value) else np.zeros(len(seed), bool)
                    row, seed, place = row[keep], seed[keep], place[keep]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(seed), pa.array(place, pa.int32())], names=[key, "seed", "place"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, seed long, place int")


def best_match(text: str, pattern: str) -> tuple[int, int, int]:
    """(start, end, cost) of the substring nearest to the pattern; of equals the one that ends first, then the longest."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    p = np.frombuffer(pattern.encode("utf-32-le"), np.uint32)
    m = len(p)
    # row i: cheapest alignment of p[:i] ending at every place of the text, and where it starts
    cost, start = np.zeros(len(x) + 1, np.int64), np.arange(len(x) + 1)
    step = np.arange(len(x) + 1)
    for i in range(1, m + 1):
        up, up_start = cost + 1, start.copy()
        same = np.flatnonzero(x == p[i - 1]) + 1
        better = cost[same - 1] < up[same]
        at = same[better]
        up[at], up_start[at] = cost[at - 1], start[at - 1]
        # insertions of text characters: cost[j] = min over k <= j of up[k] + (j - k)
        low = up - step
        run = np.minimum.accumulate(low)
        keep = np.maximum.accumulate(np.where(low == run, step, -1))
        cost, start = run + step, up_start[keep]
    end = int(cost.argmin())
    return int(start[end]), end, int(cost[end])


def least_costs(texts: list[str], patterns: list[str], side_by_side: int = 64) -> np.ndarray:
    """The cost of each pattern's best match in its text, for many pairs side by side.

    A row of the table is computed for all pairs at once; pairs are ordered by length,
    so that little of it is padding (a text's padding costs as much as it is long).
    """
    out = np.zeros(len(texts), np.int64)
    order = sorted(range(len(texts)), key=lambda k: (len(patterns[k]), len(texts[k])))
    points = lambda x: np.frombuffer(x.encode("utf-32-le"), np.uint32).astype(np.int32)
    for a in range(0, len(order), side_by_side):
        part = order[a : a + side_by_side]
        wide, high = max(len(texts[k]) for k in part), max(len(patterns[k]) for k in part)
        x, p = np.full((len(part), wide), -1, np.int32), np.full((high, len(part), 1), -2, np.int32)
        for n, k in enumerate(part):
            x[n, : len(texts[k])] = points(texts[k])
            p[: len(patterns[k]), n, 0] = points(patterns[k])
        size = np.array([len(patterns[k]) for k in part])
        step = np.arange(wide + 1, dtype=np.int32)
        cost = np.zeros((len(part), wide + 1), np.int32)
        best = np.zeros(len(part), np.int64)
        for i in range(high):
            up = cost + 1
            np.minimum(up[:, 1:], cost[:, :-1], out=up[:, 1:], where=x == p[i])
            up -= step
            cost = np.minimum.accumulate(up, axis=1) + step
            done = size == i + 1
            if done.any():
                best[done] = cost[done].min(axis=1)
        out[part] = best
    return out


def letters(x: str) -> np.ndarray:
    """The class of each letter; letters that share one count as equal in lower bounds, which stay lower bounds."""
    return (np.frombuffer(x.encode("utf-32-le"), np.uint32) % LETTERS).astype(np.uint8)


class Pieces:
    """Patterns cut into pieces of 64 letters at most, as bits: what ``may_hold`` looks for."""

    def __init__(self, patterns: list[str]):
        code = [letters(x) for x in patterns]
        self.size = np.array([len(x) for x in code], np.int64)
        self.count = -(-self.size // 64)
        self.length = np.zeros((max(1, int(self.count.max(initial=0))), len(code)), np.int64)
        self.bits = []
        for k in range(len(self.length)):
            bits = np.zeros((len(code), LETTERS), np.uint64)
            for i in np.flatnonzero(self.count > k):
                a, b = (int(self.size[i] * j // self.count[i]) for j in (k, k + 1))
                self.length[k, i] = b - a
                # the last letter has the highest bit; rows below the first letter match all, and so cost nothing
                bits[i] = np.uint64((1 << (64 - (b - a))) - 1)
                np.bitwise_or.at(bits[i], code[i][a:b], np.uint64(1) << np.arange(64 - (b - a), 64, dtype=np.uint64))
            self.bits.append(bits.ravel())


def _least_edits(data: np.ndarray, begin: np.ndarray, size: np.ndarray, bits: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The fewest edits (a substitution as one) between a piece and a substring of its stretch of ``data``.

    The bit-parallel method of Myers (1999): a word of 64 bits has the differences down
    a column of the table.  Stretches lie side by side, shorter ones first, and leave as they end.
    """
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    n, one = len(begin), np.uint64(1)
    up = none << (64 - length).astype(np.uint64)
    down = np.zeros(n, np.uint64)
    score, best = length.copy(), length.copy()
    room = [np.empty(n, np.uint64) for _ in range(3)]
    signs, row, place = np.empty(n, np.int64), at * LETTERS, begin.copy()
    gone = np.searchsorted(size, np.arange(int(size[-1]) if n else 0), "right")  # stretches that have ended before a column
    for g in gone.tolist():
        vp, vn, s, t0, t1, t2, sg = up[g:], down[g:], score[g:], *(x[g:] for x in room), signs[g:]
        eq = bits.take(row[g:] + data.take(place[g:]))
        place += 1
        np.bitwise_and(eq, vp, out=t0)
        np.add(t0, vp, out=t0)
        np.bitwise_xor(t0, vp, out=t0)
        np.bitwise_or(t0, eq, out=t0)
        np.bitwise_or(t0, vn, out=t0)  # diagonal steps that cost nothing
        np.bitwise_or(t0, vp, out=t1)
        np.invert(t1, out=t1)
        np.bitwise_or(t1, vn, out=t1)  # steps to the right that cost one
        np.bitwise_and(t0, vp, out=t2)  # and that gain one
        np.right_shift(t1.view(np.int64), 63, out=sg)
        np.subtract(s, sg, out=s)
        np.right_shift(t2.view(np.int64), 63, out=sg)
        np.add(s, sg, out=s)
        np.left_shift(t1, one, out=t1)
        np.left_shift(t2, one, out=t2)
        np.bitwise_and(t1, t0, out=vn)
        np.bitwise_or(t0, t1, out=t0)
        np.invert(t0, out=t0)
        np.bitwise_or(t0, t2, out=vp)
        np.minimum(best[g:], s, out=best[g:])
    return best


def may_hold(data: np.ndarray, begin: np.ndarray, end: np.ndarray, pieces: Pieces, which: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Whether windows of ``data`` (letters' classes) can hold a match of a cost up to their bound; never false for one that does.

    A match aligns each piece of its pattern with a substring of the window, so the
    pieces' fewest edits add up to no more than its cost.  Long windows are looked
    through by stretches that overlap by more than a piece's best match is long.
    """
    left = np.arange(len(begin))
    total = np.zeros(len(begin), np.int64)
    for k in range(len(pieces.bits)):
        ask = left[pieces.count[which[left]] > k]
        cuts = np.maximum(1, -(-(end - begin)[ask] // STRETCH))
        of = np.repeat(np.arange(len(ask)), cuts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        a = begin[ask][of] + nth * STRETCH
        size = np.minimum(a + STRETCH + 128, end[ask][of]) - a
        found = np.full(len(ask), 64, np.int64)
        order = np.argsort(size, kind="stable")
        for x in range(0, len(order), LANES):
            o = order[x : x + LANES]
            i = which[ask[of[o]]]
            np.minimum.at(found, of[o], _least_edits(data, a[o], size[o], pieces.bits[k], i, pieces.length[k, i]))
        total[ask] += found
        left = left[total[left] <= bound[left]]
    out = np.zeros(len(begin), bool)
    out[left] = True
    return out


def within(windows: list[str], patterns: list[str], bounds: np.ndarray) -> list[tuple[int, int, int] | None]:
    """The best match of each pattern in its window, none where it costs more than the bound."""
    costs = least_costs(windows, patterns)
    return [best_match(x, p) if c <= n else None for x, p, c, n in zip(windows, patterns, costs, bounds)]


@dataclass
class Chunks:
    """Chunks that workers hold, with their seeds in order."""

    text: list[str]
    bound: np.ndarray

    def __post_init__(self):
        self.size = np.array([len(x) for x in self.text], np.int64)
        chunk, seed, place = word_seeds(self.text)
        by = np.argsort(seed, kind="stable")
        self.chunk, self.seed, self.place = chunk[by], seed[by], place[by]

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, chunk, start, end) around seeds that texts share with chunks, merged where they overlap."""
        row, seed, at = word_seeds(texts)
        low = np.searchsorted(self.seed, seed, "left")
        n = np.searchsorted(self.seed, seed, "right") - low
        row, at, low, n = (x[n > 0] for x in (row, at, low, n))
        ends, a, got = np.cumsum(n), 0, [(np.empty(0, np.int64),) * 3]
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + HITS, "right")))
            of = np.repeat(np.arange(a, b), n[a:b])
            j = np.arange(len(of)) - np.repeat(ends[a:b] - n[a:b] - (ends[a - 1] if a else 0), n[a:b]) + low[of]
            chunk = self.chunk[j]
            shift = at[of] - self.place[j]
            got.append(_merged(row[of] * len(self.text) + chunk, shift - self.bound[chunk], shift + self.size[chunk] + self.bound[chunk]))
            a = b
        key, start, end = _merged(*(np.concatenate(x) for x in zip(*got)))
        row = key // max(1, len(self.text))
        return row, key % max(1, len(self.text)), np.maximum(start, 0), np.minimum(end, np.array([len(x) for x in texts], np.int64)[row])


def _merged(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of at least one letter, merged within their key where they overlap."""
    by = np.lexsort((end, start, key))
    key, start, end = key[by], start[by], end[by]
    if not len(key):
        return key, start, end
    # the furthest end so far within the key: ends are raised by the key, so that none reaches into the next
    wide = int(end.max() - start.min()) + 2
    nth = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64)))) * wide
    reach = np.maximum.accumulate(end + nth) - nth
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (start[1:] >= reach[:-1])))
    first = np.flatnonzero(new)
    return key[first], start[first], reach[np.concatenate((first[1:] - 1, [len(key) - 1]))]


def _of_few(d: DataFrame, c: DataFrame, doc: str, item: str) -> DataFrame:
    """(doc, item, chunk, cost, start, end, bound, n) for chunks of HELD letters at most: one pass over plain texts, without a shuffle."""
    told = [item, "chunk", "bound", "n"]
    sent = d.sparkSession.sparkContext.broadcast(c.select(*told, "c").toArrow().combine_chunks())  # HELD letters at most

    def run(batches):
        own = sent.value
        known = Chunks(own.column("c").to_pylist(), own.column("bound").to_numpy().astype(np.int64))
        pieces = Pieces(known.text)
        for b in batches:
            ends = np.concatenate(([0], np.cumsum(pc.utf8_length(b.column(1)).to_numpy().astype(np.int64))))
            a = 0
            while a < b.num_rows:
                n = max(1, int(np.searchsorted(ends, ends[a] + AT_ONCE, "right")) - 1 - a)
                part, begin, a = b.slice(a, n), ends[a : a + n] - ends[a], a + n
                texts = part.column(1).to_pylist()
                row, chunk, start, end = known.windows(texts)
                ok = may_hold(letters("".join(texts)), begin[row] + start, begin[row] + end, pieces, chunk, known.bound[chunk])
                row, chunk, start, end = row[ok], chunk[ok], start[ok], end[ok]
                got = within([texts[r][x:y] for r, x, y in zip(row, start, end)], [known.text[i] for i in chunk], known.bound[chunk])
                hit = [(r, i, m[2], x + m[0], x + m[1]) for r, i, x, m in zip(row, chunk, start, got) if m]
                row, chunk, *places = zip(*hit) if hit else ((),) * 5
                of = own.select(told).take(pa.array(chunk, pa.int64())).combine_chunks()
                cols = [part.column(0).take(pa.array(row, pa.int64())), *(of.column(x).combine_chunks() for x in told), *(pa.array(x, pa.int32()) for x in places)]
                yield pa.RecordBatch.from_arrays(cols, names=[doc, *told, "cost", "start", "end"])

    kinds = T.StructType([d.schema[doc], *(T.StructField(x, c.schema[x].dataType) for x in told), *(T.StructField(x, T.IntegerType()) for x in ("cost", "start", "end"))])
    return d.select(doc, "d").mapInArrow(run, kinds)


def _of_many(d: DataFrame, c: DataFrame, doc: str, item: str) -> DataFrame:
    """The same for any number of chunks, which meet the texts in a join."""
    own = seeds(c, "chunk_id", "c")
    known = own.select("seed").distinct().limit(KNOWN + 1).toArrow().column(0).to_numpy()  # KNOWN numbers at most
    dk = seeds(d, doc, "d", np.sort(known) if len(known) <= KNOWN else None)
    hits = dk.withColumnRenamed("place", "at").join(own, "seed").select(doc, "chunk_id", (F.col("at") - F.col("place")).alias("shift")).distinct()
    hits = hits.join(c.select("chunk_id", "m", "bound"), "chunk_id")
    near = hits.select(doc, "chunk_id", (F.col("shift") - F.col("bound")).alias("start"), (F.col("shift") + F.col("m") + F.col("bound")).alias("end"))
    windows = intervals.merge_intervals(near, [doc, "chunk_id"], gap=0).select(
        doc, "chunk_id", F.greatest("start", F.lit(0)).alias("from"), F.col("end").alias("to")
    )
    # each text is looked up once, for all its windows
    asked = windows.groupBy(doc).agg(F.collect_list(F.struct("chunk_id", "from", "to")).alias("asked"))
    cut = d.join(asked, doc).select(doc, "d", F.explode("asked").alias("a")).select(
        doc, "a.chunk_id", "a.from", F.substr("d", F.col("a.from") + 1, F.col("a.to") - F.col("a.from")).alias("window")
    )

    # few bytes, much work: dealt out whatever their size
    cut = cut.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    @F.pandas_udf("struct<start:int,end:int,cost:int>")
    def align(ws: pd.Series, ps: pd.Series, bounds: pd.Series) -> pd.DataFrame:
        nth, patterns = pd.factorize(ps)
        ends = ws.str.len().cumsum().to_numpy(np.int64)
        begin = np.concatenate(([0], ends[:-1]))[: len(ws)]
        ok = may_hold(letters("".join(ws)), begin, ends, Pieces(list(patterns)), nth, bounds.to_numpy())
        got = np.full((len(ws), 3), None)
        for k, m in zip(np.flatnonzero(ok), within(ws[ok].tolist(), ps[ok].tolist(), bounds[ok].to_numpy())):
            got[k] = m or (None, None, None)
        return pd.DataFrame(got, columns=["start", "end", "cost"], dtype="Int32")

    got = cut.join(c.select("chunk_id", "c", "bound", "n"), "chunk_id").withColumn("m", align("window", "c", "bound")).where(F.col("m.cost") <= F.col("bound"))
    return got.select(doc, f"chunk_id.{item}", "chunk_id.chunk", "m.cost", (F.col("from") + F.col("m.start")).alias("start"), (F.col("from") + F.col("m.end")).alias("end"), "bound", "n")


def fuzzy(docs: DataFrame, passages: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", ratio: float = 0.2, most: int = 200) -> DataFrame:
    """(doc, item, start, end, cost, tier): each passage's best place in the texts that hold it.

    A passage of over CHUNK characters is searched in equal chunks, each of which must
    be found; their places, merged over gaps under CHUNK_GAP, must be one, and their
    costs add up (A20).  A chunk is found where its cost is at most ``ratio`` of its
    length, and ``most``; ``tier`` is the least of 100, 120, 150 and 200 percent of
    half the bound that suffices.  Positions are in the text with its white space made
    single.  Windows to align are those around two adjacent words that text and chunk
    share, wide enough for any match through them.  A match without two adjacent words
    unharmed isn't found; at an edit in every tenth letter that is one in thousands.
    """
    p = passages.where(F.col(text).isNotNull()).select(item, plain(t.drop_brackets(text)).alias("p")).where("p <> ''")
    n = F.ceil(F.length("p") / CHUNK).cast("int")
    size = F.ceil(F.length("p") / n).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("chunk"), F.substr("p", i * size + 1, size).alias("c")))
    c = p.select(item, n.alias("n"), F.explode(F.filter(parts, lambda x: F.length(x["c"]) > 0)).alias("x")).select(item, "n", "x.*")
    c = c.withColumn("n", F.count("*").over(Window.partitionBy(item)).cast("int")).withColumn("bound", F.least(F.lit(most), F.ceil(F.length("c") * ratio)).cast("int"))
    c = c.withColumn("chunk_id", F.struct(item, "chunk")).withColumn("m", F.length("c"))
    d = docs.where(F.col(text).isNotNull()).select(doc, plain(text).alias("d"))
    held = c.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()["m"]
    got = _of_few(d, c, doc, item) if held <= HELD else _of_many(d, c, doc, item)
    place = F.struct("cost", "start", "end", "bound", "n")
    best = got.groupBy(doc, item, "chunk").agg(F.min(place).alias("b")).select(doc, item, "chunk", "b.*")
    of = [doc, item]
    whole = best.groupBy(*of).agg(F.sum("cost").cast("int").alias("cost"), F.sum("bound").alias("bound"), F.count("*").alias("found"), F.max("n").alias("n")).where("found = n")
    runs = intervals.merge_intervals(best, of, gap=CHUNK_GAP).groupBy(*of).agg(F.count("*").alias("runs"), F.min("start").alias("start"), F.max("end").alias("end"))
    part = F.col("cost") / (F.col("bound") / 2)
    tier = F.when(part <= 1.0, 100).when(part <= 1.2, 120).when(part <= 1.5, 150).otherwise(200)
    return whole.join(runs.where("runs = 1"), of).select(doc, item, "start", "end", "cost", tier.alias("tier"))


def best_page(matches: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """The page of least cost, of equals the first."""
    return matches.groupBy(*keys).agg(F.min(F.struct("cost", page, "start", "end")).alias("b")).select(*keys, f"b.{page}", "b.start", "b.end", "b.cost")


def removals(x: str | Column, pattern: str = "<[^>]*>") -> Column:
    """The (start, len) of everything that a pattern removes, starts counted in the original."""
    found = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    rest = F.split(x, pattern)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,len:int>>").alias("out"))
    kept = F.transform(rest, F.length)
    cut = F.transform(found, F.length)
    pairs = F.arrays_zip(F.slice(kept, 1, F.size(cut)).alias("k"), cut.alias("c"))
    return F.aggregate(
        pairs, start,
        lambda a, z: F.struct((a["at"] + z["k"] + z["c"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + z["k"]).alias("start"), z["c"].alias("len")))).alias("out")),
        lambda a: a["out"],
    )


def restored(position: Column, removed: Column) -> Column:
    """A position in cleaned text as the position in the original (F16, F18): exact for any number of removals.

    Removals that start at or before the place reached so far push it on.
    """
    return F.aggregate(removed, position.cast("int"), lambda p, r: F.when(r["start"] <= p, p + r["len"]).otherwise(p))


def widened(text: Column, start: Column, end: Column) -> Column:
    """(start, end) pushed out to whole words."""
    left = F.length(F.regexp_extract(F.substring(text, F.lit(1), start), "(?U)\\w*$", 0))
    inside = F.regexp_extract(F.substr(text, start + 1, F.lit(1)), "(?U)^\\w", 0) != ""
    ends_in_word = F.regexp_extract(F.substr(text, end, F.lit(1)), "(?U)^\\w", 0) != ""
    right = F.length(F.regexp_extract(F.substr(text, end + 1), "(?U)^\\w*", 0))
    return F.struct((start - F.when(inside, left).otherwise(0)).alias("start"), (end + F.when(ends_in_word, right).otherwise(0)).alias("end"))


def highlighted(docs: DataFrame, spans: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, html): texts with their disjoint spans between highlight tags."""
    s = spans.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias("s"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    body = F.aggregate(
        F.coalesce("s", F.array().cast("array<struct<start:int,end:int>>")), start,
        lambda a, z: F.struct(z["end"].alias("at"), F.concat(
            a["out"], F.substr(F.col(text), a["at"] + 1, z["start"] - a["at"]), F.lit("<hl>"), F.substr(F.col(text), z["start"] + 1, z["end"] - z["start"]), F.lit("</hl>")
        ).alias("out")),
        lambda a: F.concat(a["out"], F.substr(F.col(text), a["at"] + 1)),
    )
    return docs.join(s, doc, "left").select(doc, t.outward_highlights(body).alias("html"))

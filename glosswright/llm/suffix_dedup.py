"""Exact repeats of ``window`` bytes by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first ``window`` bytes, digit after digit,
most significant first; a suffix alone in its group leaves the sort, and the
groups still equal after the last digit are exactly the repeated windows.  Digits
are ranked by fingerprints (which byte string comes first doesn't matter for
equality), so one pass handles many bytes.

A record for every suffix would be over sixteen times the text.  So the passes that
shuffle sort only the suffixes at content-defined anchors (``byte_windows``): every
window holds exactly one, equal windows at the same place.  A *run* is the windows
that share an anchor.

1. The first digit is the 28-byte gram with which the anchor's suffix begins.  Runs
   whose gram occurs nowhere else leave here.
2. The second digit is the whole run.  Runs that are equal are sorted through all
   their windows: all but the first are repeats.
3. The first runs of grams that have several kinds of runs give up their windows'
   suffixes, read from the text again; these are sorted by four digits of a quarter
   of the window, and after each digit those alone in their group leave.

A worker first settles what it can within an Arrow batch and passes on one record
of a kind, neighbouring repeats as one, so a group holds at most a few records of
every batch however often its bytes occur, and a text of one letter is one record.
Grams with very many kinds of runs (``CROWD``) are not gathered by gram in pass 3:
their windows are dealt out one by one, by all digits at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswright.llm._shared import cut, release, row_key, slices
from glosswright.llm.byte_windows import BASE_A, BASE_B, anchors, gram_hashes, mix

#: Width of the gram that makes the first digit.
GRAM = 28
#: Digits of the last pass.
DIGITS = 4
#: Kinds of runs of a gram in a batch from which its windows are dealt out singly; in all, eight times as many.
CROWD = 512
#: Bytes of texts that are hashed in one go; longer texts are taken in pieces that overlap.
JOINED, PIECE = 1 << 18, 1 << 20
#: Windows of crowded grams that a worker holds before it settles them among themselves.
HELD = 1 << 20
_U = np.uint64
_REPEAT, _RUN, _MANY, _SIGN = 0, 1, 2, 3
# a run's place in its document: form 2 bits, start 31 bits, number of windows less one 30 bits
_START, _FORM = 30, 61
_MOST, _BARE = (1 << _START) - 1, (1 << _FORM) - 1


def _hash_windows(data: np.ndarray, width: int) -> np.ndarray:
    """Two independent fingerprints of every window, mixed into one key and one check."""
    a, b = gram_hashes(data, width, BASE_A), gram_hashes(data, width, BASE_B)
    with np.errstate(over="ignore"):
        return np.stack([mix(a + _U(1)), mix(b ^ _U(0x5851F42D4C957F2D))], axis=1)


def _runs(data: np.ndarray, window: int, ends: np.ndarray):
    """(gram, kind, first start, windows less one) of the runs of texts laid end to end."""
    g, s, e = anchors(data, window, GRAM, ends)
    if not len(g):
        return g, g, s, s
    p = gram_hashes(data, window, BASE_B)
    with np.errstate(over="ignore"):
        kind = mix(p[s] + mix(p[e] + (e - s).astype(np.uint64) * BASE_A))
    return g, kind, s, e - s


def _joined_runs(texts: list[str], window: int):
    """(text, gram, kind, start, windows less one) of the runs of texts, some laid end to end at a time."""
    raw, of, at, size = [], [], [], 0

    def run():
        ends = np.cumsum([len(x) for x in raw])
        g, kind, s, more = _runs(np.frombuffer(b"".join(raw), np.uint8), window, ends)
        k = np.searchsorted(ends, s, side="right")
        return np.array(of)[k], g, kind, s - (ends - [len(x) for x in raw])[k] + np.array(at)[k], more

    for row, text in enumerate(texts):
        data = text.encode()
        for a in range(0, max(1, len(data) - window + 1), PIECE):
            raw.append(data[a : a + PIECE + window - 1])
            of.append(row)
            at.append(a)
            size += len(raw[-1])
            if size >= JOINED:
                yield run()
                raw, of, at, size = [], [], [], 0
    if raw:
        yield run()


def _rows_in_order(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """The place of each row by id and hash; equal rows have the same."""
    order = np.lexsort((tags, ids))
    a, b = ids[order], tags[order]
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))[: len(ids)]
    return rank


def _neighbours(owner: np.ndarray, start: np.ndarray, more: np.ndarray):
    """Runs of windows, sorted by owner and start, with those that follow each other as one: (which, more)."""
    if not len(owner):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + more[:-1] + 1)))
    first = np.flatnonzero(new)
    reach = np.maximum.reduceat(start + more, first)
    return first, reach - start[first]


def _scan(window: int):
    """Passes 1 and 2 within a batch: records (key to gather by, kind, id, tag, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rank = _rows_in_order(ids, tags)
            parts, base = [], 0
            for part in slices([batch], text=2):
                for row, g, kind, s, more in _joined_runs(part.column(2).to_pylist(), window):
                    parts.append((row + base, g, kind, s, more))
                base += part.num_rows
            if not parts:
                continue
            row, gram, kind, start, more = map(np.concatenate, zip(*parts))
            del parts
            if not len(row):
                continue
            spot = rank[row] << 31 | start
            order = np.lexsort((spot, kind, gram))
            row, gram, kind, start, more, spot = (x[order] for x in (row, gram, kind, start, more, spot))
            new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
            new_kind = new_gram | np.concatenate(([True], kind[1:] != kind[:-1]))
            kinds = np.bincount(np.cumsum(new_gram) - 1, weights=new_kind)
            crowded = (kinds >= CROWD)[np.cumsum(new_gram) - 1]
            # what equals an earlier run of the batch is a repeat, unless it is that very place again
            lead = np.maximum.accumulate(np.where(new_kind, np.arange(len(gram)), 0))
            again = np.flatnonzero(~new_kind & (spot != spot[lead]))
            again = again[np.argsort(spot[again], kind="stable")]
            first, many = _neighbours(rank[row[again]], start[again], more[again])
            again = again[first]
            ones = np.flatnonzero(new_kind)
            sign = np.flatnonzero(new_gram & crowded)  # one record of a crowded gram tells its group so
            of = np.concatenate([ones, sign, again])
            form = np.concatenate([np.where(crowded[ones], _MANY, _RUN), np.full(len(sign), _SIGN), np.full(len(again), _REPEAT)])
            place = form << _FORM | start[of] << _START | np.concatenate([more[ones], more[sign], many])
            # repeats are spread by document, crowded runs by kind; neither is gathered by gram
            key = np.where(form == _REPEAT, mix(tags[row[of]].view(np.uint64)), np.where(form == _MANY, mix(gram[of] ^ kind[of]), gram[of]))
            for a in range(0, len(of), 200_000):
                z = slice(a, a + 200_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[z]) for x in (key.view(np.int64), kind[of].view(np.int64), ids[row[of]], tags[row[of]], place)],
                    names=["gram", "kind", "id", "tag", "place"],
                )

    return run


def _merge(spans: np.ndarray) -> np.ndarray:
    """Sorted maximal [a, b) spans; overlapping and touching ones become one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    ends = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(spans) - 1]))
    return np.stack([spans[new, 0], reach[ends]], axis=1)


def _places(values) -> tuple[np.ndarray, np.ndarray]:
    """Starts and numbers of windows of packed places."""
    v = np.asarray(values, np.int64) & _BARE
    return v >> _START, (v & _MOST) + 1


def _batch(gram, check, raw, doc, tag, place) -> pa.RecordBatch:
    none = [None] * len(doc)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(none if gram is None else gram, pa.int64()), pa.array(none if check is None else check, pa.int64()),
            pa.array(none if raw is None else raw, pa.binary()), pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(place, pa.int64()),
        ],
        names=["gram", "check", "bytes", "id", "tag", "place"],
    )


def _windows(window: int):
    """Pass 3, the texts' side: runs with their bytes, and single windows of crowded grams.

    Of equal single windows only the first of those at hand is passed on; the others
    are repeats already (rows with neither bytes nor check).
    """

    def settled(singles):
        h, doc, tag, place = (np.concatenate(x) for x in zip(*singles))
        order = np.lexsort((place, tag, doc, h[:, 1], h[:, 0]))
        h, doc, tag, place = h[order].view(np.int64), doc[order], tag[order], place[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]).any(axis=1)))
        lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        again = (doc != doc[lead]) | (tag != tag[lead]) | (place != place[lead])
        for a in range(0, len(new), 200_000):
            z = slice(a, a + 200_000)
            n, r = new[z], again[z]
            yield _batch(h[z, 0][n], h[z, 1][n], None, doc[z][n], tag[z][n], place[z][n])
            if r.any():
                yield _batch(None, None, None, doc[z][r], tag[z][r], place[z][r])

    def run(batches):
        for b in batches:
            singles, waiting, out, held = [], 0, [], 0
            for row in range(b.num_rows):
                doc, tag, text, asked = (b.column(k)[row].as_py() for k in range(4))
                data = text.encode()
                places = [x["place"] for x in asked]
                start, count = _places(places)
                for x, p, s, n in zip(asked, places, start.tolist(), count.tolist()):
                    raw = data[s : s + n + window - 1]
                    if p >> _FORM == _RUN:
                        out.append((x["gram"], raw, doc, tag, p & _BARE))
                        held += len(raw)
                    else:
                        h = _hash_windows(np.frombuffer(raw, np.uint8), window)
                        singles.append((h, np.full(n, doc), np.full(n, tag), np.arange(s, s + n) << _START))
                        waiting += n
                    if waiting >= HELD:
                        yield from settled(singles)
                        singles, waiting = [], 0
                    if held >= 4 << 20:
                        g, raw, d, t, p = zip(*out)
                        yield _batch(g, None, raw, d, t, p)
                        out, held = [], 0
            if singles:
                yield from settled(singles)
            if out:
                g, raw, d, t, p = zip(*out)
                yield _batch(g, None, raw, d, t, p)

    return run


def _equal_windows(data: np.ndarray, at: np.ndarray, group: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows, by index into ``at``, that have an equal one in their group, and their groups of equals.

    Radix sort, most significant digit first: each pass orders what is left by the
    next quarter of the window, and those that are then alone leave.
    """
    width = -(-window // DIGITS)
    digit = gram_hashes(data, width, BASE_B)
    left = np.arange(len(at))
    for k in range(DIGITS):
        d = digit[at[left] + min(k * width, window - width)]
        order = np.lexsort((d, group))
        left, group, d = left[order], group[order], d[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (d[1:] != d[:-1])))[: len(left)]
        group = np.cumsum(new) - 1
        more = np.bincount(group)[group] > 1
        left, group = left[more], group[more]
    return left, group


def _settle(window: int):
    """Pass 3, the groups' side: rows come sorted by gram; equal windows after the first are repeats."""

    def later(doc, tag, spot, group):
        """Which of the windows, in groups of equals, are not the first of their group."""
        order = np.lexsort((spot, tag, doc, group))
        doc, tag, spot, group = doc[order], tag[order], spot[order], group[order]
        lead = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1]))[: len(group)], np.arange(len(group)), 0))
        return order[(doc != doc[lead]) | (tag != tag[lead]) | (spot != spot[lead])]

    def settle(t: pa.Table):
        """Rows with bytes are runs, with a check single windows, with neither settled before."""
        raw, doc, tag, place = t.column(2).to_pylist(), *(t.column(k).to_numpy() for k in (3, 4, 5))
        check = t.column(1)
        lone = np.flatnonzero(check.is_valid().to_numpy(zero_copy_only=False))
        runs = np.flatnonzero([x is not None for x in raw])
        done = np.setdiff1d(np.arange(len(raw)), np.concatenate([lone, runs]))
        gram = t.column(0).fill_null(0).to_numpy()
        out = [(doc[done], tag[done], place[done])]
        if len(lone):
            c = check.take(pa.array(lone)).to_numpy().astype(np.int64)
            order = np.lexsort((c, gram[lone]))
            g, c, lone = gram[lone][order], c[order], lone[order]
            group = np.cumsum(np.concatenate(([0], (g[1:] != g[:-1]) | (c[1:] != c[:-1]))))
            k = lone[later(doc[lone], tag[lone], place[lone], group)]
            out.append((doc[k], tag[k], place[k]))
        if len(runs):
            raw = [raw[k] for k in runs.tolist()]
            count = np.array([len(x) - window + 1 for x in raw], np.int64)
            base = np.cumsum([0, *map(len, raw)])[:-1]
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            owner = np.repeat(runs, count)
            kept, group = _equal_windows(np.frombuffer(b"".join(raw), np.uint8), np.repeat(base, count) + step, np.unique(gram[owner], return_inverse=True)[1], window)
            owner, step = owner[kept], step[kept]
            start = (place[owner] >> _START) + step
            k = later(doc[owner], tag[owner], start, group)
            owner, start = owner[k], start[k]
            order = np.lexsort((start, owner))
            first, more = _neighbours(owner[order], start[order], np.zeros(len(order), np.int64))
            owner, start = owner[order][first], start[order][first]
            out.append((doc[owner], tag[owner], start << _START | more))
        return map(np.concatenate, zip(*out))

    def flush(t: pa.Table):
        if t.num_rows:
            cols = [*settle(t)]
            for a in range(0, len(cols[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 200_000]) for c in cols], names=["id", "tag", "place"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 8_000:  # a group has at most 8 CROWD kinds
                t = pa.Table.from_batches(held).combine_chunks()
                g = t.column(0).fill_null(0).to_numpy()
                change = np.flatnonzero(g[1:] != g[:-1])
                if len(change):
                    k = int(change[-1]) + 1
                    yield from flush(t.slice(0, k))
                    rest = t.slice(k)
                    held, size = rest.to_batches(), rest.num_rows
        if held:
            yield from flush(pa.Table.from_batches(held).combine_chunks())

    return run


def _without(data: bytes, places, window: int) -> tuple[list[list[int]], bytes]:
    """The maximal repeated spans of a text and what is left of it."""
    s, n = _places(places or [])
    spans = _merge(np.stack([s, s + n + window - 1], axis=1)).tolist()
    keep, at = [], 0
    for x, y in spans:
        keep.append(data[at:x])
        at = y
    return spans, b"".join([*keep, data[at:]])


def repeats(
    docs: DataFrame, window: int = 100, doc: str = "doc_id", text: str = "text", more: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """(rows, found): the rows with their keys, and for each key the places of repeated windows.

    ``found`` holds (_id, _tag, _places): packed first starts and numbers of windows.
    """
    if not GRAM < window <= GRAM + 255:
        raise ValueError(f"windows of {GRAM + 1} to {GRAM + 255} bytes")
    rows = docs.select(F.col(doc).cast("long").alias("_doc"), F.col(text).cast("string").alias("_text"), *(F.col(c).alias(f"_more{k}") for k, c in enumerate(more)))
    rows = rows.select("*", *row_key("_doc", "_text"))
    long_ = rows.where(F.octet_length("_text") >= window).select("_id", "_tag", "_text")

    scan = long_.mapInArrow(_scan(window), "gram long, kind long, id long, tag long, place long")
    form = F.shiftright("place", _FORM)
    by_gram = Window.partitionBy("gram")
    by_kind = Window.partitionBy("gram", "kind")
    first = F.min(F.when(form == _RUN, F.struct("id", "tag", "place"))).over(by_kind)
    kind = F.when(form.isin(_RUN, _SIGN), F.col("kind"))
    graded = (
        scan.repartition("gram")  # serves the windows over (gram, kind) as well
        .withColumn("first", first)
        .withColumn("many", F.max(F.when(form == _SIGN, 1).otherwise(0)).over(by_gram))
        .withColumn("low", F.min(kind).over(by_gram))
        .withColumn("high", F.max(kind).over(by_gram))
        .withColumn("n", F.sum(F.when(form == _RUN, 1).otherwise(0)).over(by_gram))
    )
    again = (F.col("first.id") != F.col("id")) | (F.col("first.tag") != F.col("tag")) | (F.col("first.place") != F.col("place"))
    fate = (
        F.when(form == _REPEAT, _REPEAT)
        .when(form == _MANY, _MANY)
        .when(form == _SIGN, None)
        .when(again, _REPEAT)
        .when((F.col("many") == 1) | (F.col("n") > 8 * CROWD), _MANY)
        .when(F.col("low") != F.col("high"), _RUN)
    )
    place = F.col("place").bitwiseAND(F.lit(_BARE)).bitwiseOR(F.shiftleft(F.col("fate").cast("long"), _FORM))
    fated = graded.withColumn("fate", fate).where("fate is not null").select("id", "tag", "fate", "gram", place.alias("place"))
    # one row a document: places that are settled, and runs to be looked at closely
    state = cut(
        fated.groupBy("id", "tag").agg(
            F.collect_list(F.when(F.col("fate") == _REPEAT, F.col("place"))).alias("done"),
            F.collect_list(F.when(F.col("fate") != _REPEAT, F.struct("gram", "place"))).alias("open"),
        ),
        slim=True,
    )
    asked = state.where(F.size("open") > 0).select(F.col("id").alias("_id"), F.col("tag").alias("_tag"), "open")
    close = (
        long_.join(asked, ["_id", "_tag"]).select("_id", "_tag", "_text", "open")
        .mapInArrow(_windows(window), "gram long, check long, bytes binary, id long, tag long, place long")
    )
    settled = (
        close.repartition(F.coalesce("gram", F.xxhash64("tag"))).sortWithinPartitions("gram")
        .mapInArrow(_settle(window), "id long, tag long, place long")
    )
    late = settled.groupBy("id", "tag").agg(F.collect_list("place").alias("late"))
    none = F.array().cast("array<long>")
    found = cut(
        state.select("id", "tag", "done").where(F.size("done") > 0)
        .join(late, ["id", "tag"], "full")
        .select(F.col("id").alias("_id"), F.col("tag").alias("_tag"), F.concat(F.coalesce("done", none), F.coalesce("late", none)).alias("_places")),
        slim=True,
    )
    return rows, found


def dedup(docs: DataFrame, window: int = 100, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, spans, kept): each text without its repeated bytes.

    A byte goes if a ``window``-byte string over it also starts earlier: in a row
    with a smaller id, or earlier in the same row.  ``spans`` are the maximal runs
    that went, as [start, end); ``kept`` is the rest, as bytes.  Null and empty
    texts, and texts under ``window`` bytes, stay as they are (null: no bytes).  A
    null id counts as the largest.  Rows equal in id and text are one document (each
    stays, alike); rows with one id, or none, and other texts come in the order of
    their texts' 64-bit hashes.  An empty table gives an empty table.
    """
    rows, found = repeats(docs, window, doc, text)
    release(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            out = []
            for row in range(b.num_rows):
                name, text_, places = (b.column(k)[row].as_py() for k in range(3))
                data = (text_ or "").encode()
                spans, kept = _without(data, places, window)
                out.append((name, len(data), sum(y - x for x, y in spans), len(spans), spans, kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[doc, "n_bytes", "n_removed", "n_spans", "spans", "kept"]
            )

    return (
        rows.join(found, ["_id", "_tag"], "left").select("_doc", "_text", "_places")
        .mapInArrow(run, f"`{doc}` long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary")
    )


def cut_repeats(docs: DataFrame, window: int = 100, doc: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with their texts less the repeated bytes, by the rules of ``dedup``.

    Where a cut splits a character, what is left of it goes too.  ``chars``, if
    there is such a column, gets the new length of texts that lost something.
    """
    rest = tuple(c for c in docs.columns if c not in (doc, text))
    rows, found = repeats(docs, window, doc, text, rest)
    release(docs.sparkSession)

    def run(batches):
        for b in slices(batches, 0):
            texts, places = b.column(0).to_pylist(), b.column(1).to_pylist()
            left = [t if not p else _without(t.encode(), p, window)[1].decode("utf-8", "ignore") for t, p in zip(texts, places)]
            size = [len(t) if p else None for t, p in zip(left, places)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.string()), pa.array(size, pa.int64()), *b.columns[2:]], names=["_left", "_size", *b.schema.names[2:]]
            )

    joined = rows.join(found, ["_id", "_tag"], "left").select("_text", "_places", "_doc", *(f"_more{k}" for k in range(len(rest))))
    fields = [T.StructField("_left", T.StringType()), T.StructField("_size", T.LongType()), *joined.schema.fields[2:]]
    out = joined.mapInArrow(run, T.StructType(fields))
    of = {c: F.col(f"_more{k}") for k, c in enumerate(rest)} | {doc: F.col("_doc"), text: F.col("_left")}
    if chars in rest:
        of[chars] = F.coalesce("_size", of[chars]).cast(docs.schema[chars].dataType)
    return out.select(*(of[c].alias(c) for c in docs.columns))

"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array.  A round finds, for every word,
its adjacent pair of lowest rank by binary search over the sorted pair keys, and
merges it everywhere at once; words without a mergeable pair leave the array.

Text is normalized and split into words as the vocabulary file says; no merge
crosses a word.  A bounded memo keeps the ids of words already seen by the worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswright.llm._shared import slices

#: Entries that a worker's memo of words may reach before it is emptied, and letters of the longest word it keeps.
MEMO, KEPT = 200_000, 48
_NONE = np.int32(2**31 - 1)
_SPACE = r"\t-\r \x85\xa0  -     　"


def byte_letters() -> dict[int, str]:
    """The printable stand-in that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(odd)}


class Vocabulary:
    """Ids, ranks and splitter of a tokenizer file with end-of-word symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.end = spec["model"]["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[letters[b] + self.end] for b in range(256)], np.int32)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        key = left << 20 | right
        # of a pair listed twice the earlier rank counts
        self.keys, self.ranks = np.unique(key, return_index=True)
        self.ranks = self.ranks.astype(np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.strings = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self.decimals = [str(i) for i in range(len(self.strings))]
        self.words = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"
        )
        # the same for texts of ASCII and accented Latin letters only, in the faster library
        self.latin = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")
        self.only_latin = re.compile("[\x00-\x7fß-öø-ÿ]*")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.memo: dict[str, bytes] = {"\0" + t: i.to_bytes(4, "little") for t, i in self.special.items()}
        self.long: list[str] = []

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of non-empty words and the number of ids of each."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        last = np.zeros(len(data), bool)
        last[np.cumsum(n) - 1] = True
        sym = np.where(last, self.final[data], self.inner[data])
        word = np.repeat(np.arange(len(words), dtype=np.int32), n)
        rank = np.full(len(sym), _NONE, np.int32)
        pair = np.flatnonzero(~last)
        rank[pair] = self.rank(sym[pair], sym[pair + 1])
        done_word, done_sym = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], last[:-1])))
            lens = np.diff(np.append(starts, len(sym)))
            low = np.minimum.reduceat(rank, starts)
            lows = np.repeat(low, lens)
            over = lows == _NONE
            if over.any():
                done_word.append(word[over])
                done_sym.append(sym[over])
                go = ~over
                sym, word, rank, last, lows = sym[go], word[go], rank[go], last[go], lows[go]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == lows)
            near = np.diff(hit) == 1
            if near.any():  # a run of one symbol: pairs overlap, the left ones win
                first = np.maximum.accumulate(np.where(np.concatenate(([True], ~near)), np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            last[hit] = last[hit + 1]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1
            sym, word, rank, last = sym[keep], word[keep], rank[keep], last[keep]
            rank[at] = _NONE
            right = at[~last[at]]
            rank[right] = self.rank(sym[right], sym[right + 1])
            left = at[at > 0] - 1
            left = left[~last[left]]
            rank[left] = self.rank(sym[left], sym[left + 1])
        if not done_word:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def _split(self, text: str) -> list[str]:
        """The words of one text; a special token is marked by a leading NUL."""
        if self.marks is not None and "<|" in text:
            parts = self.marks.split(text)
            if len(parts) > 1:
                return [w for p in parts for w in (["\0" + p] if p in self.special else self._split(p))]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "\u03a3" in text:  # the library lowers letter by letter, without a final sigma
                return self.words.findall("".join([c.lower() for c in text]))
        text = text.lower()
        return (self.latin if self.only_latin.fullmatch(text) else self.words).findall(text)

    def learn(self, words: set[str]) -> None:
        """Puts words into the memo."""
        new = list(words.difference(self.memo))
        if not new:
            return
        if len(self.memo) + len(new) > MEMO:
            self.memo = {c: self.memo[c] for c in words.intersection(self.memo)}
            self.memo |= {"\0" + t: i.to_bytes(4, "little") for t, i in self.special.items()}
        ids, count = self.encode_words([w.encode() for w in new])
        raw, ends = ids.astype("<u4").tobytes(), (np.cumsum(count) * 4).tolist()
        self.memo.update(zip(new, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]))
        self.long = [w for w in new if len(w) > KEPT]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of whole texts, as uint32 arrays; null is empty."""
        out: list[np.ndarray] = []
        for a in range(0, len(texts), 256):
            split = [self._split(t or "") for t in texts[a : a + 256]]
            self.learn(set().union(*split))
            memo = self.memo
            out += [np.frombuffer(b"".join([memo[c] for c in s]), "<u4") for s in split]
            for w in self.long:  # so that the memo is bounded in bytes too
                del memo[w]
            self.long = []
        return out

    def decode(self, ids) -> str:
        """The library's text of ids: this vocabulary has no decoder, so its tokens, one space between."""
        s = self.strings
        return " ".join([s[i] for i in (ids.tolist() if hasattr(ids, "tolist") else ids)])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_tokens, ids): the ids of every whole text.

    Null and empty texts have no ids.  Nothing is cut, padded or added.  Repeated
    rows and null ids stay rows of their own; other columns are left behind; an
    empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in slices(batches):
            ids = v.encode_batch(b.column(1).to_pylist())
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=[doc, "n_tokens", "ids"],
            )

    return docs.select(F.col(doc).cast("long").alias(doc), F.col(text).cast("string").alias(text)).mapInArrow(
        run, f"`{doc}` long, n_tokens long, ids array<int>"
    )


def decode(encoded: DataFrame, path: str, doc: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc, decoded): the text that the library makes of each row's ids; null ids give ''."""

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                s = b.slice(a, 256)
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array([v.decode(x or []) for x in s.column(1).to_pylist()], pa.string())],
                    names=[doc, "decoded"],
                )

    return encoded.select(F.col(doc), F.col(ids)).mapInArrow(run, f"`{doc}` long, decoded string")


def digests(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_tokens, ids_sha256, decoded_sha256): encode, then decode, each row in one pass.

    The same as ``encode`` and ``decode`` above, without moving ids and decoded
    texts (three times the input) between the JVM and Python.
    """

    def run(batches):
        v = vocabulary(path)
        for b in slices(batches):
            ids = v.encode_batch(b.column(1).to_pylist())
            dec = v.decimals
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(" ".join([dec[i] for i in x.tolist()]).encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(v.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                names=[doc, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(doc).cast("long").alias(doc), F.col(text).cast("string").alias(text)).mapInArrow(
        run, f"`{doc}` long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())

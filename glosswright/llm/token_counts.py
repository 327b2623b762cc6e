"""Token counts: batch encoding in an Arrow function that returns lengths only.

Arrow batches are cut into slices of like numbers of bytes (``_shared.slices``).
Byte-level vocabularies split a text at every space between other characters than
white space, so long texts are cut there; the pieces of a slice that the worker
hasn't counted yet go to the vocabulary's own library, many in one batch of a
bounded number of bytes.  Counts of short pieces are kept in a bounded memo.
Texts for other vocabularies are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswright.llm._shared import slices

#: Entries that a worker's memo of pieces may reach before it is emptied, and letters of the longest piece it keeps.
MEMO, KEPT = 300_000, 48
#: Letters and pieces that go to the library at once.
BATCH, PIECES = 1 << 20, 20_000
#: A space between characters that aren't white space, by Unicode.
_LONE = re.compile(r"(?<=\S) (?=\S)")


def _balanced(pieces: list[str]) -> Iterator[list[str]]:
    """Batches of about BATCH letters, PIECES pieces at most."""
    batch, size = [], 0
    for p in pieces:
        batch.append(p)
        size += len(p)
        if size >= BATCH or len(batch) >= PIECES:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


class _Counter:
    def __init__(self, path: str):
        self.memo: dict[str, int] = {}
        self.split: Callable[[str], list[str]] = lambda text: [text]
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.batch = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self.batch = lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
            if _byte_level(json.loads(tok.to_str())):
                self.split = _chunks

    def __call__(self, texts: list[str | None]) -> list[int]:
        parts = [self.split(t) if t else [] for t in texts]
        want = set().union(*parts)
        new = list(want.difference(self.memo))
        if len(self.memo) + len(new) > MEMO:
            self.memo = {c: self.memo[c] for c in want.intersection(self.memo)}
        memo = self.memo
        for some in _balanced(new):
            memo.update(zip(some, self.batch(some)))
        out = [sum([memo[c] for c in p]) for p in parts]
        for c in new:
            if len(c) > KEPT:
                del memo[c]
        return out


def _byte_level(spec: dict) -> bool:
    """Whether text may be cut before a lone space: only byte-level splitting without a normalizer."""
    pre = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")


def _chunks(text: str) -> list[str]:
    """Pieces that the splitter never joins; a run of any white space stays whole with its sides."""
    first, *rest = _LONE.split(text)
    return [first, *[" " + x for x in rest]]


@lru_cache(maxsize=4)
def counter(path: str) -> _Counter:
    return _Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_bytes, n_tokens, over_limit) of every whole text.

    Counts are those of the vocabulary file's own library without added special
    tokens.  Null and empty texts have 0 bytes and 0 tokens.  Repeated rows and
    null ids stay rows of their own; an empty table gives an empty table.
    """

    def run(batches):
        count = counter(path)
        for b in slices(batches):
            n = pa.array(count(b.column(1).to_pylist()), pa.int64())
            size = pc.binary_length(b.column(1)).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), size, n, pc.greater(n, limit)], names=[doc, "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select(F.col(doc).cast("long").alias(doc), F.col(text).cast("string").alias(text)).mapInArrow(
        run, f"`{doc}` long, n_bytes long, n_tokens long, over_limit boolean"
    )

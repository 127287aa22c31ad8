"""Token counts of whole texts by byte-pair merging over a heap and a linked list; no ids are made."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import blocks, text_buffer

_SPACE = "▁"
_CACHE_WORDS = 700_000
_CACHE_CHARS = 40
_COUNTERS: dict[str, MergeCounter] = {}


class MergeCounter:
    """Counts of a sentencepiece BPE model with byte fallback and an identity normaliser.

    A text is a row of symbols, one for each code point of the vocabulary and one for each byte of the others. The
    pair of neighbours that makes the piece of the lowest rank is merged, again and again; tokens are the initial
    symbols minus the merges. No piece has a space after another symbol, so texts part there into segments, whose
    counts are kept in a bounded cache.
    """

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in usable}
        self.chars = {p for p in self.rank if len(p) == 1}
        probe = "a  ﬁ Ｆéé \n"
        if sp.normalize(probe) != _SPACE + probe.replace(" ", _SPACE):
            raise ValueError("the model's normaliser changes texts")
        if any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in self.rank) or not set("".join(self.rank)) <= self.chars:
            raise ValueError("the model's pieces cross segments")
        if sum(sp.is_byte(i) for i in range(n)) != 256:
            raise ValueError("the model has no byte fallback")
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    @classmethod
    def shared(cls, model: bytes) -> MergeCounter:
        key = hashlib.sha256(model).hexdigest()
        if key not in _COUNTERS:
            _COUNTERS[key] = cls(model)
        return _COUNTERS[key]

    def segment(self, s: str) -> int:
        """Initial symbols minus merges of one segment."""
        rank = self.rank
        n = len(s)
        symbols = n if self.chars.issuperset(s) else sum(1 if c in self.chars else len(c.encode("utf-8", "surrogatepass")) for c in s)
        heap = [(r, i, p) for i in range(n - 1) if (r := rank.get(p := s[i : i + 2])) is not None]
        if not heap:
            return symbols
        heapify(heap)
        text: list[str | None] = list(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            _, i, p = heappop(heap)
            left, j = text[i], after[i]
            if left is None or j == n or len(left) + len(text[j]) != len(p):
                continue  # one of the two has been merged since
            text[i], text[j] = p, None
            merges += 1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                q = p + text[j]
                if (r := rank.get(q)) is not None:
                    heappush(heap, (r, i, q))
            if (h := before[i]) >= 0:
                q = text[h] + p
                if (r := rank.get(q)) is not None:
                    heappush(heap, (r, h, q))
        return symbols - merges

    def _word(self, w: str) -> int:
        """w stands after a space, or begins with the line break that it stands after."""
        return 1 + self.segment(w[1:]) if w[0] == "\n" else self.segment(_SPACE + w)

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace("\n", " \n").split(" ")
        if "" in words or _SPACE in text:
            total, memo = 0, {}
            for s in re.findall(f"{_SPACE}*[^{_SPACE}\n]+|{_SPACE}+|\n", _SPACE + text.replace(" ", _SPACE)):
                if s not in memo:
                    memo[s] = 1 if s == "\n" else self.segment(s)
                total += memo[s]
            return total
        young, old = self.young, self.old
        try:
            return sum(map(young.__getitem__, words))
        except KeyError:
            total = 0
            for w in words:
                n = young.get(w)
                if n is None:
                    n = old.get(w)
                    if n is None:
                        n = self._word(w)
                    if len(w) <= _CACHE_CHARS:
                        young[w] = n
                total += n
            if len(young) > _CACHE_WORDS:
                self.old, self.young = young, {}
            return total


def _counts(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = MergeCounter.shared(model.value)
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            raw = memoryview(np.ascontiguousarray(buf))
            n = []
            for lo, hi in blocks(offsets):
                n += [counter.count(str(raw[offsets[i] : offsets[i + 1]], "utf-8", "replace")) for i in range(lo, hi)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n, pa.int64())], names=["doc", "n_bytes", "n_tokens"])

    return rows


def count_tokens(df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, without begin, end or added special tokens.

    The model file (its size is that of the vocabulary) goes to the executors with the job. Null and empty texts
    have 0 bytes and 0 tokens; strings of special tokens inside a text are ordinary text. One pass, no exchange:
    repeated rows give repeated rows, null ids stay null, an empty table gives no rows, other columns are ignored.
    """
    model = Path(model_path).read_bytes()
    MergeCounter(model)  # fails here rather than in a task
    shape = "doc long, n_bytes long, n_tokens long"
    out = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(_counts(df.sparkSession.sparkContext.broadcast(model)), shape)
    return out.withColumnRenamed("doc", id_col)

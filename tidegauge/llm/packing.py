"""Global best-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import hashlib
import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bytetext import blocks, text_buffer
from .runtime import cut, tidy

_CACHE_WORDS = 100_000
_CACHE_BYTES = 48
#: Bytes as the letters that byte-level vocabularies write them with: printable ones as they are, the others from 256 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_ENCODERS: dict[str, WordEncoder] = {}


class _Words(dict):
    """Words to ids; a word that is missing is encoded, and kept unless it is long."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, w: bytes) -> bytes:
        ids = self.old.get(w)
        if ids is None:
            # a full stop or comma after an ASCII letter is a run of its own: the word before it is looked up alone
            core = w.rstrip(b".,")
            ids = self[core] + self[w[len(core) :]] if len(core) < len(w) and core[-1:].isalpha() else self.encode(w)
        if len(w) <= _CACHE_BYTES:
            self[w] = ids
        return ids


class WordEncoder:
    """Ids of whole texts from ids of their space-separated words, kept in two generations of a bounded cache.

    Exact for a tokenizer that never joins text across ASCII white space; ``check`` holds it to the library.
    """

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        shape = json.loads(definition)
        steps = json.dumps([shape.get("normalizer"), shape.get("pre_tokenizer")])
        self.lowers = "Lowercase" in steps and all("<" in t["content"] for t in shape["added_tokens"])
        # a word of letters is one run for this kind of tokenizer, and its merges need no other step; check() holds it to that
        self.letters = shape["model"]["type"] == "BPE" and "ByteLevel" in steps and self.lowers
        self.merge = self.tokenizer.model.tokenize
        self.words = _Words(self._word)

    @classmethod
    def shared(cls, definition: str) -> WordEncoder:
        key = hashlib.sha256(definition.encode()).hexdigest()
        if key not in _ENCODERS:
            _ENCODERS[key] = cls(definition)
        return _ENCODERS[key]

    def check(self, sample: str = "It's  a\tTEST:\n 12 cafés cafés, x., y .. <|endoftext|>z.  don't!! 　end, İx ß Σας naïve") -> None:
        whole = self.tokenizer.encode(sample, add_special_tokens=False).ids
        if np.frombuffer(self.encode([sample.encode()])[0], np.uint32).tolist() != whole:
            raise ValueError("this tokenizer joins text across white space")

    def _word(self, w: bytes) -> bytes:
        """Words of lower-case letters go to the merge model itself; all others through the whole tokenizer."""
        if self.letters and w.isalpha() and w.islower():  # ASCII
            return array("I", [t.id for t in self.merge(w.decode())]).tobytes()
        text = w.decode("utf-8", "replace")
        if self.letters and text.isalpha() and text == text.lower() and is_normalized("NFC", text):
            return array("I", [t.id for t in self.merge(w.decode("latin-1").translate(_BYTE_LEVEL))]).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        words = self.words
        if len(words) > _CACHE_WORDS:
            self.words = _Words(self._word)
            words.old, self.words.old = {}, words
            words = self.words
        # lower case is the tokenizer's own; a special token's string must not come about by it
        return [b"".join(map(words.__getitem__, (t if not self.lowers or b"<" in t else t.lower()).split())) for t in texts]


def _piece_rows(definition, capacity: int, end_id: int, with_ids: bool):
    names = ["doc", "piece", "start", "length", "ids_crc32", "ids"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.shared(definition.value)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            raw = memoryview(np.ascontiguousarray(buf))
            for lo, hi in blocks(offsets):
                at, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, tokens in enumerate(encoder.encode([bytes(raw[offsets[i] : offsets[i + 1]]) for i in range(lo, hi)]), lo):
                    tokens += end
                    for k, a in enumerate(range(0, len(tokens), step)):
                        part = tokens[a : a + step]
                        at.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                columns = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                columns += [pa.array(ids, pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    return tidy(rows)


def plan_sequences(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, offset, copies) for all pieces, and the number of sequences.

    The pieces of one length with ranks from ``first rank`` on go ``copies`` at a time into the sequences from
    ``first sequence`` on. Pieces above a third of the capacity come first: each, from the longest, is paired with
    the longest that fits beside it, two to a sequence at most. The smaller ones follow from the longest, each into
    the sequence whose gap it fits best, or a new one. Equal lengths and equal sequences are handled together, so
    the work and the rows depend on the capacity and not on the number of pieces.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("piece lengths must be from 1 to the capacity")
    done: list[tuple[tuple, int]] = []
    open_by_gap: dict[int, list] = defaultdict(list)
    gaps: list[int] = []

    def shelve(pattern: tuple, count: int) -> None:
        gap = capacity - sum(n * m for n, m in pattern)
        if not gap:
            done.append((pattern, count))
            return
        if not open_by_gap[gap]:
            insort(gaps, gap)
        open_by_gap[gap].append((pattern, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect_left(large, capacity - n + 1) - 1
        if at >= 0 and large[at] == n and left[n] == 1:
            at -= 1
        if at < 0:
            shelve(((n, 1),), left.pop(n))
            large.pop()
            continue
        m = large[at]
        k = left[n] // 2 if m == n else min(left[n], left[m])
        shelve(((n, 2),) if m == n else ((n, 1), (m, 1)), k)
        for x in (n, m):
            left[x] -= k
            if not left[x]:
                del left[x]
                large.remove(x)

    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                most = capacity // n
                if count >= most:
                    shelve(((n, most),), count // most)
                if count % most:
                    shelve(((n, count % most),), 1)
                break
            gap = gaps[at]
            pattern, bins = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                gaps.pop(at)
            most = gap // n
            full = min(bins, count // most)
            if full:
                shelve((*pattern, (n, most)), full)
                count -= full * most
            else:
                full = 1
                shelve((*pattern, (n, count)), 1)
                count = 0
            if bins > full:
                shelve(pattern, bins - full)

    rows, sequence, rank = [], 0, defaultdict(int)
    for pattern, count in [*done, *(x for g in gaps for x in open_by_gap[g])]:
        offset = 0
        for n, m in pattern:
            rows.append((n, rank[n], sequence, offset, m))
            rank[n] += m * count
            offset += n * m
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return table, sequence


def _place(plan, capacity: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        # lengths are below 2**20 for any capacity in use; ranks follow them in one sorted key
        keys = table[:, 0].astype(object) * (1 << 63) + table[:, 1] if len(table) and int(table[:, 1].max()) >> 42 else (table[:, 0] << 42) + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            own = length.astype(object) * (1 << 63) + rank if keys.dtype == object else (length << 42) + rank
            r = table[np.searchsorted(keys, own, "right") - 1]
            d = rank - r[:, 1]
            out = batch.drop_columns(["rank"])
            yield out.append_column("sequence_id", pa.array(r[:, 2] + d // r[:, 4])).append_column("offset", pa.array(r[:, 3] + d % r[:, 4] * length))

    return tidy(rows)


def pack(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids`` as bytes on request).

    A text's ids are followed by ``end_id``; only a text of more than ``capacity`` ids is cut, into pieces of
    ``capacity`` with a shorter last one. All pieces of the table are packed together: their histogram (at most
    ``capacity`` rows) goes to the driver, :func:`plan_sequences` packs it, and each piece finds its place by its
    length and its rank among the pieces of that length. Ranks come from counts per partition and length, so a
    length that most pieces share is no single task's load.

    Null and empty texts are one piece with ``end_id`` alone. Repeated rows and null ids are packed like others; ties
    are settled by the rows' order in the input. An empty table gives no rows. Other columns are ignored.
    """
    if capacity < 1 or capacity >= 1 << 20:
        raise ValueError("capacity must be from 1 to 2**20 - 1")
    spark = df.sparkSession
    definition = Path(tokenizer_path).read_text(encoding="utf-8")
    WordEncoder(definition).check()
    shape = "doc long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(_piece_rows(spark.sparkContext.broadcast(definition), capacity, end_id, with_ids), shape)
    placed = cut(pieces.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    counts = placed.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r.length: r.n for r in placed.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan, _ = plan_sequences(histogram, capacity)
    nth = F.row_number().over(Window.partitionBy("part", "length").orderBy("at")) - 1
    ranked = placed.withColumn("nth", nth).join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    names = ["doc", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    out = ranked.select(*names, "rank").mapInArrow(_place(spark.sparkContext.broadcast(plan), capacity), shape + ", sequence_id long, offset long")
    return out.withColumnRenamed("doc", id_col)

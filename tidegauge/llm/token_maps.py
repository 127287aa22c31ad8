"""Counts of 64-bit tokens over a whole table, as maps of fixed size: which tokens are repeated, which are frequent."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, release, tidy

_U = np.uint64
_FLUSH = 1 << 21  # tokens that a task holds before it hands out counts
_RANGE_TOKENS = 1 << 24  # tokens of one range of the count
_SUB_BITS = 32
_OFTEN_BITS = 24  # the map of frequent tokens has 2 MB whatever the input
_OFTEN_FILL = 1 << 20
_TWICE_BITS = 26  # the map of tokens in two sets or more has 8 MB whatever the input
_LEVELS = (32, 256, 2048, 16384, 1 << 17)
#: From a batch the sorted distinct tokens of each row's set; tokens are spread evenly over 64 bits.
Sets = Callable[[pa.RecordBatch], Iterator[np.ndarray]]


def _pack(sorted_tokens: np.ndarray) -> bytes:
    """Gaps between sorted 32-bit numbers as two planes; the upper one is nearly empty and compresses in the exchange."""
    gaps = np.diff(sorted_tokens, prepend=np.uint32(0)).astype("<u4").view("<u2")
    return gaps[0::2].tobytes() + gaps[1::2].tobytes()


def _unpack(raw: memoryview) -> np.ndarray:
    planes = np.frombuffer(raw, "<u2").astype(np.uint32)
    half = len(planes) // 2
    return np.cumsum(planes[:half] | (planes[half:] << np.uint32(16)), dtype=np.uint32)


def _count_rows(sets: Sets, bits: int):
    """Tokens of a task, counted and dealt by their leading bits: (range, tokens seen once, tokens seen more, counts)."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        sub = (tokens >> _U(64 - bits - _SUB_BITS)).astype(np.uint32)
        edges = np.searchsorted(tokens, (np.arange(1 << bits, dtype=np.uint64) << _U(64 - bits)), "left").tolist() + [len(tokens)]
        once, more, many = [], [], []
        for a, b in zip(edges[:-1], edges[1:]):
            s, c = sub[a:b], counts[a:b]
            once.append(_pack(s[c == 1]))
            more.append(_pack(s[c > 1]))
            many.append(c[c > 1].astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(range(1 << bits), pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary()), pa.array(many, pa.binary())], names=["range", "once", "more", "many"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for s in sets(batch):
                held.append(s)
                n += len(s)
                if n >= max(_FLUSH, 8 << bits):
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return tidy(rows)


def _map_slice(sub: np.ndarray, width: int) -> bytes:
    """Bits of a range's part of a map: set at the leading ``width`` bits of each token."""
    slot = np.zeros(1 << width, bool)
    slot[sub >> np.uint32(_SUB_BITS - width)] = True
    return zlib.compress(np.packbits(slot).tobytes(), 1)


def _frequent(bits: int):
    """One range: the map bits of the tokens in at least two documents (level 2) and in at least each level's number."""

    def reduce(t: pa.Table) -> pa.Table:
        once = np.sort(np.concatenate([_unpack(x.as_buffer()) for x in t.column("once")]))
        more = np.concatenate([_unpack(x.as_buffer()) for x in t.column("more")])
        many = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("many")]).astype(np.int64)
        cut_at = np.flatnonzero(np.append(True, once[1:] != once[:-1])) if len(once) else np.empty(0, np.int64)
        n_once = np.diff(np.append(cut_at, len(once)))
        alone = ~np.isin(once[cut_at], more) & (n_once == 1)  # most tokens: in one document of all
        keys = np.concatenate([once[cut_at][~alone], more])
        counts = np.concatenate([n_once[~alone], many])
        kept, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, weights=counts) if len(keys) else np.empty(0)
        levels = [2, *_LEVELS]
        often = [kept[total >= x] for x in levels]
        maps = [_map_slice(x, (_OFTEN_BITS if k else _TWICE_BITS) - bits) for k, x in enumerate(often)]
        r = t.column("range")[0].as_py()
        return pa.table({"range": pa.array([r] * len(levels), pa.int32()), "level": pa.array(levels, pa.int32()), "n": pa.array([len(x) for x in often], pa.int64()), "map": pa.array(maps, pa.binary())})

    return reduce


def token_maps(rows: DataFrame, tokens: int, sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Two maps of fixed size over the tokens' leading bits, counted over every token of every set.

    The first is set where a frequent token falls. It only chooses the order in which a set's tokens are probed: any
    function of the token gives the same links. The second is set where a token of two sets or more falls;
    a token that it lacks links nothing. False positives cost time and never a link.
    """
    bits = min(18, max(5, int(np.ceil(np.log2(max(1, tokens / _RANGE_TOKENS))))))
    counted = rows.mapInArrow(_count_rows(sets, bits), "range int, once binary, more binary, many binary")
    maps = cut(counted.groupBy("range").applyInArrow(_frequent(bits), "range int, level int, n long, map binary"))
    sums = {r.level: r.n for r in maps.groupBy("level").agg(F.sum("n").alias("n")).collect()}
    level = next((x for x in _LEVELS if sums.get(x, 0) <= _OFTEN_FILL), _LEVELS[-1])
    out = []
    for at, width in ((level, _OFTEN_BITS), (2, _TWICE_BITS)):
        whole, size = np.zeros(1 << (width - 3), np.uint8), 1 << (width - bits - 3)
        for r in maps.where(F.col("level") == at).select("range", "map").collect():  # one map of fixed size, in compressed slices
            whole[r.range * size : (r.range + 1) * size] = np.frombuffer(zlib.decompress(r.map), np.uint8)
        out.append(whole)
    release()
    return out[0], out[1]


def is_set(tokens: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = tokens >> _U(64 - (int(len(table)).bit_length() + 2))
    return (table[at >> _U(3)] >> (7 - (at & _U(7))).astype(np.uint8)) & 1 > 0

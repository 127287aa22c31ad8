"""Ordinal quality grades: a cumulative-link regression on hashed text features with shared weights."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import blocks, byte_class, mix, text_buffer, word_hashes, word_spans
from .runtime import release, same_columns, tidy

_U = np.uint64
_WORD = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_CHUNK = byte_class(b" \t\n\x0b\x0c\r")
#: Shape features: shares of bytes of a kind, in steps of ``_STEPS``.
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_MARKS = np.zeros(256, np.int64)
_MARKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 1
_MARKS[list(b".,;:'-\"()?")] = 0
_STEPS = np.array([0.002, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5])
_PREFIXES = (4, 5, 6)


def features(buf: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashed features: words, word beginnings, and steps of its shape."""
    shift = _U(64 - bits)
    for lo, hi in blocks(offsets):
        part, own = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = word_spans(part, own, _WORD)
        kinds = [word_hashes(part, starts, ends)]
        for k in _PREFIXES:
            h = mix(word_hashes(part, starts, np.minimum(ends, starts + k)) + _U(k))
            kinds.append(np.where(ends - starts > k, h, kinds[0]))
        table = np.column_stack([h >> shift for h in kinds]).astype(np.int32) if len(starts) else np.empty((0, len(kinds)), np.int32)
        c_starts, c_ends, c_first = word_spans(part, own, _CHUNK)
        chunks = word_hashes(part, c_starts, c_ends)
        again = np.zeros(len(chunks) + 1, np.int64)
        if len(chunks):
            same = np.zeros(len(chunks), np.int64)
            same[1:] = chunks[1:] == chunks[:-1]
            np.cumsum(same, out=again[1:])
        upper, marks = (np.concatenate([[0], np.cumsum(kind[part])]) for kind in (_UPPER, _MARKS))
        size = np.maximum(1, np.diff(own))
        n_chunks = np.maximum(1, np.diff(c_first))
        shape = np.column_stack([
            np.searchsorted(_STEPS, np.diff(upper[own]) / size),
            np.searchsorted(_STEPS, np.diff(marks[own]) / size),
            np.searchsorted(_STEPS, np.diff(again[c_first]) / n_chunks),
            np.log2(n_chunks).astype(np.int64),
        ])
        codes = (mix((np.arange(shape.shape[1]) * 64 + shape + 7).astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> shift).astype(np.int32)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            yield np.unique(np.concatenate([table[a:b].ravel(), codes[i]])) if c_first[i + 1] > c_first[i] else table[:0].ravel()


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade <= k) = sigmoid(thresholds[k] - score); the score is the sum of a text's feature weights."""

    bits: int
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. as columns; never increasing with k, and 0 where the score is minus infinity."""
        s = scores.reshape(-1, 1).astype(np.float64)
        return np.where(np.isneginf(s), 0.0, 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - s, -500, 500))))


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-x)) if x > -500 else 0.0


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, *, bits: int, levels: int, rate: float = 0.3, l1: float = 0.1, l2: float = 0.01, screen: float = 7.0, epochs: int = 20) -> OrdinalModel:
    """Cumulative-link likelihood by follow-the-regularised-leader steps with a step size for each feature.

    The order of the rows is shuffled by a fixed seed; thresholds stay in order. Only features get a weight with which
    some tail P(grade >= k) differs from its mean by ``screen`` standard errors, so that a long text's many
    indifferent words don't outweigh the few that tell. Below 4,900 rows the screen falls with the root of their
    number: a feature of one grade passes if about the same share of the rows has it. With fewer than two grades
    present the thresholds alone tell the grade that was seen (or, without rows, none).
    """
    weights = np.zeros(1 << bits, np.float32)
    share = np.bincount(grades, minlength=levels).astype(float) + 0.5
    below = np.cumsum(share)[:-1] / share.sum()
    theta = np.log(below / (1 - below))
    if not len(rows) or len(np.unique(grades)) < 2:
        return OrdinalModel(bits, weights, theta)
    # counts of each feature at and above each grade, some rows at a time: the driver holds the rows once
    df = np.zeros((levels, 1 << bits), np.int32)
    for lo in range(0, len(rows), 1000):
        flat = np.concatenate(rows[lo : lo + 1000])
        each = np.repeat(grades[lo : lo + 1000], [len(r) for r in rows[lo : lo + 1000]])
        for k in range(levels):
            df[k] += np.bincount(flat[each >= k] if k else flat, minlength=1 << bits).astype(np.int32)
    strength = np.zeros(1 << bits, np.float32)
    for k in range(1, levels):
        p = min(max((grades >= k).mean(), 1e-6), 1 - 1e-6)
        strength = np.maximum(strength, np.abs(df[k] - p * df[0]) / np.sqrt(np.maximum(df[0], 1) * p * (1 - p)))
    names = np.flatnonzero(strength >= min(screen, len(rows) ** 0.5 / 10))
    column = np.full(1 << bits, -1, np.int32)
    column[names] = np.arange(len(names))
    data = [c[c >= 0] for c in (column[r] for r in rows)]
    z, n, w = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    theta_n = np.full(len(theta), 1.0)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(data)).tolist():
            f, y = data[i], int(grades[i])
            own = w[f]
            eta = float(own.sum())
            hi = _sigmoid(theta[y] - eta) if y < levels - 1 else 1.0
            lo = _sigmoid(theta[y - 1] - eta) if y else 0.0
            g = 1.0 - hi - lo  # slope of the negative log-likelihood by the score
            p = max(hi - lo, 1e-9)
            for k, slope in ((y, -hi * (1 - hi) / p), (y - 1, lo * (1 - lo) / p)):
                if 0 <= k < levels - 1:
                    theta_n[k] += slope * slope
                    theta[k] -= rate * slope / math.sqrt(theta_n[k])
            theta = np.maximum.accumulate(theta)
            if abs(g) > 1e-4 and len(f):
                old = n[f]
                new = old + g * g
                zf = z[f] + g - (np.sqrt(new) - np.sqrt(old)) / rate * own
                n[f], z[f] = new, zf
                w[f] = -np.sign(zf) * np.maximum(np.abs(zf) - l1, 0) / ((1.0 + np.sqrt(new)) / rate + l2)
    weights[names] = w
    return OrdinalModel(bits, weights, theta)


def _sample_rows(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.tobytes() for f in features(*text_buffer(batch.column(1)), bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["of", "features"])

    return tidy(rows)


def fit_quality(docs: DataFrame, ratings: DataFrame, *, levels: int, id_col: str = "doc_id", text_col: str = "text", rating_col: str = "grade", sample: int = 16_000, bits: int = 20) -> OrdinalModel:
    """The model from at most ``sample`` rated documents, chosen by the hash of their id.

    Ratings are whole numbers from 0 to ``levels`` - 1; null ids, null ratings, others, and rated texts without words
    are left out. An id with several ratings counts with its least, one with several texts with the least text.
    Equal tables give equal models, however their rows are dealt.
    """
    rated = ratings.where(F.col(rating_col).between(0, levels - 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("rated")).agg(F.min(rating_col).cast("long").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("rated"), "rated").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc") == F.col("rated"))  # sample rows at most
    got = texts.groupBy("rated", "grade").agg(F.min("text").alias("text")).select(F.struct("rated", "grade").alias("of"), "text").mapInArrow(_sample_rows(bits), "of struct<rated: long, grade: long>, features binary").where(F.octet_length("features") > 0)
    # steps are taken in the order of the ids, however the rows are dealt
    rows = sorted(((r.of.rated, r.of.grade, np.frombuffer(r.features, np.int32)) for r in got.toLocalIterator()), key=lambda r: r[0])
    model = fit_ordinal([f for *_, f in rows], np.array([g for _, g, _ in rows], np.int64), bits=bits, levels=levels)
    del rows
    release()
    return model


def _score_rows(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            scores = np.array([m.weights[f].sum(dtype=np.float64) if len(f) else -np.inf for f in features(*text_buffer(batch.column(1)), m.bits)])
            tails = m.tails(scores)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1) * tails.shape[1], pa.int32()), pa.array(tails.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), flat], names=["doc", "expected_grade", "tails"])

    return tidy(rows)


def _kept_rows(model, tail: int, least: float, at: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for lo, hi in blocks(text_buffer(batch.column(at))[1], 8 << 20):
                part = batch.slice(lo, hi - lo)
                scores = np.array([m.weights[f].sum(dtype=np.float64) if len(f) else -np.inf for f in features(*text_buffer(part.column(at)), m.bits)])
                yield part.filter(pa.array(m.tails(scores)[:, tail - 1] >= least))

    return tidy(rows)


def select_documents(df: DataFrame, model: OrdinalModel, *, tail: int, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns unchanged, with P(grade >= tail) of at least ``least``; one pass, no exchange.

    Null, empty and blank texts go. Ids play no part, so repeated rows and null ids are judged like others.
    """
    if not 1 <= tail <= len(model.thresholds):
        raise ValueError("tail must be one of the grades above 0")
    return same_columns(df, _kept_rows(df.sparkSession.sparkContext.broadcast(model), tail, least, df.columns.index(text_col)))


def grade_documents(df: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, expected_grade and tails (P(grade >= 1), P(grade >= 2), ...).

    Null, empty and blank texts have grade 0 for certain. Repeated rows give repeated rows, null ids stay null, an
    empty table gives no rows, other columns are ignored. The model is broadcast; its size is fixed by ``bits``.
    """
    out = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(_score_rows(df.sparkSession.sparkContext.broadcast(model)), "doc long, expected_grade double, tails array<double>")
    return out.withColumnRenamed("doc", id_col)

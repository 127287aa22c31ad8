"""Benchmark decontamination with a document-partitioned positional inverted index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import blocks, byte_class, text_buffer, word_hashes, word_spans
from .runtime import cut, same_columns, stored, tidy

#: Words of items and documents: runs of ASCII letters and digits and of bytes from 0x80.
WORD_BYTES = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_INDEX_COLUMNS = ("doc", "n_words", "terms", "ends", "positions")
_INDEX = ", ".join(f"{c} binary" for c in _INDEX_COLUMNS)
_PROBE_WINDOWS = 1 << 18


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = text_buffer(batch.column(1))
        starts, ends, first = word_spans(buf, offsets, WORD_BYTES)
        h = word_hashes(buf, starts, ends).view(np.int64)
        flat = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h))
        yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["item", "words"])


def item_words(items: DataFrame, *, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words): the items' word fingerprints in order; a null or wordless text has an empty list."""
    return items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).mapInArrow(_vocabulary, "item long, words array<long>")


def _postings(ids: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> Iterator[dict]:
    """Index rows, one for each block of texts."""
    for lo, hi in blocks(offsets):
        part, own = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = word_spans(part, own, WORD_BYTES)
        n_words = np.diff(first)
        h = word_hashes(part, starts, ends)
        # positions count all words, with a gap of one word between documents that no phrase can cross
        pos = np.arange(len(h)) + np.repeat(np.arange(len(n_words)), n_words)
        order = np.argsort(h, kind="stable")
        h, pos = h[order], pos[order]
        cuts = np.flatnonzero(np.append(h[1:] != h[:-1], True)) + 1 if len(h) else np.empty(0, np.int64)
        wide = np.int64 if len(pos) and len(pos) + len(n_words) > 2**31 else np.int32
        yield {"doc": ids[lo:hi].astype(np.int64), "n_words": n_words.astype(np.int64), "terms": h[cuts - 1] if len(h) else h, "ends": cuts.astype(np.int64), "positions": pos.astype(wide)}


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # null ids travel as the smallest number and come back as null
        ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
        for row in _postings(ids, *text_buffer(batch.column(1))):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row.values()], names=list(row))


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def positional_index(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block of about 2 MB of documents: their ids and word counts, the block's terms and posting lists.

    The index holds every word and is partitioned by document, so phrases are found without moving a posting: no term,
    however frequent, gathers in one task. Null texts have no words; a text longer than a block is a block of its own.
    The frame can be written as Parquet and searched for any test set. An empty table gives no rows; other columns are
    ignored.
    """
    return _documents(df, id_col, text_col).mapInArrow(tidy(_index_rows), _INDEX)


class _Block:
    """One row of the index, for lookups."""

    def __init__(self, row: dict):
        self.doc = np.frombuffer(row["doc"], np.int64)
        self.n_words = np.frombuffer(row["n_words"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.ends = np.frombuffer(row["ends"], np.int64)
        n = int(self.ends[-1]) if len(self.ends) else 0
        self.positions = np.frombuffer(row["positions"], np.int32 if len(row["positions"]) == 4 * n else np.int64).astype(np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if len(self.ends) else self.ends
        self.first = np.concatenate([[0], np.cumsum(self.n_words + 1)])  # where each document's positions begin
        self.span = int(self.first[-1]) + 1
        self.keys = np.repeat(np.arange(len(self.terms)), self.ends - self.begins) * self.span + self.positions

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Numbers of terms in the block, -1 if absent."""
        if not len(self.terms):
            return np.full(words.shape, -1)
        k = np.searchsorted(self.terms, words)
        k[k == len(self.terms)] = 0
        return np.where(self.terms[k] == words, k, -1)

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every exact occurrence; all windows have one width.

        Each window starts from its rarest term's postings here; the other terms' lists, shifted by their offsets,
        are intersected from the rarest to the most frequent.
        """
        slots = self.slots(windows)
        alive = np.flatnonzero((slots >= 0).all(axis=1))
        slots = slots[alive]
        if not len(alive):
            return alive, alive
        lengths = (self.ends - self.begins)[slots]
        order = np.argsort(lengths, axis=1, kind="stable")
        rows = np.arange(len(alive))
        rare = slots[rows, order[:, 0]]
        counts = self.ends[rare] - self.begins[rare]
        owner = np.repeat(rows, counts)
        nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        start = self.positions[self.begins[rare][owner] + nth] - order[owner, 0]
        for j in range(1, windows.shape[1]):
            want = start + order[owner, j]
            key = slots[owner, order[owner, j]] * self.span + want
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            found = (self.keys[at] == key) & (want >= 0) & (start >= 0)
            owner, start = owner[found], start[found]
        keep = start >= 0
        return alive[owner[keep]], start[keep]

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1


class _Items:
    """Some test items: their words one after the other, and where each begins."""

    def __init__(self, items: list[int], words: list[np.ndarray]):
        self.items = np.array(items, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        self.words = np.concatenate([np.empty(0, np.uint64), *words])

    def windows(self, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item numbers, windows), some at a time: all runs of ``width`` words, or the whole of a shorter item."""
        sizes = np.diff(self.offsets)
        for size in np.unique(np.minimum(sizes, width)).tolist():
            own = np.flatnonzero(sizes >= size) if size == width else np.flatnonzero(sizes == size)
            if size:
                runs = sizes[own] - size + 1
                at = np.repeat(self.offsets[own] - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))
                items = np.repeat(self.items[own], runs)
                for lo in range(0, len(at), _PROBE_WINDOWS):
                    yield items[lo : lo + _PROBE_WINDOWS], self.words[at[lo : lo + _PROBE_WINDOWS, None] + np.arange(size)]


class _Found:
    """What is found in one block so far: the words hit and the items of each document."""

    def __init__(self, b: _Block, row: dict):
        self.b = b
        self.hit = np.unpackbits(np.frombuffer(row["hit"], np.uint8))[: b.span].astype(bool) if row.get("hit") else np.zeros(b.span, bool)
        self.pairs = [np.frombuffer(row["pairs"], np.int64).reshape(-1, 2)] if row.get("pairs") else []

    def search(self, items: _Items, width: int) -> None:
        cover = np.zeros(self.b.span + 1, np.int64)
        for item, table in items.windows(width):
            w, p = self.b.phrases(table)
            if len(w):
                np.add.at(cover, p, 1)
                np.add.at(cover, p + table.shape[1], -1)
                self.pairs.append(np.unique(np.column_stack([self.b.document(p), item[w]]), axis=0))
        self.hit |= np.cumsum(cover)[:-1] > 0

    def n_hit(self) -> np.ndarray:
        hit = np.concatenate([[0], np.cumsum(self.hit)])
        return hit[self.b.first[1:] - 1] - hit[self.b.first[:-1]]

    def items(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.b.doc]
        if self.pairs:
            for d, i in np.unique(np.concatenate(self.pairs), axis=0).tolist():
                out[d].append(i)
        return out


def _searched(items, width: int, last: bool):
    """Index rows with what some items add to what was found before; after the ``last`` items a row per document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row)
                found = _Found(b, row)
                found.search(items.value, width)
                if last:
                    yield pa.RecordBatch.from_arrays([pa.array(b.doc, mask=b.doc == np.iinfo(np.int64).min), pa.array(b.n_words), pa.array(found.n_hit().astype(np.int64)), pa.array(found.items(), pa.list_(pa.int64()))], names=["doc", "n_words", "n_hit", "items"])
                else:
                    pairs = np.concatenate(found.pairs) if found.pairs else np.empty((0, 2), np.int64)
                    row |= {"hit": np.packbits(found.hit).tobytes(), "pairs": np.unique(pairs, axis=0).tobytes()}
                    yield pa.RecordBatch.from_pylist([row], schema=pa.schema([(k, pa.binary()) for k in (*_INDEX_COLUMNS, "hit", "pairs")]))

    return tidy(rows)


def _chunks(items: DataFrame, item_col: str, text_col: str, chunk_words: int) -> tuple[int, Iterator]:
    """(number of chunks, chunks): the test items in broadcast parts of about ``chunk_words`` words, one at a time.

    Items go to chunks by the hash of their id, a longer item is nearly a chunk of its own.
    """
    spark = items.sparkSession
    listed = cut(item_words(items, item_col=item_col, text_col=text_col).where("item is not null").select("item", "words", F.size("words").alias("n")))
    total = listed.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    chunks = max(1, -(-int((total.n or 0) + total.rows) // chunk_words))

    def each():
        for c in range(chunks):
            own = listed.where(F.pmod(F.xxhash64("item"), F.lit(chunks)) == c).select("item", "words")
            got = [(r.item, np.array(r.words, np.int64).view(np.uint64)) for r in own.toLocalIterator()]
            yield spark.sparkContext.broadcast(_Items([i for i, _ in got], [w for _, w in got]))

    return chunks, each()


def phrase_matches(index: DataFrame, items: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", width: int = 10, chunk_words: int = 4_000_000) -> DataFrame:
    """(doc, n_words, n_hit, items) of every document of ``index``; see :func:`decontaminate`.

    Each chunk of items is one pass over the index, which carries what was found before; no posting and no text moves.
    """
    n, chunks = _chunks(items, item_col, item_text_col, chunk_words)
    for k, chunk in enumerate(chunks, 1):
        if k < n:
            index = stored(index.mapInArrow(_searched(chunk, width, False), f"{_INDEX}, hit binary, pairs binary"), "postings")
            chunk.unpersist()
    return index.mapInArrow(_searched(chunk, width, True), "doc long, n_words long, n_hit long, items array<long>")


def decontaminate(df: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, chunk_words: int = 4_000_000) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (the sorted distinct item ids whose windows occur).

    A window is ``width`` consecutive words of an item, or the whole of an item with fewer words; matching is exact on
    64-bit word fingerprints with A-Z lower-cased. A document word inside any occurrence is hit, once.

    The index of all documents is written to the shared folder and searched from there. Items go to the executors as
    words in chunks of about ``chunk_words``, one at a time; a larger test set is several passes over the index.

    Null and wordless texts have n_words 0 and hit nothing; null or wordless items have no windows; items of equal
    text all count; repeated rows give repeated rows; null ids stay null. Empty tables give no hits or no rows. Other
    columns are ignored.
    """
    if width < 1:
        raise ValueError("width must be positive")
    index = stored(positional_index(df, id_col=id_col, text_col=text_col), "postings")
    return phrase_matches(index, items, item_col=item_col, item_text_col=item_text_col, width=width, chunk_words=chunk_words).withColumnRenamed("doc", id_col)


def _clean_rows(items, width: int, at: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(at))
            lo = 0
            for row in _postings(np.zeros(len(offsets) - 1, np.int64), buf, offsets):
                found = _Found(_Block({k: v.tobytes() for k, v in row.items()}), {})
                found.search(items.value, width)
                yield batch.slice(lo, len(found.b.doc)).filter(pa.array(found.n_hit() == 0))
                lo += len(found.b.doc)

    return tidy(rows)


def without_leaks(df: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, chunk_words: int = 4_000_000) -> DataFrame:
    """The rows of ``df``, all columns unchanged, with no word inside a window of an item.

    The index of a block is searched where its rows are, so nothing is moved or stored; each chunk of items is one
    more filter. Rows play no part by their ids: null ids and repeated rows are judged like others. Null texts stay.
    """
    _, chunks = _chunks(items, item_col, item_text_col, chunk_words)
    for chunk in chunks:
        df = same_columns(df, _clean_rows(chunk, width, df.columns.index(text_col)))
    return df


def _near(items, slack: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = items.value
        for batch in batches:
            docs, found, at = [], [], []
            for row in batch.to_pylist():
                b = _Block(row)
                known = b.slots(chunk.words) if len(chunk.words) else np.empty(0, np.int64)
                alive = np.concatenate([[0], np.cumsum(known < 0)])
                for k, item in enumerate(chunk.items.tolist()):
                    lo, hi = int(chunk.offsets[k]), int(chunk.offsets[k + 1])
                    if lo == hi or alive[hi] > alive[lo]:
                        continue
                    for d, p in _spans(b, np.unique(known[lo:hi]), hi - lo + slack):
                        docs.append(int(b.doc[d]))
                        found.append(item)
                        at.append(p - int(b.first[d]))
            missing = np.array(docs, np.int64) == np.iinfo(np.int64).min
            yield pa.RecordBatch.from_arrays([pa.array(np.array(docs, np.int64), mask=missing), pa.array(found, pa.int64()), pa.array(at, pa.int64())], names=["doc", "item", "position"])

    return tidy(rows)


def _spans(b: _Block, slots: np.ndarray, span: int) -> Iterator[tuple[int, int]]:
    """(document, position): the first place in each document from which ``span`` words hold all terms ``slots``.

    Lists are taken from the rarest term on: only what lies within a span of its postings is looked at.
    """
    lists = sorted((b.positions[b.begins[s] : b.ends[s]] for s in slots.tolist()), key=len)
    near = lists[0]
    for other in lists[1:]:  # postings of the rarest term that have every other term within a span, in their document
        lo, hi = np.searchsorted(other, near - span + 1), np.searchsorted(other, near + span)
        near = near[hi > lo]
        if not len(near):
            return
    doc = b.document(near)
    lo = np.maximum(b.first[doc], near - span + 1)
    hi = np.minimum(b.first[doc + 1] - 1, near + span)
    told = -1
    for d, a, z in zip(doc.tolist(), lo.tolist(), hi.tolist()):
        if d == told:
            continue
        parts = [x[np.searchsorted(x, a) : np.searchsorted(x, z)] for x in lists]
        if not all(len(x) for x in parts):
            continue
        where = np.concatenate(parts)
        which = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        order = np.argsort(where, kind="stable")
        last = np.full(len(parts), -(2**60))
        for q, k in zip(where[order].tolist(), which[order].tolist()):
            last[k] = q
            if q - last.min() < span:
                told = d
                yield d, int(where[order][np.searchsorted(where[order], q - span + 1)])
                break


def proximity_matches(index: DataFrame, items: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", slack: int = 10, chunk_words: int = 4_000_000) -> DataFrame:
    """(doc, item, position): documents of ``index`` with all words of an item in any order close together.

    Close: within a span of as many words as the item has and ``slack`` more. ``position`` is the first word of the
    first such place, one row for each document and item; rows of one id are documents of their own. Wordless items
    match nothing. The search starts from the postings of the item's rarest term in a block.
    """
    out = None
    for chunk in _chunks(items, item_col, item_text_col, chunk_words)[1]:
        part = index.mapInArrow(_near(chunk, slack), "doc long, item long, position long")
        out = part if out is None else out.unionByName(part)
    return out


def items_digest(items: list[int]) -> str:
    """SHA-256 of the ids, sorted as strings and comma-joined."""
    return hashlib.sha256(",".join(_id_list(np.array(items, np.int64))).encode()).hexdigest()

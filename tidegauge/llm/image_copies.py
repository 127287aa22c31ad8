"""Cropped and edited image copies: multiscale corners, orientation-normalised binary tests, Hamming tables, consensus.

Images are grey PGM ("P5") bytes in a column. Everything but the descriptors of single images is DataFrame work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import mix
from .components import connected_components
from .runtime import cut, shuffle_partitions, tidy
from .token_maps import is_set, token_maps

_RADIUS = 9  # of the patch that gives a corner its direction and its tests
_TESTS = 256
_TURNS = 32
_TABLES = 3
_SCALES = (1.0, 1.5, 2.0)
#: A corner stays if fewer than _KEEP stronger ones lie within _NEAR pixels: what a picture keeps, a crop of it keeps too.
_KEEP = (6, 8, 8)
_NEAR = 24
_MARGIN = _RADIUS + 2
#: A test holds if its second point is brighter by that much of its patch's deviation: flat ground decides no test by its noise.
_LEAST = 0.1
#: A corner's neighbours: so many of the nearest within reach, their places told in rings and sectors.
_NEIGHBOURS, _REACH, _RING, _SECTORS = 3, 32.0, 3.0, 12
_U = np.uint64


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % pixels.shape[::-1] + pixels.astype(np.uint8).tobytes()


def decode_pgm(raw: bytes | None) -> np.ndarray | None:
    """Grey pixels, or None for what isn't a whole 8-bit PGM image."""
    parts = (raw or b"").split(None, 4)
    if len(parts) < 4 or parts[0] != b"P5" or not all(x.isdigit() for x in parts[1:4]) or parts[3] != b"255":
        return None
    width, height = int(parts[1]), int(parts[2])
    pixels = raw[len(raw) - width * height :]
    if width * height == 0 or len(raw) != len(raw[: raw.index(b"255") + 4]) + width * height:
        return None
    return np.frombuffer(pixels, np.uint8).reshape(height, width)


def _pattern() -> np.ndarray:
    """For each turn the (dy, dx) of both points of each test, inside the patch."""
    rng = np.random.default_rng(11)
    points = np.clip(rng.normal(0, _RADIUS / 2.2, (_TESTS, 2, 2)), -_RADIUS * 0.68, _RADIUS * 0.68)
    angle = 2 * np.pi * np.arange(_TURNS) / _TURNS
    c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    y, x = points[None, :, :, 0], points[None, :, :, 1]
    return np.rint(np.stack([x * s + y * c, x * c - y * s], axis=-1)).astype(np.int64)


_TURNED = _pattern()
_BITS = np.random.default_rng(12).permutation(_TESTS)[: 32 * _TABLES].reshape(_TABLES, 32)
_DISC_Y, _DISC_X = np.array([(y, x) for y in range(-_RADIUS, _RADIUS + 1) for x in range(-_RADIUS, _RADIUS + 1) if y * y + x * x <= _RADIUS * _RADIUS]).T


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over (2r+1) squares of the last two axes, with edges repeated."""
    for axis in (-1, -2):
        a = np.moveaxis(a, axis, -1)
        wide = np.empty((*a.shape[:-1], a.shape[-1] + 2 * r))
        wide[..., r:-r] = a
        wide[..., :r], wide[..., -r:] = a[..., :1], a[..., -1:]
        total = wide[..., : a.shape[-1]].copy()
        for k in range(1, 2 * r + 1):
            total += wide[..., k : k + a.shape[-1]]
        a = np.moveaxis(total, -1, axis)
    return a / (2 * r + 1) ** 2


def _shrunk(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1.0:
        return a
    h, w = int(a.shape[0] / scale), int(a.shape[1] / scale)
    y, x = (np.arange(h) + 0.5) * scale - 0.5, (np.arange(w) + 0.5) * scale - 0.5
    soft = _box(a, 1)
    y0, x0 = np.clip(y.astype(int), 0, a.shape[0] - 2), np.clip(x.astype(int), 0, a.shape[1] - 2)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda i, j: soft[np.ix_(y0 + i, x0 + j)]
    return (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy


def _strongest(y: np.ndarray, x: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Whether fewer than ``keep`` stronger corners lie near each; y ascends. Equal scores: the earlier is stronger."""
    out = np.ones(len(y), bool)
    at = np.arange(len(y))
    for lo in range(0, len(y), 256):
        hi = min(lo + 256, len(y))
        a, b = np.searchsorted(y, y[lo] - _NEAR, "left"), np.searchsorted(y, y[hi - 1] + _NEAR, "right")
        near = (y[lo:hi, None] - y[None, a:b]) ** 2 + (x[lo:hi, None] - x[None, a:b]) ** 2 <= _NEAR * _NEAR
        stronger = (score[None, a:b] > score[lo:hi, None]) | ((score[None, a:b] == score[lo:hi, None]) & (at[None, a:b] < at[lo:hi, None]))
        out[lo:hi] = (near & stronger).sum(axis=1) < keep
    return out


def corners(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) of y, x (in the image), scale and turn; (n, 256) binary tests. Small or flat images have none."""
    places, tests = [], []
    for scale, keep in zip(_SCALES, _KEEP):
        a = _shrunk(pixels.astype(np.float64), scale)
        if min(a.shape) <= 2 * _MARGIN + 2:
            continue
        smooth = _box(a, 1)
        gy, gx = np.gradient(smooth)
        xx, yy, xy = _box(np.stack([gx * gx, gy * gy, gx * gy]), 2)
        score = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = score[_MARGIN:-_MARGIN, _MARGIN:-_MARGIN]
        around = np.max([score[2 + k : score.shape[0] - 2 + k] for k in range(-2, 3)], axis=0)
        around = np.max([around[:, 2 + k : score.shape[1] - 2 + k] for k in range(-2, 3)], axis=0)[_MARGIN - 2 : -(_MARGIN - 2), _MARGIN - 2 : -(_MARGIN - 2)]
        y, x = np.nonzero((inner == around) & (inner > 50.0))
        best = _strongest(y, x, inner[y, x], keep)
        y, x = y[best] + _MARGIN, x[best] + _MARGIN
        if not len(y):
            continue
        patch = smooth[y[:, None] + _DISC_Y, x[:, None] + _DISC_X]
        patch = patch - patch.mean(axis=1, keepdims=True)
        angle = np.arctan2((patch * _DISC_Y).sum(axis=1), (patch * _DISC_X).sum(axis=1))
        turn = np.rint(angle * _TURNS / (2 * np.pi)).astype(np.int64) % _TURNS
        p = _TURNED[turn]
        v = smooth[y[:, None, None] + p[..., 0], x[:, None, None] + p[..., 1]]
        tests.append(v[..., 1] - v[..., 0] > _LEAST * patch.std(axis=1)[:, None])
        places.append(np.column_stack([(y + 0.5) * scale - 0.5, (x + 0.5) * scale - 0.5, np.full(len(y), scale), turn]))
    if not places:
        return np.empty((0, 4)), np.empty((0, _TESTS), bool)
    return np.concatenate(places), np.concatenate(tests)


_CORNER = np.dtype([("codes", "<u4", (_TABLES,)), ("y", "<u4"), ("x", "<u4"), ("scale", "u1"), ("turn", "u1")])
_DESCRIBED = "id long, node long, corners binary"


def pack_corners(place: np.ndarray, tests: np.ndarray) -> np.ndarray:
    """The tables' codes of each corner, its place in quarters of a pixel, its scale and turn."""
    r = np.zeros(len(place), _CORNER)
    r["codes"] = tests[:, _BITS] @ np.left_shift(np.int64(1), np.arange(32, dtype=np.int64))
    for name, k in (("y", 0), ("x", 1)):
        r[name] = np.maximum(0, np.rint(place[:, k] * 4))
    r["scale"] = np.searchsorted(_SCALES, place[:, 2])
    r["turn"] = place[:, 3]
    return r


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            node, packed = [], []
            for raw in part.column(1):
                pixels = decode_pgm(raw.as_py())
                node.append(None if pixels is None else int.from_bytes(hashlib.blake2b(repr(pixels.shape).encode() + pixels.tobytes(), digest_size=8).digest(), "little", signed=True))
                packed.append(b"" if pixels is None else pack_corners(*corners(pixels)).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node, pa.int64()), pa.array(packed, pa.binary())], names=["id", "node", "corners"])


def _nearest(y: np.ndarray, x: np.ndarray, reach: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each corner its nearest ones and whether they are within reach; whole numbers, y ascends, ``tie`` has 40 bits."""
    near, reached = np.zeros((len(y), _NEIGHBOURS), np.int64), np.zeros((len(y), _NEIGHBOURS), bool)
    none = np.iinfo(np.int64).max
    for lo in range(0, len(y), 64):
        hi = min(lo + 64, len(y))
        most = reach[lo:hi].max()
        a, b = int(np.searchsorted(y, y[lo] - most, "left")), int(np.searchsorted(y, y[hi - 1] + most, "right"))
        far = (y[None, a:b] - y[lo:hi, None]) ** 2 + (x[None, a:b] - x[lo:hi, None]) ** 2
        rank = np.where(far > reach[lo:hi, None] ** 2, none, (far << 40) | tie[None, a:b])
        rank[np.arange(hi - lo), np.arange(lo - a, hi - a)] = none
        k = min(_NEIGHBOURS, b - a)
        at = np.argpartition(rank, k - 1, axis=1)[:, :k]
        near[lo:hi, :k], reached[lo:hi, :k] = at + a, np.take_along_axis(rank, at, axis=1) < none
    return near, reached


def constellations(r: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct table keys of the corners of images that have ``sizes`` corners each.

    A key is a corner's code in one table with the codes of two of its nearest corners there, and their distances and
    directions as seen from it: unlike pictures that share a common corner seldom share what stands around it.
    """
    if not len(r):
        return [np.empty(0, np.uint64)] * len(sizes)
    image = np.repeat(np.arange(len(sizes)), sizes)
    # corners of one scale of one image are a group; groups lie out of each other's reach
    group = image * len(_SCALES) + r["scale"]
    order = np.lexsort((r["y"], group))
    r, group, image = r[order], group[order], image[order]
    unit = (np.array(_SCALES) * 4)[r["scale"]]  # a pixel of the scale
    y, x = r["y"].astype(np.int64), r["x"].astype(np.int64)
    reach = (unit * _REACH).astype(np.int64)
    codes = r["codes"].astype(np.uint64)
    tie = (mix(codes[:, 0] + (codes[:, 1] << _U(32))) >> _U(24)).astype(np.int64)
    near, reached = _nearest(y + group * (y.max() + 2 * reach.max()), x, reach, tie)
    dy, dx = ((v[near] - v[:, None]) / unit[:, None] for v in (y, x))
    apart = np.where(reached, np.hypot(dy, dx), 0.0)
    angle = np.arctan2(dy, dx) - r["turn"][:, None] * (2 * np.pi / _TURNS)
    place = apart // _RING * 64 + np.floor(angle * _SECTORS / (2 * np.pi)) % _SECTORS
    around = mix((codes[near] << _U(16)) + place.astype(np.uint64)[:, :, None])
    own = mix(codes + (np.arange(_TABLES, dtype=np.uint64) << _U(32)))
    keys, owners = [], []
    for i, j in combinations(range(_NEIGHBOURS), 2):
        both = reached[:, i] & reached[:, j]
        keys.append(mix(around[both, i] + around[both, j] + own[both]).ravel())
        owners.append(np.repeat(image[both], _TABLES))
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    at = np.argsort(owners, kind="stable")
    ends = np.cumsum(np.bincount(owners, minlength=len(sizes)))
    return [np.unique(part) for part in np.split(keys[at], ends[:-1])]


def _key_sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for lo in range(0, batch.num_rows, 256):
        raw = batch.column(0).slice(lo, 256).to_pylist()
        yield from constellations(np.frombuffer(b"".join(raw), _CORNER), np.array([len(x) // _CORNER.itemsize for x in raw]))


def _key_rows(maps):
    """(key, node): the keys that the map allows to another image."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = maps.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                sets = list(_key_sets(part))
                key = np.concatenate(sets)
                shared = is_set(key, twice)
                node = np.repeat(part.column(1).to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(key[shared].view(np.int64)), pa.array(node[shared])], names=["key", "node"])

    return tidy(rows)


_TILE = 64
_HELD = 1 << 20  # pairs that a task holds before it counts them
_PAIR = "u long, v long, n long"
_MET = f"{_PAIR}, key long, block int, nodes binary"


def _counted(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
    """Distinct (u, v) with their number."""
    u, v = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    at = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])))
    return [pa.array(u[at]), pa.array(v[at]), pa.array(np.diff(np.append(at, len(u))))]


def _square(x: np.ndarray, y: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of two blocks of nodes, or of one block with itself; the greater node comes first."""
    for lo in range(0, len(x), _TILE):
        a, b = (x[lo : lo + _TILE], x) if y is None else (x[lo : lo + _TILE], y)
        i, j = np.nonzero(a[:, None] > b[None, :]) if y is None else np.nonzero(a[:, None] != b[None, :])
        yield np.maximum(a[i], b[j]), np.minimum(a[i], b[j])


def _met(size: int):
    """Streams (key, node) in order: the pairs of nodes in each bucket, and for buckets of more than ``size`` nodes their blocks."""

    def whole(key: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ends = np.append(heads[1:], len(key))
        sizes = ends - heads
        # small buckets: nodes that are d apart, of all of them at once
        end = np.repeat(np.where(sizes <= _TILE, ends, 0), sizes)
        i, d = np.arange(len(key)), 1
        while len(i := i[i + d < end[i]]):
            yield node[i + d], node[i]
            d += 1
        for k in np.flatnonzero(sizes > _TILE).tolist():
            yield from _square(node[heads[k] : ends[k]], None)

    def pair_rows(pairs: list) -> pa.RecordBatch:
        counted = _counted(pairs)
        n = len(counted[0])
        return pa.RecordBatch.from_arrays([*counted, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["u", "v", "n", "key", "block", "nodes"])

    def block_row(key: int, block: int, nodes: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 3, pa.array([key]), pa.array([block], pa.int32()), pa.array([nodes.tobytes()], pa.binary())], names=["u", "v", "n", "key", "block", "nodes"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, hot, block = np.empty(0, np.int64), np.empty(0, np.int64), None, 0
        held: list = []
        for batch in batches:
            key, node = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([node, batch.column(1).to_numpy()])
            if len(key):  # an image that several rows have is one node
                new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
                key, node = key[new], node[new]
            if hot is not None:  # the rest of a bucket that already has blocks
                n = int(np.searchsorted(key, hot, "right"))
                while n >= size or (n and n < len(key)):
                    m = min(n, size)
                    yield block_row(hot, block, node[:m])
                    key, node, n, block = key[m:], node[m:], n - m, block + 1
                if n == len(key):
                    continue
                hot = None
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1], "left"))
            for pair in whole(key[:last], node[:last]) if last else ():
                held.append(pair)
                if sum(len(u) for u, _ in held) >= _HELD:
                    yield pair_rows(held)
                    held = []
            key, node = key[last:], node[last:]
            if len(key) > size:
                hot, block = int(key[0]), 0
                while len(key) >= size:
                    yield block_row(hot, block, node[:size])
                    key, node, block = key[size:], node[size:], block + 1
        if len(key) and hot is not None:
            yield block_row(hot, block, node)
        elif len(key):
            held += list(whole(key, node))
        if held:
            yield pair_rows(held)

    return tidy(stream)


def _met_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of two blocks of a bucket, or of one block."""
    for batch in batches:
        for x, y in zip(*(c.to_pylist() for c in batch.columns)):
            for pair in _square(np.frombuffer(x, np.int64), None if y is None else np.frombuffer(y, np.int64)):
                yield pa.RecordBatch.from_arrays(_counted([pair]), names=["u", "v", "n"])


def same_picture(a: np.ndarray, b: np.ndarray, *, inliers: int, bin_px: float, far: int) -> bool:
    """Whether ``inliers`` corners of a agree on one scale, turn and shift that takes them to corners of b.

    All corners are compared; two match if they differ in at most ``far`` tests of all tables. Matches vote in two
    overlapping grids and for two turns. Pairs with thousands of matches need more: beyond a thousand, each tenfold
    takes as many corners more.
    """
    at = []
    for lo in range(0, len(a), 512):
        i, j = np.nonzero(np.bitwise_count(a["codes"][lo : lo + 512, None, :] ^ b["codes"][None, :, :]).sum(axis=2, dtype=np.int64) <= far)
        at.append((i + lo, j))
    i, j = (np.concatenate([p[k] for p in at]) for k in (0, 1)) if at else (np.empty(0, int),) * 2
    need = inliers * max(1.0, 1 + np.log10(max(1, len(i)) / 1000))
    if len(np.unique(i)) < need:
        return False
    scales = np.array(_SCALES)
    turn = (b["turn"][j].astype(np.int64) - a["turn"][i]) % _TURNS
    angle = turn * (2 * np.pi / _TURNS)
    ratio = scales[b["scale"][j]] / scales[a["scale"][i]]
    y, x = a["y"][i] / 4.0, a["x"][i] / 4.0
    ty = b["y"][j] / 4.0 - ratio * (x * np.sin(angle) + y * np.cos(angle))
    tx = b["x"][j] / 4.0 - ratio * (x * np.cos(angle) - y * np.sin(angle))
    step = np.rint(np.log2(ratio) * 10).astype(np.int64) + 32
    cells = []
    for g, off in enumerate((0.0, bin_px / 2)):
        cy, cx = (np.clip(np.floor((t + off) / bin_px).astype(np.int64) + (1 << 15), 0, (1 << 16) - 1) for t in (ty, tx))
        for k in (0, 1):
            cells.append((((((step * _TURNS + (turn + k) % _TURNS) * 2 + g) << 16 | cy) << 16 | cx) << 18) | (i & ((1 << 18) - 1)))
    votes = np.unique(np.concatenate(cells)) >> 18
    return bool(np.diff(np.flatnonzero(np.append(np.append(True, votes[1:] != votes[:-1]), True))).max() >= need)


def _agreed(inliers: int, bin_px: float, far: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                same_picture(np.frombuffer(a.as_buffer(), _CORNER), np.frombuffer(b.as_buffer(), _CORNER), inliers=inliers, bin_px=bin_px, far=far)
                for a, b in zip(batch.column(2), batch.column(3))
            ]
            yield batch.select([0, 1]).filter(pa.array(found, pa.bool_()))

    return tidy(rows)


def image_links(described: DataFrame, *, inliers: int = 6, bin_px: float = 8.0, far: int = 12, keys: int = 2, block: int = 4096) -> DataFrame:
    """Distinct (u, v), u > v: pairs of images ``described(node, corners)`` whose corners agree on one similarity transform.

    Images meet in ``_TABLES`` tables under their corners' codes, each joined with two neighbours as the corner sees
    them (:func:`constellations`). Keys that a single image has never move: a map of fixed size, counted over all
    images, tells them apart. All pairs of a bucket count their common keys; buckets of more than ``block`` images are
    dealt out as pairs of blocks. Pairs with ``keys`` common keys are compared corner by corner (:func:`same_picture`).
    """
    spark = described.sparkSession
    found = described.select("corners", "node")
    n = int(found.agg(F.sum(F.octet_length("corners"))).first()[0] or 0) // _CORNER.itemsize
    per_corner = _TABLES * _NEIGHBOURS * (_NEIGHBOURS - 1) // 2
    maps = spark.sparkContext.broadcast(token_maps(found, n * per_corner, _key_sets)[1])
    rows = found.mapInArrow(_key_rows(maps), "key long, node long")
    met = cut(rows.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "node").mapInArrow(_met(block), _MET))
    maps.destroy()  # what needed it is stored
    pairs = met.where("key is null").select("u", "v", "n")
    if not (blocks := met.where("key is not null").select("key", "block", "nodes")).isEmpty():
        a, b = blocks, blocks.withColumnsRenamed({"key": "b_key", "block": "b_block", "nodes": "b_nodes"})
        jobs = a.join(b, F.expr("key = b_key AND block >= b_block")).select("nodes", F.expr("CASE WHEN block > b_block THEN b_nodes END").alias("other"))
        pairs = pairs.unionByName(jobs.repartition(shuffle_partitions(spark)).mapInArrow(_met_blocks, _PAIR))
    pairs = pairs.groupBy("u", "v").agg(F.sum("n").alias("n")).where(F.col("n") >= keys).select("u", "v")
    sides = [found.select(F.col("node").alias(side), F.col("corners").alias(name)) for side, name in (("u", "a"), ("v", "b"))]
    return pairs.join(sides[0], "u").join(sides[1], "v").select("u", "v", "a", "b").mapInArrow(_agreed(inliers, bin_px, far), "u long, v long")


def image_copies(df: DataFrame, *, id_col: str = "image_id", image_col: str = "image", inliers: int = 6) -> DataFrame:
    """One row per input row: id, component_id (the least id of its group of copies) and n_links.

    Equal pixels are one node, whatever their number; ``n_links`` counts the other images a node is linked with.
    Rows without a readable image, or without corners, are their own component with no links; null ids keep
    their row with a null component. Empty tables give no rows; other columns are ignored.
    """
    seen = cut(df.select(F.col(id_col).cast("long").alias("id"), F.col(image_col).alias("image")).mapInArrow(_described, _DESCRIBED).withColumn("row", F.monotonically_increasing_id()))
    sets = seen.select("id", "node", "row")
    heads = cut(sets.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("head"), F.min("row").alias("first")))
    # equal images have equal corners: the rows beyond the first are left out by their numbers, so that no corners move
    again = sets.where("id is not null").join(heads.select("node", "first"), "node").where("row <> first").select("row")
    one = seen.where("node is not null and id is not null").join(again, "row", "left_anti").select("node", "corners")
    links = cut(image_links(one, inliers=inliers))
    names = heads.select(F.col("node").alias("n"), "head")
    edges = links.join(names.withColumnsRenamed({"n": "u", "head": "a"}), "u").join(names.withColumnsRenamed({"n": "v", "head": "b"}), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = connected_components(edges).withColumnRenamed("node", "r_node")
    degree = links.select(F.explode(F.array("u", "v")).alias("d")).groupBy("d").agg(F.count("*").alias("n_links"))
    node = names.join(roots, F.col("head") == F.col("r_node"), "left").join(degree, F.col("n") == F.col("d"), "left").select("n", F.coalesce("root", "head").alias("component"), "n_links")
    out = sets.join(node, F.col("node") == F.col("n"), "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def draw(seed: int, size: int = 96) -> np.ndarray:
    """A picture of patches over a rough ground, for tables that have no images of their own."""
    rng = np.random.default_rng(seed)
    ground = np.zeros((size, size))
    for cells, weight in ((6, 60.0), (12, 45.0), (24, 35.0), (48, 25.0)):
        grid = rng.normal(0, weight, (cells + 1, cells + 1))
        at = np.linspace(0, cells - 1e-9, size)
        i, f = at.astype(int), at - at.astype(int)
        rows = grid[i] * (1 - f)[:, None] + grid[i + 1] * f[:, None]
        ground += rows[:, i] * (1 - f) + rows[:, i + 1] * f
    for _ in range(5):
        y, x = rng.integers(0, size - 12, 2)
        h, w = rng.integers(8, 26, 2)
        ground[y : y + h, x : x + w] = ground[y : y + h, x : x + w] * 0.5 + rng.normal(0, 60)
    return np.clip(np.rint(ground + 128), 0, 255).astype(np.uint8)


def draw_rectangles(seed: int, size: int = 96) -> np.ndarray:
    """A picture of overlapping rectangles: flat, with corners that many unlike pictures share."""
    rng = np.random.default_rng(seed)
    a = np.full((size, size), rng.integers(60, 200), np.uint8)
    for _ in range(26):
        y, x = rng.integers(-8, size - 6, 2)
        h, w = rng.integers(8, 34, 2)
        a[max(0, y) : y + h, max(0, x) : x + w] = rng.integers(0, 256)
    return a


#: Of drawn copies.
EDITS = (1, 2, 3, 4, 5, 6)


def edit(a: np.ndarray, kind: int) -> np.ndarray:
    """0: as it is; 1: cropped; 2: darker and flatter; 3: noisy; 4: a quarter turned; 5: two thirds of the size; 6: a third of the area."""
    if kind == 5:
        return np.rint(_shrunk(a.astype(np.float64), 1.5)).astype(np.uint8)
    if kind == 6:
        return a[18:74, 22:78]
    if kind == 1:
        return a[10:-6, 14:-4]
    if kind == 2:
        return np.rint(a * 0.75 + 20).astype(np.uint8)
    if kind == 3:
        return np.clip(a + np.random.default_rng(5).normal(0, 4, a.shape), 0, 255).astype(np.uint8)
    return np.rot90(a) if kind == 4 else a


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, vectors = batch.column(0).to_pylist(), batch.column(1)
        for lo in range(0, len(ids), 512):
            out = []
            for i in range(lo, min(len(ids), lo + 512)):
                v = np.array(vectors[i].as_py() or [], np.float32)
                seed = int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8).digest(), "little")
                picture = draw_rectangles(seed) if seed % 2 else draw(seed)
                out += [encode_pgm(picture), encode_pgm(np.ascontiguousarray(edit(picture, EDITS[(ids[i] or 0) % len(EDITS)])))]
            names = [None if i is None else 2 * i + k for i in ids[lo : lo + 512] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], names=["image_id", "image"])


def drawn_images(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(image_id, image): for each vector a picture, rough or of rectangles, under twice the id, and under the next number an edited copy of it.

    Equal vectors have equal pictures; the id chooses the edit.
    """
    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(_drawn, "image_id long, image binary")

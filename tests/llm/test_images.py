"""Image copies: planted edits, held against all-pairs matching on a small table."""

from __future__ import annotations

import numpy as np
import pytest

from tidegauge.llm.image_copies import _CORNER, EDITS, constellations, corners, decode_pgm, draw, draw_rectangles, drawn_images, edit, encode_pgm, image_copies, image_links, pack_corners, same_picture


def truth_rows(n: int = 40):
    rows, group = [], {}
    for g in range(n):
        for kind in range(5 if g % 2 else 1):
            i = len(rows) * 2 + 10
            rows.append((i, encode_pgm(np.ascontiguousarray(edit(draw(g), kind))), "x", 1))
            group[i] = g
    return rows, group


def test_planted_copies(spark):
    rows, group = truth_rows()
    hot = [(9000 + i, rows[1][1], "x", 1) for i in range(300)]
    junk = [(None, rows[0][1], "x", 1), (1, None, "x", 1), (2, b"", "x", 1), (3, b"P5 9 9 255\nxx", "x", 1), (4, encode_pgm(np.zeros((96, 96))), "x", 1), (5, encode_pgm(np.zeros((3, 3))), "x", 1)]
    df = spark.createDataFrame(rows + hot + junk, "image_id long, image binary, node string, head int").repartition(5)
    out = image_copies(df).collect()
    assert len(out) == len(rows) + len(hot) + len(junk)
    got = {r.image_id: r for r in out}
    least = {}
    for i, g in group.items():
        least[g] = min(least.get(g, i), i)
    right = sum(got[i].component_id == least[g] for i, g in group.items())
    assert right >= 0.97 * len(group)
    ids = {i: g for i, g in group.items()}
    assert all(ids[got[i].component_id] == g for i, g in group.items())  # nothing wrong is joined
    assert all(got[9000 + i].component_id == got[rows[1][0]].component_id for i in range(300))
    assert all(got[i].component_id == i and got[i].n_links == 0 for i in (1, 2, 3, 4, 5)) and got[None].component_id is None
    assert image_copies(df.limit(0)).count() == 0


def test_links_against_all_pairs(spark):
    """Every pair of images compared corner by corner: the tables lead to nearly all of these links, to no others, and to the same groups."""
    rows, _ = truth_rows(10)
    rows += [(500 + 10 * g + k, encode_pgm(np.ascontiguousarray(edit(draw_rectangles(g), k))), "x", 1) for g in range(6) for k in range(4)]
    found = {i: pack_corners(*corners(decode_pgm(p))) for i, p, *_ in rows}
    links = {(j, i) for i in found for j in found if i < j and (same_picture(found[j], found[i], inliers=6, bin_px=8.0, far=12))}
    component = {i: i for i in found}
    for _ in found:
        for j, i in links:
            component[i] = component[j] = min(component[i], component[j])
    df = spark.createDataFrame([(i, p) for i, p, *_ in rows], "image_id long, image binary")
    got = image_copies(df).collect()
    assert {r.image_id: r.component_id for r in got} == component
    assert all(r.n_links <= sum(r.image_id in link for link in links) for r in got)
    assert sum(r.n_links for r in got) >= 0.97 * 2 * len(links)


def bucket_rows(n_between: int):
    """Two copies and, between them in the order of nodes, images that have keys of theirs with corners in other places."""
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**32, (9, 3), dtype=np.uint32)
    place = np.array([(40 * (k // 3) + rng.integers(0, 9), 40 * (k % 3) + rng.integers(0, 9)) for k in range(9)]) * 2
    rows = []
    for node in range(n_between + 3):
        r = np.zeros(9, _CORNER)
        r["codes"], r["y"], r["x"] = codes, place[:, 0], place[:, 1]
        if node not in (1, n_between + 2):
            own = 3 * (node % 3)  # three corners in their places
            others = np.setdiff1d(np.arange(9), np.arange(own, own + 3))
            r["codes"][others] = rng.integers(0, 2**32, (6, 3), dtype=np.uint32)
            r["y"][others] += 2000
        rows.append((node, r[np.argsort(r["y"], kind="stable")].tobytes()))
    return rows


@pytest.mark.parametrize("options", [{}, {"block": 10}])
def test_copies_with_unlike_images_between_them_in_every_bucket(spark, options):
    df = spark.createDataFrame(bucket_rows(400), "node long, corners binary").repartition(3)
    assert [tuple(x) for x in image_links(df, **options).collect()] == [(402, 1)]


def test_keys_depend_on_the_image_alone(spark):
    """Not on the batch; a quarter turn keeps most of them, another picture has none."""
    c = [pack_corners(*corners(x)) for x in (draw(1), np.rot90(draw(1)), draw_rectangles(4), np.zeros((96, 96)), draw(2))]
    together = constellations(np.concatenate(c), np.array([len(x) for x in c]))
    assert all((constellations(x, np.array([len(x)]))[0] == t).all() for x, t in zip(c, together))
    assert len(np.intersect1d(together[0], together[1])) > 0.5 * len(together[0]) and not len(together[3])
    assert not len(np.intersect1d(together[0], together[4]))


def test_recall_by_edit(spark):
    """Smooth, flat and text-like pictures: all whole copies and mild crops are found, no unlike pictures are joined."""

    def glyphs(seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        a = np.full((112, 112), 240, np.uint8)
        for y in range(4, 104, 11):
            for x in range(4, 104, 8):
                a[y : y + 7, x : x + 5] = np.where(rng.random((7, 5)) < 0.5, 20, 240)
        return a

    kinds = [draw, draw_rectangles, glyphs]
    rows = [(100 * g + k, encode_pgm(np.ascontiguousarray(edit(kinds[g % 3](g), k)))) for g in range(18) for k in (0, *EDITS[:5])]
    got = {r.image_id: r.component_id for r in image_copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert all(got[i] // 100 == i // 100 for i, _ in rows)
    assert sum(got[i] == i // 100 * 100 for i, _ in rows) >= 0.98 * len(rows)


def test_links_of_a_group_of_copies_are_all_pairs(spark):
    noisy = [np.clip(draw(1) + np.random.default_rng(k).normal(0, 2, (96, 96)), 0, 255) for k in range(9)]
    df = spark.createDataFrame([(k, encode_pgm(x)) for k, x in enumerate(noisy)], "image_id long, image binary")
    assert {(r.component_id, r.n_links) for r in image_copies(df).collect()} == {(0, 8)}


@pytest.mark.parametrize("large", [lambda g: draw(g, 480), lambda g: np.block([[draw(100 * g + 5 * r + c) for c in range(5)] for r in range(5)])])
def test_small_crops_of_large_images(spark, large):
    """A tenth and less of a picture's area is still linked to it, be it smooth or rough; unlike pictures aren't."""
    rows = []
    for g in range(6):
        whole = large(g)
        rows += [(10 * g, whole), (10 * g + 1, whole[30:170, 300:440]), (10 * g + 2, whole[300:440, 40:180])]
    df = spark.createDataFrame([(i, encode_pgm(np.ascontiguousarray(a))) for i, a in rows], "image_id long, image binary")
    assert {r.image_id: r.component_id for r in image_copies(df).collect()} == {i: i // 10 * 10 for i, _ in rows}


def test_drawn_images_are_of_both_kinds_and_all_edits(spark):
    """Rough and flat pictures, and copies of another size and of a small part."""
    df = spark.createDataFrame([(i, [float(i)]) for i in range(60)], "vec_id long, embedding array<float>")
    got = {r.image_id: decode_pgm(bytes(r.image)) for r in drawn_images(df).collect()}
    flat = [np.mean(np.diff(got[2 * i].astype(int), axis=1) == 0) > 0.5 for i in range(60)]
    assert 10 < sum(flat) < 50
    assert {got[2 * i + 1].shape for i in range(60)} == {(96, 96), (80, 78), (64, 64), (56, 56)}


@pytest.mark.parametrize("raw", [None, b"", b"P6 1 1 255\nxxx", b"P5 2 2 255\nabc", b"P5 0 0 255\n", b"P5 2 2 65535\nabcd"])
def test_unreadable(raw):
    assert decode_pgm(raw) is None


def test_round_trip():
    a = draw(3)[:50, :70]
    assert (decode_pgm(encode_pgm(a)) == a).all()

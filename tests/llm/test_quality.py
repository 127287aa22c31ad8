"""The ordinal classifier: likelihood, ordering, edge cases and held-out accuracy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tidegauge.llm.quality import OrdinalModel, features, fit_ordinal, fit_quality, grade_documents
from tidegauge.llm.bytetext import text_buffer

import pyarrow as pa


def corpus(n: int, seed: int = 5) -> list[tuple[int, str, int]]:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    rows = []
    for i in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randint(10, 120))]
        grade = rnd.choice([0, 1, 2, 2])
        if grade == 0:
            w = [x.upper() + "!!" for x in w]
        elif grade == 1:
            for _ in range(rnd.randint(1, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(["rotten", "vileness", "vilely"])
        rows.append((i, " ".join(w), grade))
    return rows


def test_held_out_grades(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, grade string").repartition(4)
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows if i < 1000] + [(None, 1), (5000, 9), (3, None)], "doc_id long, grade int")
    model = fit_quality(docs, ratings, levels=3)
    got = {r.doc_id: r for r in grade_documents(docs, model).collect()}
    assert len(got) == 1500
    right = [(got[i].tails[1] >= 0.5) == (g == 2) for i, _, g in rows if i >= 1000]
    assert sum(right) / len(right) > 0.97
    mean = lambda k: np.mean([got[i].expected_grade for i, _, g in rows if i >= 1000 and g == k])
    assert mean(0) < mean(1) < mean(2)
    assert all(r.tails[0] >= r.tails[1] and math.isclose(sum(r.tails), r.expected_grade) for r in got.values())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "fine words"), (4, "fine words"), (4, "fine words"), (5, "x" * 200_000 + " y" * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    one = spark.createDataFrame([(4, 2)], "doc_id long, grade int")
    for ratings in (none, one):
        got = grade_documents(docs, fit_quality(docs, ratings, levels=3)).collect()
        assert len(got) == 7
        assert all(r.expected_grade == 0 for r in got if r.doc_id in (1, 2, 3))
        assert len({r.expected_grade for r in got if r.doc_id in (None, 4)}) == 1
    assert grade_documents(docs.limit(0), fit_quality(docs.limit(0), none, levels=3)).count() == 0


def test_features_do_not_depend_on_batches():
    texts = pa.array([t for _, t, _ in corpus(50)] + ["", None, "É É É x"])
    whole = [f.tolist() for f in features(*text_buffer(texts), 18)]
    alone = [next(iter(features(*text_buffer(texts.slice(i, 1)), 18))).tolist() for i in range(len(texts))]
    assert whole == alone


def test_tails_are_the_cumulative_link():
    m = OrdinalModel(4, np.zeros(16), np.array([-1.0, 2.0]))
    assert np.allclose(m.tails(np.array([0.5]))[0], [1 / (1 + math.exp(-1.5)), 1 / (1 + math.exp(1.5))])


@pytest.mark.parametrize("levels", [2, 5])
def test_fit_follows_a_planted_score(levels):
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 6)).astype(np.int32) for _ in range(3000)]
    true = np.linspace(-3, 3, 30)
    eta = np.array([true[r].sum() for r in rows])
    cuts = np.quantile(eta, np.linspace(0, 1, levels + 1)[1:-1])
    grades = np.searchsorted(cuts, eta + rng.logistic(size=len(eta)) * 0.3)
    m = fit_ordinal(rows, grades, bits=5, levels=levels, screen=1.0)
    assert np.corrcoef(m.weights[:30], true)[0, 1] > 0.95 and (np.diff(m.thresholds) >= 0).all()


def log_likelihood(w: np.ndarray, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    """Mean over rows, plainly from the definition."""
    cdf = np.column_stack([np.zeros(len(y)), 1 / (1 + np.exp(-(theta[None, :] - (x @ w)[:, None]))), np.ones(len(y))])
    return float(np.log(np.maximum(cdf[np.arange(len(y)), y + 1] - cdf[np.arange(len(y)), y], 1e-12)).mean())


def dense_solver(x: np.ndarray, y: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch ascent with numeric slopes of the whole likelihood, until it no longer grows."""
    p = np.concatenate([np.zeros(x.shape[1]), np.log(np.arange(1, levels) / np.arange(levels - 1, 0, -1))])
    value = lambda p: log_likelihood(p[: x.shape[1]], np.sort(p[x.shape[1] :]), x, y)
    step, at = 4.0, value(p)
    for _ in range(400):
        slope = np.array([(value(p + e) - value(p - e)) / 2e-5 for e in np.eye(len(p)) * 1e-5])
        while step > 1e-6 and value(p + step * slope) <= at:
            step /= 2
        if step <= 1e-6:
            break
        p, step = p + step * slope, step * 1.5
        at = value(p)
    return p[: x.shape[1]], np.sort(p[x.shape[1] :])


def test_fit_against_a_dense_solver():
    rng = np.random.default_rng(4)
    x = (rng.random((1200, 8)) < 0.4).astype(float)
    eta = x @ np.linspace(-2, 2, 8)
    y = np.searchsorted([-1.0, 1.0], eta + rng.logistic(size=len(eta)))
    m = fit_ordinal([np.flatnonzero(r).astype(np.int32) for r in x], y, bits=3, levels=3, screen=0.0, l1=0.0, l2=0.0)
    w, theta = dense_solver(x, y, 3)
    best, flat = log_likelihood(w, theta, x, y), log_likelihood(np.zeros(8), m.thresholds, x, y)
    ours = log_likelihood(m.weights.astype(float), m.thresholds, x, y)
    assert flat + 0.2 < ours <= best + 1e-6 and best - ours < 0.02
    assert np.corrcoef(m.weights, w)[0, 1] > 0.99


def test_equal_tables_give_equal_models(spark):
    """Whatever the shuffle width and the order of rows; the least of an id's texts counts."""
    rows = corpus(400)
    ratings = [(i, g) for i, _, g in rows]
    found = []
    for width, seed in ((5, 1), (8, 2), (211, 3)):
        shuffled = [(i, t) for i, t, _ in rows] + [(7, "zzzz last of all"), (8, None)]
        random.Random(seed).shuffle(shuffled)
        spark.conf.set("spark.sql.shuffle.partitions", width)
        m = fit_quality(spark.createDataFrame(shuffled, "doc_id long, text string").repartition(width), spark.createDataFrame(ratings, "doc_id long, grade int").repartition(3), levels=3)
        found.append((m.weights.tobytes(), m.thresholds.tobytes()))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert found[0] == found[1] == found[2] and any(np.frombuffer(found[0][0], np.float32))


def test_op9_columns(spark, tmp_path):
    from tidegauge.llm import queries

    rows = corpus(300)
    spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(g > 0), int(g == 1)) for i, _, g in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op9_quality_classifier(spark, str(tmp_path)).collect()
    assert len(got) == 301 and all(r.p_at_least_1 >= r.p_at_least_2 and r.keep == (r.p_at_least_2 >= 0.5) and math.isclose(r.expected_grade, r.p_at_least_1 + r.p_at_least_2) for r in got)
    grade = {i: g for i, _, g in rows}
    assert sum(r.keep == (grade[r.doc_id] == 2) for r in got if r.doc_id is not None) > 290

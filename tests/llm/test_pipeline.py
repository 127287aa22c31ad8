"""The SQL twins of the training-data queries, and the pipeline's stages against plain Python."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

import corpus_pipeline  # noqa: E402
from oracle_compare import differences  # noqa: E402
from test_documents import hits_brute, jaccard_brute, lines_brute  # noqa: E402
from tidegauge.llm import queries as llm  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differences(llm.queries()[name](spark, SF), SF, llm.oracle_sql()[name]) == ""


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(rows, docs.schema).repartition(3), SF)
        got = [tuple(r) for r in out.collect()]
        before = {r[0]: r for r in rows}
        pairs = [(r[0], r[1]) for r in rows]
        if name == "packing":
            assert {r[0] for r in got} == set(before) and out.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            break
        assert out.columns == columns
        after = {r[0]: r for r in got}
        if name == "quality":
            assert set(after) <= set(before) and all(after[i] == before[i] for i in after)
            labels = {d: (q, t) for d, q, t in duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall()}
            clean = [i for i, (q, t) in labels.items() if q and not t]
            assert sum(i in after for i in clean) >= 0.95 * len(clean)
        elif name == "lines":
            assert {i: r[1] for i, r in after.items()} == {i: text for i, (_, _, text) in lines_brute(pairs, 10).items()}
            assert all(r[4] == len(r[1]) for r in got)
        elif name == "near_duplicates":
            groups, _ = jaccard_brute(pairs)
            assert set(after) == {c for _, c in groups.values()}
        elif name == "benchmark_leaks":
            items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
            assert set(after) == {i for i, (_, hit, _) in hits_brute(pairs, items).items() if not hit}
        rows = got


ODD = "doc_id long, text string, kept string, n_lines int, n_dropped int, leak string, row string, stays boolean, `a.b` string, key long"


def odd_rows() -> list[tuple]:
    """Names of the operators' own columns, ids with two texts, null ids, repeated rows, blank and null texts."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    texts = [(1, text(1)), (1, text(2)), (1, text(1)), (2, text(1) + " more"), (None, text(3)), (None, text(3)), (None, text(2)), (3, None), (3, None), (4, ""), (4, ""), (5, "\n"), (6, text(4) + "\nevery line"), (7, text(3))]
    texts += [(20 + k, f"{text(30 + k)}\nevery line\n  Every LINE\t") for k in range(10)]
    return [(i, t, "k", 1, 2, "l", "r", True, "ab", 9) for i, t in texts]


def test_stages_on_odd_tables(spark):
    df = spark.createDataFrame(odd_rows(), ODD).repartition(4)
    one = lambda out: sorted((r[:2] for r in map(tuple, out.collect())), key=repr)
    passed = lambda out: {tuple(r)[2:] for r in out.collect()} == {odd_rows()[0][2:]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and passed(out), name
        assert stage(spark, df.limit(0), SF).count() == 0
        if name == "lines":
            want = [(i, None if t is None else "\n".join(x for x in t.split("\n") if x.strip().lower() != "every line")) for i, t, *_ in odd_rows()]
            assert one(out) == sorted(want, key=repr)
        elif name == "near_duplicates":
            rows = [r[:2] for r in odd_rows()]
            gone = [rows[2], rows[3], rows[4], rows[5], rows[6]]  # copies of a text that the least id has, or of a row
            want = [*rows]
            for r in gone:
                want.remove(r)
            assert one(out) == sorted(want, key=repr)
        elif name == "benchmark_leaks":
            assert one(out) == sorted((r[:2] for r in odd_rows()), key=repr)
        elif name == "quality":
            assert all(t and t.strip() for _, t in one(out))


def test_run_on_nulls_and_repeats(spark, tmp_path):
    """Repeated rows change nothing in what is packed; null ids are packed once, blank texts go."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    plain, odd = tmp_path / "plain", tmp_path / "odd"
    extra = docs.unionByName(docs).unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    for folder, table in ((plain, docs), (odd, extra)):
        table.write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    pieces = [sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(f)).collect()) for f in (plain, odd)]
    assert len(pieces[0]) > 20 and pieces[0] == pieces[1]

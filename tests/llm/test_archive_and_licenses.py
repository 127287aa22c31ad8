"""The WARC audit and the licence scan against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidegauge.llm.licenses import TEMPLATES, license_matches
from tidegauge.llm.warc import FANOUT, RECORD_END, audit, fixity, layout, merkle_tree, read_warc, records, write_warc

PAGES = "page_id long, url string, html string, key string, part int"


def pages(n: int = 700) -> list[tuple]:
    rnd = random.Random(2)
    out = [(i, f"http://x/{i}", "<p>" + "é" * rnd.randint(0, 40) + "</p>", "k", 1) for i in range(n)]
    out[5] = (5, None, None, "k", 1)
    out[6] = (6, "u", "", "k", 1)
    return out + [(9, "http://x/9", "again", "k", 1), (9, "http://x/9", "again", "k", 1), (None, "n", "z", "k", 1), (4000, "big", "y" * 300_000, "k", 1)]


def test_layout_and_tree(spark):
    df = spark.createDataFrame(pages(), PAGES).repartition(6)
    recs = records(df)
    got = sorted(layout(recs).collect(), key=lambda r: r.nth)
    raw = [r.record.encode() for r in recs.collect()]
    assert [r.nth for r in got] == list(range(len(raw)))
    at = 0
    for r in got:
        assert r.offset == at
        at += r["length"]
    assert at == sum(len(x) + len(RECORD_END) for x in raw)
    assert sorted(r.digest for r in got) == sorted(hashlib.sha256(x).hexdigest() for x in raw)
    level = [hashlib.sha256(f"{r.offset}:{r['length']}:{r.digest}".encode()).hexdigest() for r in got]
    tree = {(r.level, r.node): r.hash for level in merkle_tree(layout(recs)) for r in level.collect()}
    k = 0
    while True:
        assert [tree[k, i] for i in range(len(level))] == level
        if len(level) == 1:
            break
        level = [hashlib.sha256("".join(level[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(level), FANOUT)]
        k += 1
    assert max(x for x, _ in tree) == k


def test_fixity(spark):
    left = pages()
    right = [x for x in left if x[0] != 300]
    right[100] = (*right[100][:2], "CHANGED" + (right[100][2] or ""), *right[100][3:])
    right.append((8000, "new", "n", "k", 1))
    a, b = (layout(records(spark.createDataFrame(x, PAGES))) for x in (left, right))
    assert audit(merkle_tree(a), merkle_tree(a)).count() == 0
    rows = fixity(a, b).collect()
    status = {}
    for r in rows:
        status.setdefault(r.status, []).append(r.key)
    assert status["corrupt"] == [right[100][0]] and status["missing"] == [300] and status["extra"] == [8000]
    assert len(rows) == len(left) + 1
    assert set(status["moved"]) == {x[0] for x in left if x[0] is not None and x[0] > right[100][0] and x[0] != 300}
    same = [(x[0], x[1], x[2] and x[2].replace("é", "è", 1), *x[3:]) if x[0] == 77 else x for x in left]
    rows = fixity(a, layout(records(spark.createDataFrame(same, PAGES)))).where("status <> 'intact'").collect()
    assert [(r.key, r.status) for r in rows] == [(77, "corrupt")]
    assert fixity(layout(records(spark.createDataFrame([], PAGES))), a).where("status <> 'extra'").count() == 0
    assert fixity(a, layout(records(spark.createDataFrame([], PAGES)))).where("status <> 'missing'").count() == 0


def test_warc_files_round_trip(spark, tmp_path):
    recs = records(spark.createDataFrame(pages(60), PAGES).coalesce(2))
    write_warc(recs, str(tmp_path / "w"))
    back = read_warc(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(str(tmp_path / "w"))).collect()
    assert sorted(bytes(r.record) for r in back) == sorted(r.record.encode() for r in recs.collect())
    assert all(r.whole for r in back)
    torn = next((tmp_path / "w").glob("part-*"))
    torn.write_bytes(torn.read_bytes()[:-40])
    for crc in (tmp_path / "w").glob(".*.crc"):
        crc.unlink()
    back = read_warc(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(str(tmp_path / "w"))).collect()
    assert sum(not r.whole for r in back) == 1


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts, threshold):
    grams = lambda w: {(a, b) for a, b in zip(w, w[1:])}
    out = set()
    for i, t in enumerate(texts):
        t = t or ""
        lines = t.split("\n")
        paragraphs, run = [], []
        for x in [*lines, ""]:
            if x.strip(" \t\n\x0b\x0c\r"):
                run.append(x)
            elif run:
                paragraphs.append("\n".join(run))
                run = []
        for kind, parts in (("line", lines), ("paragraph", paragraphs), ("text", [t])):
            for p in parts:
                g = grams(words(p))
                for name, variants in TEMPLATES.items():
                    for v in variants:
                        h = grams(words(v))
                        if g and 2 * len(g & h) / (len(g) + len(h)) >= threshold:
                            out.add((i, name, kind, round(2 * len(g & h) / (len(g) + len(h)), 9)))
    return out


@pytest.mark.parametrize("threshold", [0.9, 0.6])
def test_licenses(spark, threshold):
    rnd = random.Random(4)
    every = [v for x in TEMPLATES.values() for v in x]
    texts = [None, "", "word", "MIT", *every]
    for v in every:
        w = v.split()
        if len(w) > 20:
            for _ in range(4):
                x = list(w)
                for _ in range(rnd.randint(1, 8)):
                    x[rnd.randrange(len(x))] = rnd.choice(["foo", "the", "software"])
                k = rnd.randrange(len(x))
                texts.append("Some head line\n\n" + " ".join(x[:k]).upper() + "\n" + " ".join(x[k:]) + "\n \t\nthe tail line of it")
        texts.append("Prose before it\n" + v + "\nProse after it")
    df = spark.createDataFrame([(i, t, "a", 0) for i, t in enumerate(texts)], "doc_id long, text string, license string, start int").repartition(3)
    got = {(r.doc_id, r.license, r.segment, round(r.dice, 9)) for r in license_matches(df, threshold=threshold).collect()}
    assert got == brute(texts, threshold) and len(got) > 60
    assert license_matches(df.limit(0)).count() == 0
    assert license_matches(df.select(F.lit(None).cast("long").alias("doc_id"), "text")).where("doc_id is null").count() > 0

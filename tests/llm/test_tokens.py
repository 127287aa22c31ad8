"""Packing and token counts against the tokenizer libraries."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidegauge.llm.packing import pack, plan_sequences  # noqa: E402
from tidegauge.llm.token_counts import MergeCounter, count_tokens  # noqa: E402

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  a  b ", "a\n\nb\n", "\n", "\ta\x0bb\x1cc", "<s>x</s> <|endoftext|>y<|startoftext|>", "▁a▁ b", "ÉTÉ'S don't I'LL Σας ΟΔΟΣ", "é é ́x", "日本語 テスト ｆｕｌｌ ﬁ", " x\xa0y　z", "a" * 5000, "<0x41> \x00", "🙂🙂 x", "word " * 3000]


def texts(seed: int = 1) -> list:
    rnd = random.Random(seed)
    out = list(ODD)
    for _ in range(150):
        out.append("".join(rnd.choice(["the ", "on", "ing ", "é", "\n", ". ", "ß", "XY", "12 ", "--", "th", "er ", "日", "'s "]) for _ in range(rnd.randint(1, 2500))))
    return out + [out[-1]] * 3


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts())], "doc_id long, text string, length int").repartition(5)


def test_pack(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts())}
    got = pack(docs, WORDS, capacity=512, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
    for i, ids in want.items():
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 512)))
        assert np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist() == ids
        assert [r.start for r in own] == [512 * k for k in range(len(own))]
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r["length"]
        assert at <= 512
    total = sum(map(len, want.values()))
    assert len(sequences) <= -(-total // 512) * 1.05 + 1
    assert pack(docs.limit(0), WORDS).count() == 0


@settings(deadline=None, max_examples=150)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60)))
def test_plan_places_every_piece_once(histogram):
    table, n = plan_sequences(histogram, 40)
    fill, ranks = defaultdict(list), defaultdict(list)
    for length, rank, seq, offset, copies in table.tolist():
        nxt = min((r[1] for r in table.tolist() if r[0] == length and r[1] > rank), default=histogram[length])
        for r in range(rank, nxt):
            ranks[length].append(r)
            d = r - rank
            fill[seq + d // copies].append((offset + d % copies * length, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in histogram.items()}
    assert set(fill) == set(range(n))
    for s in fill.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 40
        assert sum(3 * length > 40 for _, length in s) <= 2
    assert n <= 1.23 * -(-sum(k * v for k, v in histogram.items()) // 40) + 41 or sum(v for k, v in histogram.items() if 2 * k > 40) >= n - 41


def test_count_tokens(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(docs, PIECES).collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in enumerate(texts())}
    assert count_tokens(docs.limit(0), PIECES).count() == 0


COUNTER = {}


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁theraoinéß日<0x>"), st.characters(codec="utf-8")), max_size=60))
def test_merge_counter_is_the_library(text):
    import sentencepiece

    if "m" not in COUNTER:
        COUNTER["m"] = MergeCounter(open(PIECES, "rb").read())
        COUNTER["l"] = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    # the library reads texts as C strings of known length; NUL is a symbol like others
    assert COUNTER["m"].count(text) == len(COUNTER["l"].encode(text))


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n.,'<|>theraoinTHEéßÉİΣ日12\x1c\xa0́"), st.characters(codec="utf-8")), max_size=60))
def test_word_encoder_is_the_library(text):
    from tokenizers import Tokenizer

    from tidegauge.llm.packing import WordEncoder

    if "w" not in COUNTER:
        COUNTER["w"] = WordEncoder(open(WORDS, encoding="utf-8").read())
        COUNTER["t"] = Tokenizer.from_file(WORDS)
    assert np.frombuffer(COUNTER["w"].encode([text.encode()])[0], "<u4").tolist() == COUNTER["t"].encode(text, add_special_tokens=False).ids

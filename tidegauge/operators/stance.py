"""Stance models behind one interface, scored in Arrow batches, and ensembles of two."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class StanceModel(Protocol):
    """Scores texts about a target as (stance in [-1, 1], confidence in [0, 1]); versions are never mixed."""

    version: str

    def score(self, texts: list[str], target: str) -> list[tuple[float, float]]: ...


class LexiconModel:
    """A small lexicon with negation: the sum of word valences, squashed; its confidence is its strength."""

    version = "tide-lexicon-1"
    #: Fixed values of this lexicon.
    VALENCE = {
        "yes": 1.0, "win": 1.5, "wins": 1.5, "winning": 1.5, "likely": 1.0, "certain": 1.5, "sure": 1.0, "good": 1.0, "great": 1.5, "strong": 1.0,
        "up": 0.5, "rise": 1.0, "support": 1.0, "confident": 1.5, "bullish": 2.0, "no": -1.0, "lose": -1.5, "loses": -1.5, "losing": -1.5, "unlikely": -1.5,
        "doubt": -1.0, "bad": -1.0, "terrible": -1.5, "weak": -1.0, "down": -0.5, "fall": -1.0, "against": -1.0, "fail": -1.5, "fails": -1.5, "bearish": -2.0,
    }
    NEGATIONS = frozenset(("not", "never", "isn't", "won't", "don't", "doesn't", "can't", "cannot"))

    def score(self, texts: list[str], target: str) -> list[tuple[float, float]]:
        out = []
        for text in texts:
            words, total = re.findall(r"[a-z']+", (text or "").lower()), 0.0
            for i, w in enumerate(words):
                v = self.VALENCE.get(w, 0.0)
                total += -0.75 * v if v and self.NEGATIONS & set(words[max(0, i - 3) : i]) else v
            s = total / math.sqrt(total * total + 15.0)
            out.append((s, abs(s)))
        return out


class EntailmentModel:
    """Stance of a natural-language-inference classifier: P(entailment) - P(contradiction), confidence 1 - P(neutral).

    ``classify`` takes (premise, hypothesis) pairs and gives label probabilities; it is made once a worker by ``load``.
    """

    LABELS = {"entail": r"entail", "contra": r"contra", "neutral": r"neutral"}

    def __init__(self, version: str, load: Callable[[], Callable[[list[tuple[str, str]]], list[dict[str, float]]]], batch: int = 16):
        self.version, self.load, self.batch, self._classify = version, load, batch, None

    def score(self, texts: list[str], target: str) -> list[tuple[float, float]]:
        if not target.strip():
            raise ValueError("an entailment model needs a target")
        self._classify = self._classify or self.load()
        out = []
        for lo in range(0, len(texts), self.batch):
            for probs in self._classify([(t or "", target) for t in texts[lo : lo + self.batch]]):
                p = {k: next((v for name, v in probs.items() if re.search(rx, name, re.I)), 0.0) for k, rx in self.LABELS.items()}
                out.append((p["entail"] - p["contra"], 1.0 - p["neutral"]))
        return out


MODELS: dict[str, Callable[[], StanceModel]] = {"lexicon": LexiconModel}


def build_model(name: str) -> StanceModel:
    if name not in MODELS:
        raise ValueError(f"unknown stance model {name!r}; there are {sorted(MODELS)}")
    return MODELS[name]()


def score_posts(posts: DataFrame, model: StanceModel, target: str, *, text: str = "text") -> DataFrame:
    """(post_id, market_id, created_at, model_version, stance, confidence) of every post, in Arrow batches."""

    @F.pandas_udf(T.StructType([T.StructField("stance", T.DoubleType()), T.StructField("confidence", T.DoubleType())]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(model.score(texts.tolist(), target), columns=["stance", "confidence"])

    return posts.withColumn("_s", run(text)).select("post_id", "market_id", "created_at", F.lit(model.version).alias("model_version"), "_s.stance", "_s.confidence")


def ensemble(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first model's scores with the distance of the second's as disagreement, under both versions' names."""
    other = second.select("post_id", "market_id", "created_at", F.col("stance").alias("_other"), F.col("model_version").alias("_version"))
    both = first.join(other, ["post_id", "market_id", "created_at"])
    return both.select("post_id", "market_id", "created_at", F.concat_ws("+", "model_version", "_version").alias("model_version"), "stance", "confidence", F.abs(F.col("stance") - F.col("_other")).alias("disagreement"))


def contested(stances: DataFrame, limit: float = 0.5) -> Column:
    return F.col("disagreement") > limit

"""Detectors and other models behind small protocols, with implementations that need no network.

A ``Scorer`` turns texts into the probability of class 1, a ``TextGenerator`` prompts into texts, an ``Embedder`` texts
into vectors and a ``Featurizer`` texts into ids. Plug-ins run in batches within Python workers.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attribution as A


class Scorer(Protocol):
    def predict(self, texts: list[str]) -> np.ndarray: ...


class Associative(Scorer, Protocol):
    """A scorer whose score of texts joined by blanks follows from the texts' parts, merged in order."""

    def parts(self, texts: list[str]) -> np.ndarray: ...

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray: ...

    def finish(self, parts: np.ndarray) -> np.ndarray: ...


def is_associative(scorer) -> bool:
    return all(hasattr(scorer, name) for name in ("parts", "merge", "finish"))


class TextGenerator(Protocol):
    def chat(self, prompt: str) -> str | None: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Featurizer(Protocol):
    def encode(self, texts: list[str], max_len: int) -> np.ndarray: ...


class LexiconScorer:
    """The linear surrogate: a token of n characters weighs (n mod 5 - 2) / 10, mask tokens weigh nothing."""

    def weight(self, token: str) -> float:
        return 0.0 if token == "<mask>" else (len(token) % 5 - 2) / 10

    def logit(self, texts: list[str]) -> np.ndarray:
        return np.array([sum(self.weight(t) for t in text.split()) for text in texts])

    def on_masks(self, words: list[str], masks: np.ndarray) -> np.ndarray:
        """Logits of the words under each mask, without making the masked texts."""
        weight = np.array([self.weight(w) for w in words])
        return A.by_rows(lambda part: part @ weight, masks)

    def probabilities_on_masks(self, words: list[str], masks: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.on_masks(words, masks)))

    def predict(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(texts)))

    def parts(self, texts: list[str]) -> np.ndarray:
        return self.logit(texts)[:, None]

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b

    def finish(self, parts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-parts[:, 0]))


class ActScorer(LexiconScorer):
    """The linear surrogate over the values of acts, whose names (four parts) are joined by ``;``."""

    def logit(self, texts: list[str]) -> np.ndarray:
        return np.array([sum(self.weight(a.rsplit("|", 1)[-1]) for a in text.split(";") if "|" in a) for text in texts])


class DialogueScorer(LexiconScorer):
    """The linear surrogate over tokens and the values of acts (words with three bars or more)."""

    def logit(self, texts: list[str]) -> np.ndarray:
        return np.array([sum(self.weight(w.rsplit("|", 1)[-1] if w.count("|") >= 3 else w) for w in text.split()) for text in texts])


class LogitScorer(LexiconScorer):
    """The linear surrogate before its sigmoid: attributions of it are the weights."""

    def predict(self, texts: list[str]) -> np.ndarray:
        return self.logit(texts)


class ScriptedGenerator:
    """Answers in turn, whatever the prompt; null when they are used up."""

    def __init__(self, answers: list[str | None]):
        self.answers, self.used = answers, 0

    def chat(self, prompt: str) -> str | None:
        self.used += 1
        return self.answers[self.used - 1] if self.used <= len(self.answers) else None


class LengthGenerator:
    """A stand-in for a model that extracts acts: one act, whose value is the length of its prompt."""

    def chat(self, prompt: str) -> str | None:
        return f'<DA>[["inform", "general", "name", "{len(prompt)}"]]</DA>'


def score_prob(df: DataFrame, scorer: Scorer, text: str = "text", out: str = "prob") -> DataFrame:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer.predict(texts.fillna("").tolist()))

    return df.withColumn(out, run(F.col(text)))


def softmax(logits: Column) -> Column:
    most = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - most))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def argmax(values: Column) -> Column:
    """Place of the highest value, the lower place at a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def predict_rows(df: DataFrame, logits: str = "pred_logit") -> DataFrame:
    return df.withColumn("pred_prob", softmax(F.col(logits))).withColumn("pred_label", argmax(F.col(logits)))


def fuse(a: Column, b: Column, how: str) -> Column:
    """Late fusion of two feature vectors. Elementwise fusion needs equal lengths."""
    if how == "concat":
        return F.concat(a, b)
    merge = (lambda x, y: F.greatest(x, y)) if how == "max" else (lambda x, y: (x + y) / 2)
    if how not in ("max", "average"):
        raise ValueError(f"unknown fusion {how!r}")
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, merge)).otherwise(F.raise_error(F.lit("fusion of vectors of unequal length")).cast("array<double>"))


def turn_pipeline(text: str = "input_sequence", features: int = 1 << 14, label: str = "label") -> Pipeline:
    """A turn-level detector: hashed words and word pairs into a logistic regression."""
    words = RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\s+", toLowercase=True)
    pairs = NGram(inputCol="_w", outputCol="_p", n=2)
    return Pipeline(stages=[words, pairs, HashingTF(inputCol="_w", outputCol="_hw", numFeatures=features), HashingTF(inputCol="_p", outputCol="_hp", numFeatures=features), VectorAssembler(inputCols=["_hw", "_hp"], outputCol="features"), LogisticRegression(featuresCol="features", labelCol=label, maxIter=30, regParam=1e-3)])


def train_detector(df: DataFrame, text: str, label: str = "label") -> PipelineModel:
    return turn_pipeline(text, label=label).fit(df)


def dialogue_pipeline(da: str, utt: str, features: int = 1 << 13, label: str = "label") -> Pipeline:
    """A dialogue-level detector that fuses acts and utterances by concatenating their features."""
    stages = []
    for c in (da, utt):
        stages += [RegexTokenizer(inputCol=c, outputCol=f"_{c}_w", pattern=r"\s+"), HashingTF(inputCol=f"_{c}_w", outputCol=f"_{c}_h", numFeatures=features)]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[f"_{da}_h", f"_{utt}_h"], outputCol="features"), LogisticRegression(featuresCol="features", labelCol=label, maxIter=30, regParam=1e-3)])


def dialogue_variants(rows: DataFrame, train: DataFrame, features: int = 1 << 13) -> dict[str, DataFrame]:
    """Detectors of dialogues (da, utt, both: texts; label, split) that see one sequence, fitted on ``train`` and applied to
    ``rows``: acts alone, utterances alone, and both in one. ``fusion`` has those with two towers."""
    return {name: turn_pipeline(name, features).fit(train).transform(rows) for name in ("da", "utt", "both")}


def repeat_until(operation: Callable, accept: Callable, most: int, default=None, latest: bool = False):
    """The first accepted result; after ``most`` tries the latest or the default."""
    result = None
    for _ in range(most):
        result = operation()
        if accept(result):
            return result
    return result if latest else default

"""Trained detectors of dialogues from two modalities: two hashed encoders and a joint head, or one encoder for both.

A tower turns the ids of a text's words into the mean of their vectors, through tanh. The two towers' features are fused by
concatenation, by the larger or by the mean, and a linear head gives the logit. With ``shared`` both towers are one table of
vectors, whose gradient is the sum of both sides'.

Training is full-batch gradient descent (Adam). Each step is one pass over the rows for all models that train together: a
task sums the gradients of its rows by parameter row and emits only rows that it touched; Spark sums them by parameter row, with
partial sums before the shuffle; the driver gets one row for each parameter row, a number that the settings bound, and never a
row of data. The same pass takes the loss of the validation rows, which decides when to stop and which step's parameters stay.

Defined cases: null and empty texts have no words, and their features are zeros; rows without a label train nothing; without
validation rows the training loss decides; without training rows the parameters stay as they were drawn; ties of the larger
feature go to the first tower; repeated rows count repeatedly; extra columns are carried by ``predict`` and ignored by ``train``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FUSIONS, SEED
from ..sources.conversations import tokens

#: Kinds of parameter rows: vectors of the first and the second tower, rows of the head, its bias; and the sums of losses.
FIRST, SECOND, HEAD, BIAS, LOSSES = range(5)


@dataclass(frozen=True)
class Settings:
    fusion: str = "average"
    shared: bool = False
    buckets: int = 1 << 12
    dims: int = 16
    seed: int = SEED

    def __post_init__(self):
        if self.fusion not in FUSIONS:
            raise ValueError(f"unknown fusion {self.fusion!r}")
        if self.dims < 4:
            raise ValueError("four dimensions at least")


@dataclass
class TwoTowers:
    """``vectors`` (towers, buckets, dims), ``head`` (1 or 2, dims) and ``bias``."""

    settings: Settings
    vectors: np.ndarray
    head: np.ndarray
    bias: float = 0.0

    @classmethod
    def drawn(cls, settings: Settings) -> "TwoTowers":
        r = np.random.default_rng(settings.seed)
        towers, rows = 1 if settings.shared else 2, 2 if settings.fusion == "concat" else 1
        vectors = r.normal(0, 0.3, (1, settings.buckets, settings.dims)).repeat(towers, axis=0)  # both towers start alike
        return cls(settings, vectors, r.normal(0, 0.3, (rows, settings.dims)))

    def table(self, kind: int) -> np.ndarray:
        return self.vectors[0 if self.settings.shared else kind]

    def features(self, kind: int, ids: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of the texts, all ids in one array, and how many each text has."""
        size = np.array([0 if x is None else len(x) for x in ids], np.int64)
        flat = np.concatenate([np.asarray(x, np.int64) for x in ids if x is not None and len(x)] or [np.empty(0, np.int64)])
        up = np.vstack([np.zeros((1, self.settings.dims)), np.cumsum(self.table(kind)[flat], axis=0)])
        ends = np.cumsum(size)
        return np.tanh((up[ends] - up[ends - size]) / np.maximum(size, 1)[:, None]), flat, size

    def fused(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.settings.fusion == "concat":
            return np.hstack([a, b])
        return np.maximum(a, b) if self.settings.fusion == "max" else (a + b) / 2

    def logits(self, first: list, second: list) -> np.ndarray:
        return self.fused(self.features(FIRST, first)[0], self.features(SECOND, second)[0]) @ self.head.reshape(-1) + self.bias

    def gradient(self, first: list, second: list, y: np.ndarray) -> tuple[dict[int, np.ndarray], float]:
        """Sums over the rows of the gradients of the cross entropy, by kind, and of the cross entropy itself."""
        (a, ids_a, n_a), (b, ids_b, n_b) = self.features(FIRST, first), self.features(SECOND, second)
        fused, weight = self.fused(a, b), self.head.reshape(-1)
        z = fused @ weight + self.bias
        off = 1 / (1 + np.exp(-z)) - y
        back = off[:, None] * weight
        if self.settings.fusion == "concat":
            back_a, back_b = back[:, : a.shape[1]], back[:, a.shape[1] :]
        elif self.settings.fusion == "max":
            back_a, back_b = back * (a >= b), back * (a < b)
        else:
            back_a = back_b = back / 2
        out = {HEAD: (off @ fused).reshape(self.head.shape), BIAS: np.array([[off.sum()]])}
        for kind, back_x, x, ids, n in ((FIRST, back_a, a, ids_a, n_a), (SECOND, back_b, b, ids_b, n_b)):
            per_word = back_x * (1 - x * x) / np.maximum(n, 1)[:, None]
            own = out.setdefault(FIRST if self.settings.shared else kind, np.zeros(self.vectors.shape[1:]))
            np.add.at(own, ids, per_word.repeat(n, axis=0))
        return out, float(np.logaddexp(0, np.where(y > 0, -z, z)).sum())

    def rows(self) -> list[tuple[int, int, list[float]]]:
        """The parameters as rows (kind, row, values)."""
        parts = [(k, x) for k, x in enumerate(self.vectors)] + [(HEAD, self.head), (BIAS, np.array([[self.bias]]))]
        return [(k, i, v.tolist()) for k, x in parts for i, v in enumerate(x)]


def hashed(text: Column, buckets: int) -> Column:
    """The buckets of a text's words."""
    return F.transform(F.coalesce(tokens(text), F.array().cast("array<string>")), lambda t: F.pmod(F.xxhash64(F.lower(t)), F.lit(buckets)).cast("int"))


def summed_gradients(rows: DataFrame, models: dict[str, TwoTowers]) -> pd.DataFrame:
    """One pass: model, kind, row and g (sums over the training rows), and per model a row of sums of LOSSES: training loss and
    rows, validation loss and rows. ``rows``: first and second (ids of both modalities), label, split."""
    dims = max(m.settings.dims for m in models.values())
    sent = rows.sparkSession.sparkContext.broadcast(models)  # as large as the settings say

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, dict[int, np.ndarray]] = {}
        for pdf in batches:
            y, train = pdf["label"].to_numpy(float), (pdf["split"] == "train").to_numpy()
            for name, model in sent.value.items():
                own = sums.setdefault(name, {LOSSES: np.zeros((1, 4))})
                for part, at in ((train, 0), (~train, 2)):
                    if part.any():
                        one, two = pdf["first"][part].tolist(), pdf["second"][part].tolist()
                        found, loss = model.gradient(one, two, y[part])
                        own[LOSSES][0, at : at + 2] += loss, part.sum()
                        for kind, g in found.items() if at == 0 else ():
                            own[kind] = own[kind] + g if kind in own else g
        out = [(name, kind, int(i), [*g[i].tolist(), *[0.0] * (dims - g.shape[1])]) for name, own in sums.items() for kind, g in own.items() for i in np.flatnonzero(np.any(g != 0, axis=1))]
        yield pd.DataFrame(out, columns=["model", "kind", "row", "g"])

    parts = rows.select("first", "second", "label", "split").mapInPandas(run, "model string, kind int, row int, g array<double>")
    found = parts.groupBy("model", "kind", "row").agg(F.array(*[F.sum(F.get("g", F.lit(i))) for i in range(dims)]).alias("g")).toPandas()
    sent.destroy()
    return found


def train(rows: DataFrame, variants: dict[str, Settings], first: str = "da", second: str = "utt", label: str = "label", split: str = "split", steps: int = 40, rate: float = 0.1, patience: int = 5, words: Callable[[Column, int], Column] | None = None) -> dict[str, TwoTowers]:
    """Models of all variants, trained together on rows whose split is train and stopped on those whose split is val. ``words``
    gives a text's ids below the number of buckets, if not those of ``hashed``."""
    words = words or hashed
    buckets = {s.buckets for s in variants.values()}
    if len(buckets) > 1:
        raise ValueError("variants that train together have as many buckets")
    size = buckets.pop()
    used = rows.where(F.col(label).isNotNull() & F.col(split).isin("train", "val"))
    used = used.select(words(F.col(first), size).alias("first"), words(F.col(second), size).alias("second"), F.col(label).cast("double").alias("label"), F.col(split).alias("split")).persist()
    models = {n: TwoTowers.drawn(s) for n, s in variants.items()}
    best, moments = {n: (np.inf, 0, m) for n, m in models.items()}, {}
    for step in range(1, steps + 2):
        going = {n: m for n, m in models.items() if step - best[n][1] <= patience + 1 or best[n][1] == 0}
        if not going:
            break
        found = summed_gradients(used, going)
        for name, model in going.items():
            own = found[found["model"] == name]
            losses = own[own["kind"] == LOSSES]["g"].tolist()
            train_loss, n, val_loss, n_val = losses[0][:4] if losses else (0.0, 0, 0.0, 0)
            if not n:
                best[name] = (best[name][0], -steps, model)  # nothing to learn from
                continue
            loss = val_loss / n_val if n_val else train_loss / n
            if loss < best[name][0] - 1e-6:
                best[name] = (loss, step, model)
            if step <= steps:
                models[name] = _stepped(model, own, n, moments.setdefault(name, {}), step, rate)
    used.unpersist()
    return {n: m for n, (_, _, m) in best.items()}


def _stepped(model: TwoTowers, found: pd.DataFrame, n: float, moments: dict, step: int, rate: float) -> TwoTowers:
    """The model after one step of Adam on the mean gradient."""

    def moved(kind: int, x: np.ndarray) -> np.ndarray:
        own, g = found[found["kind"] == kind], np.zeros(x.shape)
        if len(own):
            g[own["row"].to_numpy()] = np.stack(own["g"].to_numpy())[:, : x.shape[1]] / n
        m, v = moments.get(kind, (np.zeros(x.shape), np.zeros(x.shape)))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        moments[kind] = (m, v)
        return x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    return replace(model, vectors=np.stack([moved(k, x) for k, x in enumerate(model.vectors)]), head=moved(HEAD, model.head), bias=float(moved(BIAS, np.array([[model.bias]]))[0, 0]))


def predict(rows: DataFrame, model: TwoTowers, first: str = "da", second: str = "utt", words: Callable[[Column, int], Column] | None = None) -> DataFrame:
    """The rows with prob (of class 1) and prediction."""
    words, size, sent = words or hashed, model.settings.buckets, rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-sent.value.logits(one.tolist(), two.tolist()))))

    return rows.withColumn("prob", run(words(F.col(first), size), words(F.col(second), size))).withColumn("prediction", (F.col("prob") >= 0.5).cast("double"))


def save(spark: SparkSession, model: TwoTowers, path: str) -> None:
    """The parameters as a table of rows, with the settings beside them."""
    spark.createDataFrame(model.rows(), "kind int, row int, v array<double>").write.mode("overwrite").parquet(f"{path}/parameters")
    spark.createDataFrame([tuple(asdict(model.settings).values())], "fusion string, shared boolean, buckets int, dims int, seed int").write.mode("overwrite").parquet(f"{path}/settings")


def load(spark: SparkSession, path: str) -> TwoTowers:
    settings = Settings(**spark.read.parquet(f"{path}/settings").first().asDict())
    rows = spark.read.parquet(f"{path}/parameters").orderBy("kind", "row").toPandas()
    of = lambda kind: np.stack(rows[rows["kind"] == kind]["v"].to_numpy())
    vectors = np.stack([of(k) for k in ((FIRST,) if settings.shared else (FIRST, SECOND))])
    return TwoTowers(settings, vectors, of(HEAD), float(of(BIAS)[0, 0]))

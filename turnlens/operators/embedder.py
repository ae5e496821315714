"""A trained embedder for matching: texts and descriptions of acts that belong together come to lie near each other.

A text is the mean of the vectors of its hashed words and character n-grams, scaled to length 1. Training is contrastive: pairs
(text, description) meet in groups by a digest; within a group each text should be nearest to its own description and each
description to its own text (cross entropy over cosines, sharpened by a temperature), the others being its negatives. Equal
descriptions in a group are no negatives of each other. A step is one pass: tasks sum the gradients of their groups by
parameter row, Spark sums those, and the driver gets one row for each parameter row, which ``buckets`` bounds.

Defined cases: null and empty texts have no grams and the zero vector, and pairs with such a side train nothing; a group of one
pair has no negatives; without pairs the parameters stay as they were drawn; repeated pairs count repeatedly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SEED
from .collate import digest


@dataclass(frozen=True)
class Embedder:
    vectors: np.ndarray
    gram: int = 3
    temperature: float = 0.1

    @classmethod
    def drawn(cls, buckets: int = 1 << 12, dims: int = 32, gram: int = 3, temperature: float = 0.1, seed: int = SEED) -> "Embedder":
        return cls(np.random.default_rng(seed).normal(0, 1 / np.sqrt(dims), (buckets, dims)), gram, temperature)

    def embed(self, ids: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of texts given as ids, the means' lengths, all ids in one array, and how many each text has."""
        size = np.array([0 if x is None else len(x) for x in ids], np.int64)
        flat = np.concatenate([np.asarray(x, np.int64) for x in ids if x is not None and len(x)] or [np.empty(0, np.int64)])
        up, ends = np.vstack([np.zeros((1, self.vectors.shape[1])), np.cumsum(self.vectors[flat], axis=0)]), np.cumsum(size)
        mean = (up[ends] - up[ends - size]) / np.maximum(size, 1)[:, None]
        length = np.maximum(np.linalg.norm(mean, axis=1), 1e-12)
        return mean / length[:, None], length, flat, size

    def gradient(self, texts: list, others: list) -> tuple[np.ndarray, float, int]:
        """Of one group of pairs: the gradient of the summed loss, the loss and the number of pairs."""
        (a, la, ia, na), (b, lb, ib, nb) = self.embed(texts), self.embed(others)
        s = a @ b.T / self.temperature
        same = np.array([[x is y or list(x) == list(y) for y in others] for x in others]) & ~np.eye(len(a), dtype=bool)
        s = np.where(same, -np.inf, s)
        off, loss = np.zeros(s.shape), 0.0
        for axis in (1, 0):
            top = s.max(axis=axis, keepdims=True)
            e = np.exp(s - top)
            total = e.sum(axis=axis, keepdims=True)
            loss += float((np.log(total).sum() + top.sum() - np.trace(s)) / 2)
            off += (e / total - np.eye(len(a))) / 2
        out = np.zeros(self.vectors.shape)
        for x, y, length, ids, n, g in ((a, b, la, ia, na, off), (b, a, lb, ib, nb, off.T)):
            back = g @ y / self.temperature
            back = (back - (back * x).sum(axis=1, keepdims=True) * x) / length[:, None] / np.maximum(n, 1)[:, None]
            np.add.at(out, ids, back.repeat(n, axis=0))
        return out, loss, len(a)


def grams(text: Column, buckets: int, gram: int) -> Column:
    """Buckets of a text's words, and of the character n-grams of each word between blanks."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda t: t != "")
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) + 3 - gram, F.lit(1))), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(gram)))
    every = F.concat(words, F.flatten(F.transform(words, cut)))
    return F.transform(every, lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int"))


def gathered(pairs: DataFrame) -> DataFrame:
    """Rows (group, one, two) with each group as one row, so that passes over them need no shuffle."""
    return pairs.groupBy("group").agg(F.collect_list(F.struct("one", "two")).alias("pairs"))


def summed(pairs: DataFrame, model: Embedder) -> tuple[np.ndarray, float, int]:
    """One pass over rows (group, one, two) or ``gathered`` ones: the mean gradient, the mean loss and the number of pairs. A task
    adds up its groups and emits a row for each parameter row that they touched."""
    dims, sent = model.vectors.shape[1], pairs.sparkSession.sparkContext.broadcast(model)
    groups = pairs if "pairs" in pairs.columns else gathered(pairs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, head = np.zeros(sent.value.vectors.shape), [0.0, 0.0]
        for pdf in batches:
            for some in pdf["pairs"]:
                g, loss, n = sent.value.gradient([p["one"] for p in some], [p["two"] for p in some])
                total, head = total + g, [head[0] + loss, head[1] + n]
        if head[1]:
            out = [(int(i), total[i].tolist()) for i in np.flatnonzero(np.any(total != 0, axis=1))]
            yield pd.DataFrame([*out, (-1, [*head, *[0.0] * (dims - 2)])], columns=["row", "g"])

    each = groups.select("pairs").mapInPandas(run, "row int, g array<double>")
    found = each.groupBy("row").agg(F.array(*[F.sum(F.get("g", F.lit(i))) for i in range(dims)]).alias("g")).toPandas()
    sent.destroy()
    out, head = np.zeros(model.vectors.shape), found[found["row"] < 0]["g"].tolist()
    own = found[found["row"] >= 0]
    if not head:
        return out, 0.0, 0
    if len(own):
        out[own["row"].to_numpy()] = np.stack(own["g"].to_numpy())
    return out / head[0][1], head[0][0] / head[0][1], int(head[0][1])


def train(pairs: DataFrame, first: str = "utt", second: str = "acts", keys: list[str] | None = None, group: int = 32, steps: int = 20, rate: float = 0.02, seed: int = SEED, model: Embedder | None = None) -> tuple[Embedder, list[float]]:
    """The embedder and the loss before each step, from rows of texts that belong together."""
    model = Embedder.drawn(seed=seed) if model is None else model
    buckets = len(model.vectors)
    rows = pairs.select(grams(F.col(first), buckets, model.gram).alias("one"), grams(F.col(second), buckets, model.gram).alias("two"), digest(keys or [first, second], seed).alias("_h")).where((F.size("one") > 0) & (F.size("two") > 0)).persist()
    many = max(1, rows.count() // group)
    grouped = gathered(rows.withColumn("group", F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % many)).persist()
    m, v, losses = np.zeros(model.vectors.shape), np.zeros(model.vectors.shape), []
    for step in range(1, steps + 1):
        g, loss, n = summed(grouped, model)
        if not n:
            break
        losses.append(loss)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        model = replace(model, vectors=model.vectors - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    grouped.unpersist()
    rows.unpersist()
    return model, losses


def embedded(df: DataFrame, model: Embedder, text: str, out: str = "vec") -> DataFrame:
    """The rows with the text's vector, which ``matching.match_corpus`` compares."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = sent.value.embed(batch.column("_ids").to_pylist())[0]
            found = pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, vectors.shape[1]), pa.int32()), pa.array(vectors.reshape(-1)))
            kept = [n for n in batch.schema.names if n != "_ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), found], [*kept, out])

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.withColumn("_ids", grams(F.col(text), len(model.vectors), model.gram)).mapInArrow(run, schema)

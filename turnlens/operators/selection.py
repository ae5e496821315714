"""Choosing the features that matter. Explanations are arrays of (idx, text, score); ties go to the smaller index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let


def _sorted(explanation: Column, rank) -> Column:
    """By ``rank`` downwards, then by index."""
    keyed = F.transform(explanation, lambda e: F.struct((-rank(e)).alias("r"), e["idx"].alias("idx"), e["text"].alias("text"), e["score"].alias("score")))
    return F.transform(F.array_sort(keyed), lambda k: F.struct(k["idx"].alias("idx"), k["text"].alias("text"), k["score"].alias("score")))


def expl_sort(explanation: Column) -> Column:
    return _sorted(explanation, lambda e: F.abs(e["score"]))


def topk_absolute(explanation: Column, k: int) -> Column:
    return F.slice(expl_sort(explanation), 1, k)


def topk_prediction(explanation: Column, pred: Column, k: int) -> Column:
    """Toward the predicted class: highest scores for 1, lowest for 0; without a prediction the first as they stand."""
    up, down = _sorted(explanation, lambda e: e["score"]), _sorted(explanation, lambda e: -e["score"])
    return F.slice(F.when(pred == 1, up).when(pred == 0, down).otherwise(explanation), 1, k)


def sample_k_features(explanation: Column, k: int, keys: list[Column], seed: int) -> Column:
    """k features in the order of a digest of seed, keys and index."""
    keyed = F.transform(explanation, lambda e: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in keys], e["idx"].cast("string"))).alias("r"), e["idx"].alias("idx"), e["text"].alias("text"), e["score"].alias("score")))
    return F.slice(F.transform(F.array_sort(keyed), lambda x: F.struct(x["idx"].alias("idx"), x["text"].alias("text"), x["score"].alias("score"))), 1, k)


def bias_filter(explanation: Column) -> Column:
    """Without the intercept, which has no place among the features; a feature whose word is "bias" stays."""
    return F.filter(explanation, lambda e: e["idx"] >= 0)


def important_ids(top: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(top, lambda e: e["idx"])))


def importance_mask(ids: Column, n: Column) -> Column:
    return F.when(n > 0, let(ids, lambda own: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains(own, i).cast("int")))).otherwise(F.array().cast("array<int>"))


def id_filter(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose keys (the columns of ``ids``) are given."""
    return rows.join(ids.distinct(), ids.columns, "left_semi")


def pred_class_filter(predictions: DataFrame, classes: tuple[int, ...], pred: str = "pred") -> DataFrame:
    return predictions.where(F.col(pred).isin(*classes))

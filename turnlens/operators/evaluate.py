"""Classification metrics, likeness rates, removal orders and perturbation curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["dia_no", "turn_no", "label"]


def metrics_cls(rows: DataFrame, by: list[str] | None = None, truth: str = "label", pred: str = "pred") -> DataFrame:
    """n_samples, accuracy, and per class precision, recall and F1 (0 where undefined). Classes are those that occur as
    truth or prediction within a group; one row of each."""
    by = by or []
    pairs = rows.groupBy(*by, truth, pred).agg(F.count("*").alias("n"))
    seen = pairs.select(*by, F.explode(F.array_distinct(F.array(truth, pred))).alias("class"), truth, pred, "n")
    hit = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    per = seen.groupBy(*by, "class").agg(hit((F.col(truth) == F.col("class")) & (F.col(pred) == F.col("class"))).alias("tp"), hit((F.col(truth) != F.col("class")) & (F.col(pred) == F.col("class"))).alias("fp"), hit((F.col(truth) == F.col("class")) & (F.col(pred) != F.col("class"))).alias("fn"))
    total = pairs.groupBy(*by).agg(F.sum("n").alias("n_samples"), (hit(F.col(truth) == F.col(pred)) / F.sum("n")).alias("accuracy"))
    joined = per.join(total, by) if by else per.join(F.broadcast(total))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return joined.select(*by, "class", "n_samples", "accuracy", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def metrics_online(rows: DataFrame, most: int = 10) -> DataFrame:
    """Metrics by prefix length (turn_no below ``most``), and of complete dialogues as turn_no -1, in one plan."""
    both = rows.where(F.col("turn_no") < most).select("turn_no", "label", "pred").unionByName(rows.where("is_complete").select(F.lit(-1).alias("turn_no"), "label", "pred"))
    return metrics_cls(both, ["turn_no"])


def keep_ratio(rows: DataFrame) -> DataFrame:
    """Mean share of important features over turns; turns without features are left out."""
    return rows.agg(F.avg(F.try_divide(F.size("important_features").cast("double"), F.col("n_features"))).alias("keep_ratio"))


def accuracy_thr(rows: DataFrame, prob: str = "prob", truth: str = "label", threshold: float = 0.5) -> DataFrame:
    return rows.agg(F.avg(((F.col(prob) >= threshold).cast("int") == F.col(truth)).cast("double")).alias("accuracy"))


def pct_like(explanation: Column, machine: bool, threshold: float = 0.0) -> Column:
    """Share in percent of features on the class's side, two decimals; 0 without features."""
    side = F.filter(explanation, lambda e: e["score"] > threshold if machine else e["score"] <= threshold)
    return F.coalesce(F.bround(F.try_divide(F.size(side) * 100.0, F.size(explanation)), 2), F.lit(0.0))


def timing_stats(rows: DataFrame) -> DataFrame:
    """Mean and population deviation of (stage, seconds)."""
    return rows.groupBy("stage").agg(F.avg("seconds").alias("mean"), F.stddev_pop("seconds").alias("std"))


def aopc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, step, prob), step 0 intact: the mean of drops up to each step, the intact state's 0 included."""
    w = W.partitionBy(*keys).orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("aopc", F.first("prob").over(w) - F.avg("prob").over(w))


def removal_order_original(own: DataFrame, pred: str = "pred", keys: list[str] | None = None) -> DataFrame:
    """Rows (turn key or ``keys``, token, score, pred), one of each distinct lower-cased token: its place of removal."""
    toward = F.when(F.col(pred) == 1, -F.col("score")).otherwise(F.col("score"))
    return own.withColumn("step", F.row_number().over(W.partitionBy(*(keys or KEY)).orderBy(toward, "token")))


def removal_order_accel(scores: DataFrame, preds: DataFrame, depth: int) -> DataFrame:
    """The profile's own words in order, whether or not the turn holds them, up to depth - 1: two orders serve all turns."""
    def first(pred: int, *order) -> DataFrame:
        few = scores.orderBy(*order).limit(depth - 1)  # a top-k, so that no task ranks the vocabulary
        return few.select(F.lit(pred).alias("pred"), F.row_number().over(W.orderBy(*order)).alias("step"), F.col("ngram").alias("token"))

    both = first(1, F.desc("score"), F.col("ngram")).unionByName(first(0, F.col("score"), F.col("ngram")))
    return preds.join(F.broadcast(both), "pred").select(*KEY, "step", "token")


def random_order(own: DataFrame, seed: int = 2025) -> DataFrame:
    return own.withColumn("step", F.row_number().over(W.partitionBy(*KEY).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in KEY], "token")))))


def remove_iterative(rows: DataFrame, depth: int) -> DataFrame:
    """Rows (turn key, tok, order): one state for each step 0 .. depth - 1; step k has lost all of the first k words."""
    states = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("step"))
    gone = F.slice("order", F.lit(1), F.col("step"))
    return states.withColumn("state", F.filter("tok", lambda t: ~F.array_contains(gone, F.lower(t))))


def position_bucket(position: Column, n: Column) -> Column:
    """Thirds of n: beginning, middle, end."""
    third = F.floor(n / 3)
    return F.when(position <= third, "beginning").when(position > 2 * third, "end").otherwise("middle")

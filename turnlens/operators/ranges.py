"""Places in a global order, without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def numbered(scratch: Scratch, rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``place``: from 0 without gaps within each group of ``by`` (no nulls there), in the given order. Rows are dealt by
    ranges of both together, so that a large group takes many tasks; places follow from each range's count of each group."""
    cols = [*by, *order]
    ranged = rows.repartitionByRange(*cols).sortWithinPartitions(*cols).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    kept = scratch.keep(ranged, name)
    runs = kept.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    ahead = F.sum("_rows").over(W.partitionBy(*(by or [F.lit(0)])).orderBy("_part")) - F.col("_rows")
    starts = runs.select(*by, "_part", "_first", ahead.alias("_ahead"))
    placed = kept.join(starts, [*by, "_part"]).withColumn("place", F.col("_ahead") + F.col("_at") - F.col("_first"))
    return placed.select(*rows.columns, "place")

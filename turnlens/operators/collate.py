"""Training batches of encoded texts, padded to the longest of their batch.

Rows of similar length share a batch, so little is padding: rows are numbered in the order of their length (in steps) and a
digest of their key, and a batch is so many neighbours. Batches themselves come in the order of a digest, so lengths are mixed
over a pass. Nothing here depends on a number of parts, and no task sees the whole order.

Defined cases: null ids are an empty sequence; rows of equal length and key go in any order; the last batch of the order of
lengths may hold fewer rows; an empty table gives no rows; other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SEED
from ..sources.scratch import Scratch
from .ranges import numbered

#: Lengths that count as equal.
STEP = 8


def digest(keys: list[str], seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def collate(df: DataFrame, columns: list[str], keys: list[str], size: int, seed: int = SEED, step: int = STEP, left: bool = False) -> DataFrame:
    """The rows with batch (its place in the order of batches' digests is ``turn``), and for each column of ids the column padded with
    0 to the longest of its batch, at its end or (``left``) its beginning, and ``<column>_mask``."""
    scratch = Scratch(df.sparkSession, "batches")
    ids = [F.coalesce(F.col(c), F.array().cast(dict(df.dtypes)[c])) for c in columns]
    rows = df.withColumns(dict(zip(columns, ids)))
    longest = F.greatest(*[F.size(c) for c in columns], F.lit(0))
    rows = rows.withColumn("_length", F.floor(longest / step)).withColumn("_h", digest(keys, seed))
    placed = numbered(scratch, rows, [], ["_length", "_h", *keys], "placed").withColumn("batch", F.floor(F.col("place") / size).cast("long"))
    placed = placed.withColumn("turn", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("batch").cast("string")))).drop("_length", "_h", "place")
    own = W.partitionBy("batch")  # as many rows as a batch has

    def padded(c: str) -> dict[str, Column]:
        missing = F.max(F.size(c)).over(own) - F.size(c)
        put = lambda xs: F.concat(F.array_repeat(F.lit(0), missing), xs) if left else F.concat(xs, F.array_repeat(F.lit(0), missing))
        return {c: put(F.col(c)), f"{c}_mask": put(F.transform(c, lambda _: F.lit(1)))}

    return placed.withColumns({k: v for c in columns for k, v in padded(c).items()})

"""A training corpus from raw documents: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Stages
carry any further columns along, whatever their names.

Defined cases: an empty table stays empty. Null and empty texts: not toxic unless the model says so of a text without
words, near copies of nothing, not contaminated, never drawn by the mix, since they hold no words. Rows without an id and
rows that repeat one count by themselves: they are judged by their own text. Repeated rows are near copies of each other.
Very long texts are read whole in every stage. Ties: of equal candidates the one with the smaller id, then the smaller
fingerprint of its words stays.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens.llm import decontamination, minhash_dedup, mixing, sharding, toxicity
from turnlens.llm.common import Scratch, owned, table, unused

#: Production parameters of the stages.
TOXIC_FROM, SHINGLE_WORDS, SIMILAR_PERCENT, WINDOW_WORDS, SHARDS = 0.5, 5, 80, 10, 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    columns = docs.columns
    score, toxic = unused(columns, "score"), unused(columns, "toxic")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, TOXIC_FROM, tuple(columns), (score, toxic)).where(F.col(toxic) == 0).select(*columns)


def _files(docs: DataFrame) -> tuple[Column, Column, Column] | None:
    """The number of each row's file (as the writer gave it), the file's name and the row's place in it; None where the table does not
    come from files, or has a column that hides this."""
    try:
        name, row = docs["_metadata.file_name"], docs["_metadata.row_index"]
    except AnalysisException:
        return None
    return F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), name, row


def _with_row(spark: SparkSession, docs: DataFrame, row: str) -> DataFrame:
    """The rows with numbers of their own, which do not change when they are read again: from the number of a row's file and its place
    there, if the files of one writer are all that there is, else by a copy."""
    if (found := _files(docs)) is not None:
        part, name, place = found
        split = F.coalesce(F.regexp_extract(name, r"-c(\d+)\.", 1).try_cast("long"), F.lit(0))
        seen = docs.select(part.alias("p"), split.alias("c"), docs["_metadata.file_path"].alias("f"), place.alias("i"))
        seen = seen.groupBy("p", "c").agg(F.count_distinct("f").alias("files"), F.max("i").alias("i")).agg(F.max("files").alias("files"), F.max("p").alias("p"), F.max("c").alias("c"), F.max("i").alias("i"), F.count_if(F.col("p").isNull()).alias("odd")).first()
        if seen["files"] is None or (seen["files"] == 1 and not seen["odd"] and seen["p"] < 1 << 22 and seen["c"] < 1 << 9 and seen["i"] < 1 << 32):
            return docs.withColumn(row, part * (1 << 41) + split * (1 << 32) + place)
    return Scratch(spark, "rows").keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row with the smallest id stays. Rows count by themselves, whatever their ids."""
    row, columns = unused(docs.columns, "row"), docs.columns
    with_row = _with_row(spark, docs, row)
    found = minhash_dedup.near_duplicates(with_row, percent=SIMILAR_PERCENT, shingle=SHINGLE_WORDS, row=row)
    return with_row.join(found.where(~F.col("first")).select(row), row, "left_anti").select(*columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"), window=WINDOW_WORDS)
    bad, hashed = unused(docs.columns, "bad"), unused(docs.columns, "hashed")
    marked = found.where("contaminated").select(F.col("doc_id").alias(bad), F.col("text_hash").alias(hashed)).distinct()
    return docs.join(marked, docs["doc_id"].eqNullSafe(marked[bad]) & (F.xxhash64(docs["text"]) == marked[hashed]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it, dealt to the tree's output shards and shuffled within them; documents
    that it does not draw go. Documents stay whole. The order of the rows is that of tree shard and place."""
    return mixing.shuffled(mixing.mix(docs, whole=True, carry=True)).select("row.*")


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row. Slots follow the order of the mix, so that a shard holds the tree's shards one after the
    other, each with its quota of the sources, shuffled. That order is the one of the files that the mix was written to and of the
    rows in them; a table that does not come from files goes by id."""
    order = _files(docs)
    return sharding.shard(docs, shards=SHARDS, order=None if order is None else list(order))



STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with owned():  # the stage's own tables
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs

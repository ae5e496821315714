"""Files: ontologies, goal tables, text folders, generated dialogues, metrics, artefacts and checkpoints."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ONTOLOGY = "domains map<string,struct<slots:map<string,struct<description:string,is_categorical:boolean,possible_values:array<string>>>>>, intents map<string,struct<description:string>>"
#: What a training checkpoint holds besides the model.
TRAINER_FILES = ("optimizer.pt", "scheduler.pt", "rng_state.pth", "training_args.bin", "trainer_state.json")


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ONTOLOGY).json(path, multiLine=True)


def dim_slot(ontology: DataFrame, domain: str | None = None) -> DataFrame:
    """domain, slot, description, is_categorical, possible_values. An unknown domain raises an error."""
    rows = ontology.select(F.explode("domains").alias("domain", "d")).select("domain", F.explode("d.slots").alias("slot", "s")).select("domain", "slot", "s.description", "s.is_categorical", "s.possible_values")
    if domain is None:
        return rows
    if rows.where(F.col("domain") == domain).limit(1).count() == 0:
        raise ValueError(f"no domain {domain!r}")
    return rows.where(F.col("domain") == domain)


def dim_intent(ontology: DataFrame) -> DataFrame:
    return ontology.select(F.explode("intents").alias("intent", "i")).select("intent", "i.description")


def ontology_slots(slots: DataFrame, mask: str | None = None) -> DataFrame:
    """Per domain one JSON text of slots and their values, ``dontcare`` left out, or the mask in their place."""
    values = F.lit(mask) if mask else F.to_json(F.filter("possible_values", lambda v: v != "dontcare"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("slot"), values.alias("v"))))
    return slots.groupBy("domain").agg(F.to_json(F.map_from_entries(entries)).alias("slots"))


def read_slot_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """slot and description from a JSON object of columns, whose ``slots`` maps each slot to its description. Columns beside it are
    ignored, and so are slots without a description."""
    table = spark.read.schema("slots map<string,string>").json(path, multiLine=True)
    return table.select(F.explode("slots").alias("slot", "description")).where("description is not null")


def read_goals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def append_rows(df: DataFrame, path: str) -> None:
    """Generated rows as they come; readers see whole files only."""
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file, such as a report, in whatever store the path names."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def load_text_folder(spark: SparkSession, path: str, classes: tuple[str, ...] = ("neg", "pos")) -> DataFrame:
    """text and label (the place of its folder in ``classes``) of a folder per class, line breaks of HTML as blanks."""
    parts = [spark.read.text(f"{path}/{name}", wholetext=True).select(F.rtrim(F.replace("value", F.lit("<br />"), F.lit(" "))).alias("text"), F.lit(i).alias("label")) for i, name in enumerate(classes)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _list(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [str(s.getPath().toString()) for s in fs.listStatus(where)] if fs.exists(where) else []


def latest_checkpoint(spark: SparkSession, path: str) -> str | None:
    """The ``checkpoint-N`` folder with the largest number."""
    found = [(int(m[1]), p) for p in _list(spark, path) if (m := re.search(r"checkpoint-(\d+)$", p))]
    return max(found)[1] if found else None


def prune_checkpoints(spark: SparkSession, path: str) -> list[str]:
    """Deletes what training keeps besides the models and returns it."""
    gone = [f for d in _list(spark, path) if re.search(r"checkpoint-\d+$", d) for f in _list(spark, d) if f.rsplit("/", 1)[1] in TRAINER_FILES]
    for f in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(f)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)
    return gone


class Artefacts:
    """Tables by name and a hash of all that they depend on. A stored table is read, anything else is made and stored."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str, key: str) -> str:
        return f"{self.root}/{name}-{key}"

    def get(self, name: str, key: str, make) -> DataFrame:
        where = self.path(name, key)
        done = [p for p in _list(self.spark, where) if p.endswith("/_SUCCESS")]
        if not done:
            make().write.mode("overwrite").parquet(where)
        return self.spark.read.parquet(where)

    def clear(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def parse_json_text(text: str) -> dict:
    return json.loads(text)

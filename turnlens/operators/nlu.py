"""Extraction of acts by a text generator: a prompt for each line with demonstrations like it, and bounded concurrent calls.

Demonstrations come from an inverted index of the examples' words. A line asks with its rarest words that any example holds; an
example scores the sum of the weights of those that it shares. A word's list in the index holds ``LISTED`` examples at
most, by a digest (a parameter of the feature, so a frequent word is no large list); words that fewer examples hold are listed in full.

Calls run in threads, ``at_once`` in a task, and are repeated until an answer parses or ``tries`` are used up; a line without a
usable answer gets no acts and says so. Results come in the order of the lines, whatever the order of the answers.

Defined cases: null and empty lines have no words and no demonstrations; an example is no demonstration for its own line; equal
scores go by the digest, then the key; fewer examples than asked for are all that there is; a call that raises counts as one
without an answer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SEED
from .collate import digest
from .scoring import TextGenerator, repeat_until

#: Examples that a word's list holds, and words that a line asks with.
LISTED, ASKED = 64, 4
ANSWER = re.compile(r"<DA>(.*?)</DA>", re.S)


def words(text: Column) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda w: w != ""))


def demonstrations(lines: DataFrame, examples: DataFrame, keys: list[str], own: list[str], k: int = 2, asked: int = ASKED, listed: int = LISTED, seed: int = SEED) -> DataFrame:
    """The best examples of each line: line key, rank from 1, the example's key as ``example`` (a struct), score. ``own`` names the
    key columns that a line must not share with its demonstrations."""
    index = examples.select(*keys, digest(keys, seed).alias("_h"), F.explode(words(F.col("text"))).alias("word"))
    held = index.groupBy("word").agg(F.count("*").alias("df"))
    place = F.row_number().over(W.partitionBy("word").orderBy("_h", *keys))
    lists = index.withColumn("_place", place).where(F.col("_place") <= listed).select("word", F.struct(*keys).alias("example"), F.col("_h").alias("_e"))
    rarest = W.partitionBy(*keys).orderBy("df", "word")
    asks = lines.select(*keys, F.explode(words(F.col("text"))).alias("word")).join(held, "word").withColumn("_r", F.row_number().over(rarest)).where(F.col("_r") <= asked)
    met = asks.join(lists, "word").where(~F.struct(*own).eqNullSafe(F.struct(*[F.col("example")[c].alias(c) for c in own])))
    scored = met.groupBy(*keys, "example", "_e").agg(F.round(F.sum(F.lit(1.0) / F.col("df")), 9).alias("score"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "_e", "example"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(*keys, "rank", "example", "score")


def prompts(lines: DataFrame, examples: DataFrame, found: DataFrame, keys: list[str], head: str, speaker: str = "user") -> DataFrame:
    """The prompt of each line: ``head``, its demonstrations (context, text, acts by name), the best last, and the line."""
    shown = examples.select(F.struct(*keys).alias("example"), F.concat(F.lit("Context: "), F.coalesce("context", F.lit("")), F.lit(f"\n{speaker}: "), F.coalesce("text", F.lit("")), F.lit("\n<DA>"), F.col("acts"), F.lit("</DA>\n")).alias("shown"))
    own = found.join(shown, "example").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "shown"))), lambda x: x["shown"]), "").alias("shown"))
    tail = F.concat(F.lit("Context: "), F.coalesce("context", F.lit("")), F.lit(f"\n{speaker}: "), F.coalesce("text", F.lit("")), F.lit("\n"))
    return lines.join(own, keys, "left").select(*keys, F.concat(F.lit(head), F.coalesce("shown", F.lit("")), tail).alias("prompt"))


def parsed(answer: str | None) -> list[list[str]] | None:
    """The acts between the answer's marks: a JSON list of lists of four strings. None if there are none such."""
    found = ANSWER.search(answer or "")
    try:
        acts = json.loads(found[1]) if found else None
    except ValueError:
        return None
    return acts if isinstance(acts, list) and all(isinstance(a, list) and len(a) == 4 and all(isinstance(x, str) for x in a) for a in acts) else None


def extract(asked: DataFrame, keys: list[str], make: Callable[[], TextGenerator], at_once: int = 4, tries: int = 3) -> DataFrame:
    """Rows (key, prompt) to key, acts, calls (how many were made) and ok. Each task has one generator of its own."""
    types = dict(asked.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = make()

        def one(prompt: str) -> tuple[list, int, bool]:
            calls = 0

            def call():
                nonlocal calls
                calls += 1
                try:
                    return parsed(generator.chat(prompt))
                except Exception:  # whatever a client raises: an answer that is not there
                    return None

            acts = repeat_until(call, lambda x: x is not None, tries)
            return acts or [], calls, acts is not None

        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                rows = pdf.itertuples(index=False)
                while some := list(islice(rows, 64 * at_once)):
                    found = list(pool.map(one, [r.prompt for r in some]))
                    yield pd.DataFrame([(*[getattr(r, k) for k in keys], *f) for r, f in zip(some, found)], columns=[*keys, "acts", "calls", "ok"])

    return asked.select(*keys, "prompt").mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", acts array<array<string>>, calls int, ok boolean")

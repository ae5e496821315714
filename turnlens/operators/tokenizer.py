"""Subword ids from the vocabulary file of a public tokenizer, with special tokens of our own.

The file's path is a parameter; Spark sends the file to its executors. Nothing is trained here. Special tokens are found first,
as they stand, and get the ids that follow the file's; what lies between them is encoded by the file's rules, in which none of
the file's own special tokens counts. A model over such ids has as many vectors as the tokenizer has ids.

Defined cases: null and empty texts have no ids; of special tokens that begin at one place the longest counts; texts longer than
``max_len`` ids are cut at their end; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..config import CLS, DA_SEP, MASK, PAD, SEP, SLOT_SEP, SYSTEM_MARK, USER_MARK

#: The marks that the engine's sequences hold.
MARKS = (PAD, CLS, SEP, MASK, DA_SEP, SLOT_SEP, USER_MARK, SYSTEM_MARK)


@lru_cache(maxsize=8)
def _file(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    found.encode_special_tokens = True
    return found


@dataclass(frozen=True)
class Subwords:
    """A vocabulary file and the special tokens that are added to it."""

    path: str
    marks: tuple[str, ...] = MARKS

    def __len__(self) -> int:
        return _file(self.path).get_vocab_size() + len(self.marks)

    def id_of(self, mark: str) -> int:
        return _file(self.path).get_vocab_size() + self.marks.index(mark)

    def ids(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text. All pieces between marks are encoded together."""
        cut = re.compile("|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))) or r"(?!)")
        pieces, plan = [], []
        for text in texts:
            own, at = [], 0
            for m in cut.finditer(text or ""):
                if text[at : m.start()].strip():
                    own.append((len(pieces), None))
                    pieces.append(text[at : m.start()])
                own.append((None, self.id_of(m[0])))
                at = m.end()
            if (text or "")[at:].strip():
                own.append((len(pieces), None))
                pieces.append(text[at:])
            plan.append(own)
        coded = [e.ids for e in _file(self.path).encode_batch(pieces, add_special_tokens=False)] if pieces else []
        return [[i for piece, mark in own for i in ([mark] if piece is None else coded[piece])] for own in plan]

    def text(self, ids: list[int]) -> str:
        """The text of ids, for byte-level vocabularies."""
        size, out, run = _file(self.path).get_vocab_size(), [], []
        for i in [*ids, None]:
            if i is None or i >= size:
                out.append(_file(self.path).decode(run, skip_special_tokens=False) if run else "")
                out.append("" if i is None else self.marks[i - size])
                run = []
            else:
                run.append(i)
        return "".join(out)


def new_tokenizer(spark: SparkSession, path: str, marks: tuple[str, ...] = MARKS) -> Subwords:
    """A tokenizer whose file all executors have."""
    spark.sparkContext.addFile(path)
    return Subwords(path, marks)


def subword_ids(tokenizer: Subwords, text: Column, max_len: int | None = None) -> Column:
    """The ids of a text, without padding."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(tokenizer.ids(texts.tolist()))

    return run(text) if max_len is None else F.slice(run(text), 1, max_len)


def for_classification(tokenizer: Subwords, fusion: str = "average", **settings):
    """A fresh model with a vector for each id of the tokenizer, and the function that gives ``fusion.train`` its ids."""
    from .fusion import Settings, TwoTowers

    model = TwoTowers.drawn(Settings(fusion, buckets=len(tokenizer), **settings))
    return model, lambda text, buckets: F.coalesce(subword_ids(tokenizer, text), F.array().cast("array<int>"))

"""Fill-in-middle transformation by one Aho-Corasick scan of each text.

Texts are cut by ranks of units: code points, runs of one class (blanks, and what is not blank), or lines. One automaton over
code points finds the ASCII characters at which the class of a text changes, and the sentinels. What lies between two such
events is of one class, so its number of units follows from its length alone: each code point of a gap is a unit, or the whole
gap is one. The events are therefore all that a rank lookup needs: the number of units before each event is a running sum,
and the place of the k-th unit is found by a binary search and one addition. The same scan says whether a text holds a
sentinel, which would make the transformation ambiguous; such texts stay plain.

Form and ranks come from a hash of the id alone, so reruns agree whatever the partitions, and a lost task repeats them. One
pass over the texts, without a shuffle.

Defined cases: a null text is empty; an empty text stays plain; a null id hashes as the empty string; repeated rows and ids
are transformed alike; equal ranks leave an empty middle; very long texts are cut whole, and only the events of one text are
held at a time; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Fixed values of the contract: what stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts that stay plain and transformed texts with the suffix first, of a hundred.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: ASCII characters at which the class changes, for each kind of unit.
BLANKS = " \t\n\v\f\r"
CHANGES = {"char": BLANKS, "run": BLANKS, "line": "\n"}
SENTINEL, CHANGE = 1, 0


@lru_cache(maxsize=len(CHANGES))
def automaton(unit: str):
    """The automaton of a kind of unit: its class-changing characters and the sentinels."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in CHANGES[unit]:
        found.add_word(c, CHANGE)
    for s in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(s, SENTINEL)
    found.make_automaton()
    return found


def events(text: str, unit: str) -> tuple[np.ndarray, bool]:
    """Places of the class-changing characters, in order, and whether the text holds a sentinel."""
    found = np.fromiter(chain.from_iterable(automaton(unit).iter(text)), np.int64).reshape(-1, 2)
    sentinel = found[:, 1] == SENTINEL
    return found[~sentinel, 0], bool(sentinel.any())


class Ranks:
    """Sparse rank lookup: where segments of one class begin and how many units lie before each."""

    def __init__(self, at: np.ndarray, size: int, unit: str):
        if unit == "line":
            edges = np.concatenate([[0], at + 1])
        elif unit == "run":  # a run of blanks begins at a blank that follows none, and ends before what is not blank
            edges = np.concatenate([[0], at[np.diff(at, prepend=-2) > 1], at[np.diff(at, append=size + 1) > 1] + 1])
        else:
            edges = np.concatenate([[0], at, at + 1])
        edges = np.unique(edges)
        self.start, self.size, self.each = edges[edges < size], size, unit == "char"
        held = np.diff(self.start, append=size) if self.each else np.ones(len(self.start), np.int64)
        self.before = np.concatenate([[0], np.cumsum(held)])

    @property
    def units(self) -> int:
        return int(self.before[-1])

    def place(self, rank: int) -> int:
        """Where the first ``rank`` units end."""
        if rank >= self.units:
            return self.size
        i = int(np.searchsorted(self.before, rank, "right")) - 1
        return int(self.start[i]) + (rank - int(self.before[i])) * self.each


def hashes(doc_id: Column, salt: str) -> list[Column]:
    """The first four groups of eight hexadecimal digits of a hash of the id, as numbers."""
    digits = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, unit: str = "char", salt: str = "1", plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per document: doc_id, n (units), form (plain, psm or spm), prefix_units, middle_units, prefix_chars,
    middle_chars (all null if plain) and output, the transformed text."""
    if unit not in CHANGES:
        raise ValueError(f"unit is one of {', '.join(CHANGES)}")
    h = hashes(docs["doc_id"], salt)
    rows = docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"), *[c.alias(f"h{i}") for i, c in enumerate(h, 1)])
    kind = dict(rows.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text, h1, h2, h3, h4 in zip(*(part.column(c).to_pylist() for c in ("text", "h1", "h2", "h3", "h4"))):
                    at, marked = events(text, unit)
                    ranks = Ranks(at, len(text), unit)
                    if not text or marked or h3 % 100 >= 100 - plain_percent:
                        out.append((ranks.units, "plain", None, None, None, None, text))
                        continue
                    low, high = sorted((h1 % (ranks.units + 1), h2 % (ranks.units + 1)))
                    a, b = ranks.place(low), ranks.place(high)
                    prefix, suffix = PREFIX + text[:a], SUFFIX + text[b:]
                    form = "spm" if h4 % 100 < spm_percent else "psm"
                    first = suffix + prefix if form == "spm" else prefix + suffix
                    out.append((ranks.units, form, low, high - low, a, b - a, first + MIDDLE + text[a:b]))
                types = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string()]
                names = ["n", "form", "prefix_units", "middle_units", "prefix_chars", "middle_chars", "output"]
                arrays = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], ["doc_id", *names])

    return rows.mapInArrow(cut, f"doc_id {kind}, n long, form string, prefix_units long, middle_units long, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from the output and its form alone."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2))), F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u),
c AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""

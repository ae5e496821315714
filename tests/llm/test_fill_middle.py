import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from turnlens.llm import fill_middle as M

PATTERN = {"char": r"(?s).", "run": r"[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+", "line": r"[^\n]*\n|[^\n]+"}


def brute(doc_id, text, unit="char"):
    text, digits = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(PATTERN[unit], text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if h4 % 100 < 20:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit", sorted(PATTERN))
def test_ranks_find_every_unit(unit):
    for seed in range(300):
        r = random.Random(seed)
        text = "".join(r.choice(["a", "é", "😀", " ", "\t", "\n", "\r", "<P>", "<", "P>", " ", "bc"]) for _ in range(r.randrange(30)))
        at, marked = M.events(text, unit)
        ranks, units = M.Ranks(at, len(text), unit), re.findall(PATTERN[unit], text)
        assert ranks.units == len(units) and marked == bool(re.search("<[PSM]>", text))
        assert [text[ranks.place(k) : ranks.place(k + 1)] for k in range(len(units))] == units


@pytest.mark.parametrize("unit", sorted(PATTERN))
def test_like_brute_force(spark, messy, unit):
    extra = [(1000 + i, t) for i, t in enumerate(["<P>", "a <S> b", "<M", "<<P", "x" * 5, "😀é\n" * 40, "\n", " ", "P>"])] + [(None, "null id"), (None, None)] + [(2000 + i, "é b\n😀" * (i % 5)) for i in range(150)]
    docs = messy.select("doc_id", "text", F.lit(1).alias("n"), F.lit(2).alias("h1"), F.lit(3).alias("output")).unionByName(spark.createDataFrame([(*r, 1, 2, 3) for r in extra], "doc_id long, text string, n int, h1 int, output int"))
    out = M.transform(docs, unit=unit).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    want = [brute(r["doc_id"], r["text"], unit) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out), key=str) == sorted(want, key=str)
    assert sorted(r["back"] for r in out) == sorted(r["text"] or "" for r in docs.collect())
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    if unit == "char":
        assert all((r["prefix_units"], r["middle_units"]) == (r["prefix_chars"], r["middle_chars"]) for r in out)


def test_parameters_and_empty_table(spark, nothing, messy):
    assert M.transform(nothing).count() == 0
    assert {r["form"] for r in M.transform(messy, plain_percent=100).select("form").distinct().collect()} == {"plain"}
    with pytest.raises(ValueError):
        M.transform(messy, unit="byte")

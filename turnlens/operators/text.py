"""Text operators of generation and parsing. What does not parse is null, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters besides ASCII letters, digits and signs that an utterance may hold.
EXTRA_CHARACTERS = "áéíóúàèüöäñçÁÉÍÓÚÀÈÜÖÄÑÇ—€£ãõâêîôûÂÊÎÔÛ "
OTHER_ROLE = {"user": "system", "system": "user"}


def between(text: Column, start: str, end: str) -> Column:
    """What stands between the first start and the first end, trimmed; null where either is missing or they cross."""
    a, b = F.locate(start, text), F.locate(end, text)
    n = b - a - len(start)
    return F.when((a > 0) & (b > 0) & (n >= 0), F.trim(F.substring(text, a + F.lit(len(start)), n)))


def english_only(text: Column) -> Column:
    return text.rlike("^[!-~" + EXTRA_CHARACTERS + "]*$")


def parse_utterance(response: Column, role: str) -> Column:
    """``role: text`` where the response holds exactly one line of the role, none of the other, and known characters."""
    marked = F.when(F.contains(response, F.lit(f"{role}: ")), response).otherwise(F.replace(response, F.lit(f"{role}:"), F.lit(f"{role}: ")))
    parts = F.split(marked, f"{role}: ")
    said = F.get(parts, F.lit(1))
    clean = F.trim(F.replace(said, F.lit("\n"), F.lit(" ")))
    clean = F.translate(clean, "‘’", "''")
    ok = F.contains(response, F.lit(f"{role}:")) & (F.size(parts) == 2) & ~F.contains(said, F.lit(f"{OTHER_ROLE[role]}:")) & english_only(clean)
    return F.when(ok, F.concat(F.lit(f"{role}: "), clean))


def strip_end(text: Column) -> tuple[Column, Column]:
    """The text without END or STOP between signs, and whether there was one."""
    pattern = r"(?i)[^\w\s]+\b(?:END|STOP)\b[^\w\s]+"
    return F.trim(F.regexp_replace(text, pattern, "")), text.rlike(pattern)


def collapse_lines(dia: Column) -> Column:
    """Each utterance on one line: lines that begin with no role join the one before, with a blank."""
    joined = F.regexp_replace(dia, r"[ \t]*\n[ \t]*(?!user:|system:)", " ")
    return F.array_join(F.transform(F.split(joined, "\n"), lambda x: F.trim(x)), "\n")


def parse_goal(response: Column) -> tuple[Column, Column]:
    """Goals and outcomes of a response that begins by thinking; null where either is missing. Alternatives follow the
    first goal in order."""
    goals = F.regexp_extract_all(response, F.lit(r"(?s)<(ALT_GOAL|GOAL)>(.*?)</\1>"), F.lit(2))
    outcomes = F.regexp_extract_all(response, F.lit(r"(?s)<OUTCOME>(.*?)</OUTCOME>"), F.lit(1))
    ok = response.startswith("<THINK>") & (F.size(goals) > 0) & (F.size(outcomes) > 0)
    trim = lambda xs: F.transform(xs, lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.when(ok, trim(goals)), F.when(ok, trim(outcomes))


def parse_admin(response: Column) -> Column:
    """The index within ``<goal>`` tags."""
    goal = between(response, "<goal>", "</goal>")
    return F.when(goal.rlike("^[0-9]+$"), goal.try_cast("int"))


def parse_masked(response: Column) -> Column:
    return between(response, "<DIA>", "</DIA>")


def mask_validate(original: Column, masked: Column) -> Column:
    """The masked text where it has as many lines as the original, else the original."""
    same = F.size(F.split(masked, "\n")) == F.size(F.split(original, "\n"))
    return F.when(masked.isNotNull() & same, masked).otherwise(original)


def goal_split(goal_outcome: Column) -> tuple[Column, Column]:
    """Goals and outcomes of ``goal <sep> ... <outcome> outcome <sep> ...``."""
    sides = F.split(goal_outcome, "<outcome>")
    parts = lambda x: F.transform(F.split(F.coalesce(x, F.lit("")), "<sep>"), lambda y: F.trim(y))
    return parts(F.get(sides, F.lit(0))), parts(F.get(sides, F.lit(1)))


def act_to_readable(intent: Column, domain: Column, slot: Column, value: Column) -> Column:
    name = lambda x: F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))
    shown = F.when(value == "", "[unspecified]").otherwise(value)
    return F.concat(name(intent), F.lit(" - "), name(domain), F.lit(" - "), name(slot), F.lit(" = "), shown)


def sentences(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, idx, token): the sentence of each token, from 1. A stop ends a sentence unless it completes an
    abbreviation or the next token begins with a small letter."""
    from pyspark.sql import Window as W

    #: Abbreviations that a stop completes.
    short = ("St", "Mr", "Mrs", "Ms", "Dr", "Prof", "Mt")
    w = W.partitionBy(*keys).orderBy("idx")
    before, after = F.lag("token").over(w), F.lead("token").over(w)
    ends = F.col("token").isin(".", "?", "!") & ~((F.col("token") == ".") & F.coalesce(before.isin(*short), F.lit(False))) & ~F.coalesce(after.rlike(r"^\p{Ll}"), F.lit(False))
    return rows.withColumn("_end", ends.cast("int")).withColumn("sentence", (F.coalesce(F.sum("_end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1).cast("int")).drop("_end")


def spaced_tokens(text: Column) -> Column:
    """Words with commas, stops, question marks and apostrophes as tokens of their own."""
    return F.filter(F.split(F.regexp_replace(text, r"([,.?'])", " $1"), r"\s+"), lambda t: t != "")


def template(pattern: str, **values: Column) -> Column:
    """Fills ``$name`` places of a pattern."""
    import re

    parts = re.split(r"\$(\w+)", pattern)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])

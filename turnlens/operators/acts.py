"""Checking, repairing, masking and parsing dialogue acts against an ontology."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.conversations import ACTS

#: Fixed values of the act vocabulary.
SENSITIVE = ("name", "ref", "postcode", "phone", "address")
CONFIRMING, IGNORED_INTENTS = ("confirm", "correct"), ("apologize", "wish", "sorry")
MORE_SLOTS, BOOK_SLOTS, IGNORED_SLOTS = ("details", "info"), ("booking", "book"), ("intent", "action", "write")
NO_ACT_SLOTS = ("interest", "suggestions", "choice", "choices", "recommendation", "recommendations", "options", "help", "availability", "flights", "discount", "excitement", "pool", "privacy", "weather", "meal", "airline")
ALIASES = {"activities": "amenities", "nearby_attractions": "vicinity", "location": "vicinity", "flight_class": "seat", "class": "seat", "n_infants": "n_children", "rating": "gst_rating"}
YES_NO_SLOTS, YES_WORDS = ("amenities", "vicinity", "breakfast"), ("basic", "some")


@dataclass(frozen=True)
class Ontology:
    """Valid intents and domains, and per slot its possible values (none listed: any value)."""

    intents: frozenset[str]
    domains: frozenset[str]
    slots: dict[str, tuple[str, ...]] = field(hash=False)

    @staticmethod
    def of(parsed: dict) -> "Ontology":
        slots = {s: tuple(str(v) for v in info["possible_values"]) for d in parsed["domains"].values() for s, info in d["slots"].items()}
        return Ontology(frozenset(parsed.get("intents", {})), frozenset(parsed["domains"]) | {"general"}, slots)

    def value_ok(self, slot: str, value: str) -> bool:
        return not value or (slot in self.slots and (not self.slots[slot] or value in self.slots[slot]))


def mask_sensitive_slot(acts: Column) -> Column:
    hide = lambda a: F.when(a["slot"].isin(*SENSITIVE) & (a["value"] != ""), F.concat(F.lit("["), a["slot"], F.lit("]"))).otherwise(a["value"])
    return F.transform(acts, lambda a: F.struct(a["intent"].alias("intent"), a["domain"].alias("domain"), a["slot"].alias("slot"), hide(a).alias("value")))


def check_acts(acts: DataFrame, ontology: Ontology) -> DataFrame:
    """Rows (.., intent, domain, slot, value) with ``invalid``, the parts that the ontology does not know."""
    values = F.create_map(*[x for s, vs in sorted(ontology.slots.items()) for x in (F.lit(s), F.array(*map(F.lit, vs)).cast("array<string>"))]) if ontology.slots else F.create_map().cast("map<string,array<string>>")
    known = F.try_element_at(values, F.col("slot"))
    bad_value = (F.col("value") != "") & ((F.col("slot") == "") | (F.coalesce(F.size(known) > 0, F.lit(False)) & ~F.coalesce(F.array_contains(known, F.col("value")), F.lit(False))))
    flags = [("intent", ~F.col("intent").isin(*ontology.intents)), ("domain", ~F.col("domain").isin(*ontology.domains)), ("slot", (F.col("slot") != "") & ~F.col("slot").isin(*ontology.slots)), ("value", bad_value)]
    return acts.withColumn("invalid", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags])))


def fixed(utterance: str, acts: list[list[str]], known: Ontology) -> list[list[str]]:
    """The rule table, act by act. What no rule covers ends the repair: earlier repairs stay and nothing is removed."""
    out = [[*a, *[""] * (4 - len(a))] for a in acts]
    gone: list[list[str]] = []
    for i in range(len(acts)):
        intent, domain, slot, value = out[i]
        if intent and intent not in known.intents:
            if intent in CONFIRMING and slot and value:
                intent = "inform"
            elif intent in CONFIRMING or intent in IGNORED_INTENTS:
                gone.append(out[i])
        if intent == "greet" and domain == "":
            domain = "general"
        out[i][:2] = intent, domain
        if slot and slot not in known.slots:
            if utterance.startswith("sys") and slot == "choice" and value.isdigit():
                slot = "count"
            elif slot in MORE_SLOTS:
                intent, slot, value = (intent, value, "") if value in known.slots else ("reqmore", "", "")
            elif slot in NO_ACT_SLOTS or slot in IGNORED_SLOTS or slot == "confirmation" and "book" not in utterance:
                gone.append(out[i])
                continue
            elif slot in BOOK_SLOTS or slot == "confirmation":
                intent, slot, value = "book", "", ""
            elif slot in ALIASES:
                slot = ALIASES[slot]
            else:
                return out
            out[i][:] = intent, domain, slot, value
        if not known.value_ok(slot, value):
            places = sorted({w for w in value.split() if w in known.slots}) if slot == "vicinity" else []
            if places:
                gone.append(out[i])
                out += [[intent, domain, w, "True"] for w in places]
            elif slot in YES_NO_SLOTS and (value in YES_WORDS or "no" in value):
                out[i][3] = "True" if value in YES_WORDS else "False"
            elif intent == "greet":
                out[i][2:] = "", ""
            else:
                return out
    return [a for a in out if not any(a is g for g in gone)]


def fix_acts(rows: DataFrame, ontology: Ontology, utterance: str = "utterance", acts: str = "acts") -> DataFrame:
    """Repairs the acts column. The rules stop at the first act that they cannot repair, so this is Python, in batches."""
    names = ("intent", "domain", "slot", "value")

    @F.pandas_udf(ACTS)
    def repair(said: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, a)) for a in fixed(u or "", [[x[n] or "" for n in names] for x in (g if g is not None else [])], ontology)] for u, g in zip(said, given)])

    return rows.withColumn(acts, repair(F.col(utterance), F.col(acts)))


def parse_da_json(response: Column) -> Column:
    """Acts (arrays of strings) between ``<DA>`` and ``</DA>``; empty where there is no valid JSON list."""
    from .text import between

    parsed = F.from_json(between(response, "<DA>", "</DA>"), "array<array<string>>")
    return F.coalesce(parsed, F.array().cast("array<array<string>>"))


def parse_da_serial(text: Column) -> Column:
    """Acts of ``[intent][domain]([slot][value],[slot][value]);[...``; parts that do not split are skipped."""
    parts = F.split(F.regexp_replace(F.regexp_replace(text, r"^\[", ""), r"\]\)$", ""), r"\]\);\[")

    def of(part: Column) -> Column:
        sides = F.split(part, r"\]\(\[")
        head = F.split(F.get(sides, F.lit(0)), r"\]\[")
        pairs = F.filter(F.transform(F.split(F.coalesce(F.get(sides, F.lit(1)), F.lit("")), r"\],\["), lambda x: F.split(x, r"\]\[")), lambda p: F.size(p) == 2)
        acts = F.transform(pairs, lambda p: F.struct(F.get(head, F.lit(0)).alias("intent"), F.get(head, F.lit(1)).alias("domain"), F.get(p, F.lit(0)).alias("slot"), F.get(p, F.lit(1)).alias("value")))
        return F.when((F.size(sides) == 2) & (F.size(head) == 2), acts).otherwise(F.array().cast(ACTS))

    return F.flatten(F.transform(parts, of))


def da_examples(turns: DataFrame, speaker: str) -> DataFrame:
    """Lines of one speaker with the line before as context."""
    from pyspark.sql import Window as W

    before = F.lag("text").over(W.partitionBy("dia_no", "label").orderBy("pos"))
    return turns.withColumn("context", F.coalesce(before, F.lit(""))).where(F.col("role") == speaker)


def nlu_prompt(examples: DataFrame, intents: list[tuple[str, str]], slots: list[tuple[str, str]], speaker: str) -> DataFrame:
    """One row: the prompt for act extraction, with the ontology's words and the examples (context, text, acts) in order."""
    from .features import act_name

    head = "\n".join(["Intents:", *[f"- {n}: {d}" for n, d in intents], "Slots:", *[f"- {n}: {d}" for n, d in slots], "Answer with a JSON list of [intent, domain, slot, value] in <DA></DA> tags.", ""])
    shown = F.concat(F.lit("Context: "), F.col("context"), F.lit(f"\n{speaker}: "), F.col("text"), F.lit("\n<DA>"), F.array_join(F.transform("acts", act_name), ";"), F.lit("</DA>"))
    ordered = F.array_sort(F.collect_list(F.struct("dia_no", "pos", shown.alias("t"))))
    return examples.agg(F.concat(F.lit(head), F.array_join(F.transform(ordered, lambda x: x["t"]), "\n")).alias("prompt"))

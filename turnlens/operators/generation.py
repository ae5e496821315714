"""Synthetic dialogues: a user, a system and an overseer take turns behind the ``TextGenerator`` protocol."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.manifest import Manifest
from .dialogue import anti_resume, limit_generate
from .scoring import TextGenerator, repeat_until
from .text import EXTRA_CHARACTERS, OTHER_ROLE

KNOWN = re.compile(f"[!-~{EXTRA_CHARACTERS}]*")
DIALOGUES = "dia_no long, goal string, dia string, is_complete boolean"
END = re.compile(r"[^\w\s]+\b(?:END|STOP)\b[^\w\s]+", re.I)


def one_utterance(response: str | None, role: str) -> str | None:
    """The rule of ``text.parse_utterance`` for a single string."""
    if response is None or f"{role}:" not in response:
        return None
    said = re.split(f"{role}: ?", response)[1:]
    if len(said) != 1 or f"{OTHER_ROLE[role]}:" in said[0]:
        return None
    clean = said[0].replace("\n", " ").strip().replace("‘", "'").replace("’", "'")
    return f"{role}: {clean}" if KNOWN.fullmatch(clean) else None


def goal_index(response: str | None) -> int | None:
    found = re.search(r"<goal>(.*?)</goal>", response or "", re.S)
    return int(found[1]) if found and found[1].strip().isdigit() else None


def converse(user: TextGenerator, system: TextGenerator, overseer: TextGenerator, goals: list[str], outcomes: list[str], max_turns: int = 15, tries: int = 5) -> tuple[str, bool]:
    """The dialogue and whether it came to its end. The system is told the goals that the user has expressed so far."""
    lines: list[str] = []
    numbered = "\n".join(f"{i}. {g}" for i, g in enumerate(goals, 1))
    told = [f"goal: {g}\noutcome: {o}" for g, o in zip(goals, outcomes)]

    def say(who: TextGenerator, role: str, goal: str) -> bool | None:
        """True at the end, None if nothing usable was said."""
        line = repeat_until(lambda: one_utterance(who.chat(f"{goal}\n{'\n'.join(lines)}"), role), lambda x: x is not None, tries)
        if line is None:
            return None
        text = END.sub("", line).strip()
        if len(text) <= len(role) + 2:
            return None
        lines.append(text)
        return text != line.strip()

    for _ in range(max_turns):
        ended = say(user, "user", json.dumps(goals))
        if ended is not False:
            return "\n".join(lines), ended is True
        reached = repeat_until(lambda: goal_index(overseer.chat(f"{numbered}\n{'\n'.join(lines)}")), lambda x: x is not None, tries)
        if reached is None:
            break
        ended = say(system, "system", json.dumps(told[:reached]))
        if ended is not False:
            return "\n".join(lines), ended is True
    return "\n".join(lines), False


def e2e_dataset(goals: DataFrame, done: DataFrame, requested: int | None, make: Callable[[int], tuple[TextGenerator, TextGenerator, TextGenerator]], max_turns: int = 15, tries: int = 5, again: int = 3) -> DataFrame:
    """Dialogues for the next goals (dia_no, goals, outcomes) that are not done: dia_no, goal, dia, is_complete. Without
    ``requested`` all of them. Append the result with ``sources.files.append_rows`` and pass what is there as ``done`` to go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for dia_no, gs, os_ in zip(pdf["dia_no"], pdf["goals"], pdf["outcomes"]):
                dia, ok = repeat_until(lambda: converse(*make(int(dia_no)), list(gs), list(os_), max_turns, tries), lambda x: x[1], again, latest=True)
                rows.append((dia_no, " <sep> ".join(gs), dia, ok))
            yield pd.DataFrame(rows, columns=["dia_no", "goal", "dia", "is_complete"])

    todo = anti_resume(goals, done) if requested is None else limit_generate(goals, requested, done)
    return todo.mapInPandas(run, DIALOGUES)


def generate(goals: DataFrame, where: str, make: Callable[[int], tuple[TextGenerator, TextGenerator, TextGenerator]], requested: int | None = None, group: int = 1024, **settings) -> DataFrame:
    """``e2e_dataset`` as a job that can be stopped: dialogues are committed below ``where`` in groups of about ``group``, so what
    is lost with a job is one group at most, and none is generated twice within a round. A round takes the goals that no
    earlier round has completed; a call goes on with a round that was not finished, or else begins the next one. Returns the
    latest dialogue of every goal that has one."""
    store = Manifest(goals.sparkSession, where, DIALOGUES)
    there = store.committed()
    round_ = sum(name.startswith("end-") for name in there)
    of_round = lambda name: -1 if name.startswith("end-") else int(name.split("-")[0])
    done = store.read(lambda name: 0 <= of_round(name) < round_).where("is_complete")
    # What a round takes follows from finished rounds alone, so a call that goes on takes the same.
    todo = anti_resume(goals, done) if requested is None else limit_generate(goals, requested, done)
    n = todo.count()
    if n:
        many = -(-n // group)
        own = lambda i: todo.where(F.pmod(F.xxhash64("dia_no"), F.lit(many)) == i)
        store.run([f"{round_}-{i}" for i in range(many)], lambda name: e2e_dataset(own(int(name.split("-")[1])), done.limit(0), None, make, **settings))
        store.commit(f"end-{round_}", goals.sparkSession.createDataFrame([], DIALOGUES))
    out = None
    for r in range(round_ + 1):  # of rounds that both hold a goal the later counts
        own_round = store.read(lambda name: of_round(name) == r)
        out = own_round if out is None else own_round.unionByName(out.join(own_round.select("dia_no"), "dia_no", "left_anti"))
    return out

"""The online pipeline, turn by turn: hide sensitive values, extract acts, score the turn in both modalities, attribute both
scores, mask, and score the dialogue over all masked turns so far. As a stateful stream and as its batch twin.

What happens to a turn by itself needs no state, so it happens before it: turns of many sessions are extracted, masked and
attributed together, and the masked inputs of all of them reach a scorer in batches of bounded size. Any scorer will do, as
attribution only asks for scores. The stateful part (``session``) appends the masked turn and updates the dialogue's score.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MASK, SEED
from ..operators.attribution import explained, keep_acts, mask_words
from ..operators.scoring import ActScorer, DialogueScorer, LexiconScorer
from ..sources.conversations import INTENTS, SLOTS
from .session import IDLE_MS, TURN, sessions_batch, sessions_stream

Act = tuple[str, str, str, str]


def surrogate(text: str) -> list[Act]:
    """The surrogate extractor of the test tables, for one text."""
    out = []
    for sentence in re.split(r"[.?!]+ *", text):
        if sentence.strip(" "):
            words = re.split(" +", sentence.strip(" "))
            slot = SLOTS[len(words[-1]) % 3]
            out.append((INTENTS[len(words[0]) % 5], "general", slot, words[-1] if slot else ""))
    return out


@dataclass(frozen=True)
class Parts:
    """What the pipeline is made of: scorers of utterances, of acts (names joined by ``;``) and of dialogues, an extractor of acts,
    the slots whose values are hidden, how many tokens and acts of a turn stay, and how attributions are made."""

    utt: object = field(default_factory=LexiconScorer)
    da: object = field(default_factory=ActScorer)
    dia: object = field(default_factory=DialogueScorer)
    extract: Callable[[str], list[Act]] = surrogate
    hidden: tuple[str, ...] = ("name",)
    k_utt: int = 3
    k_da: int = 2
    method: str = "shapley_taylor"
    masks: int = 100
    seed: int = SEED


def strongest(found: dict, n: int, k: int) -> list[int]:
    """The places of the k features with the strongest scores, in their order. Scores are rounded, as solvers leave noise."""
    weigh = lambda i: -abs(round(found.get((i,), 0.0), 6))
    return sorted(sorted(range(n), key=lambda i: (weigh(i), i))[:k])


def _logit(scorer) -> Callable[[list[str]], np.ndarray]:
    """What is attributed: the logit of scorers that have one, or else the probability."""
    return getattr(scorer, "logit", scorer.predict)


def attributed(messages: DataFrame, parts: Parts) -> DataFrame:
    """Messages (session_id, seq, text, reset) as turns for ``session``: masked, acts (names of those that stay), both
    probabilities. Without state and without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, acts = [], []
            for text in pdf["text"].fillna(""):
                own = parts.extract(text)
                for _, _, slot, value in own:
                    if slot in parts.hidden and value:
                        text = text.replace(value, f"[{slot}]")
                words.append(text.split())
                acts.append(["|".join((i, d, s, f"[{s}]" if s in parts.hidden and v else v)) for i, d, s, v in own])
            keys = list(zip(pdf["session_id"], pdf["seq"]))
            of_words = [found for found, *_ in explained(zip(keys, words), _logit(parts.utt), parts.method, parts.masks, seed=parts.seed, apply=mask_words, on_masks=getattr(parts.utt, "on_masks", None))]
            of_acts = [found for found, *_ in explained(zip(keys, acts), _logit(parts.da), parts.method, parts.masks, seed=parts.seed, apply=keep_acts)]
            kept = [set(strongest(f, len(w), parts.k_utt)) for f, w in zip(of_words, words)]
            yield pd.DataFrame(
                {
                    "session_id": pdf["session_id"], "seq": pdf["seq"],
                    "masked": [" ".join(w if i in own else MASK for i, w in enumerate(ws)) for own, ws in zip(kept, words)],
                    "acts": [[own[i] for i in strongest(f, len(own), parts.k_da)] for f, own in zip(of_acts, acts)],
                    "utt_prob": parts.utt.predict([" ".join(w) for w in words]) if len(pdf) else [], "da_prob": parts.da.predict([";".join(a) for a in acts]) if len(pdf) else [], "reset": pdf["reset"].fillna(False),
                }
            )

    return messages.select("session_id", F.col("seq").cast("long").alias("seq"), "text", F.col("reset").cast("boolean").alias("reset")).mapInPandas(run, TURN)


def run_stream(messages: DataFrame, parts: Parts = Parts(), idle_ms: int | None = IDLE_MS) -> DataFrame:
    """A stream of (session_id, seq, text, reset) to one row per turn; rows of one batch go in the order of seq."""
    return sessions_stream(attributed(messages, parts), parts.dia, idle_ms)


def run_batch(messages: DataFrame, parts: Parts = Parts()) -> DataFrame:
    """The batch twin; messages without ``reset`` have none."""
    rows = messages if "reset" in messages.columns else messages.withColumn("reset", F.lit(False))
    return sessions_batch(attributed(rows, parts), parts.dia)

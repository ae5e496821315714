"""Features of utterances, acts and dialogues, and applying masks to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MASK
from ..functions.columns import let
from ..sources.conversations import ACTS, none_da, tokens


def is_none(acts: Column) -> Column:
    return (F.size(acts) == 1) & (F.get(acts, F.lit(0))["intent"] == "none")


def named(texts: Column) -> Column:
    """``text index`` names, by which explanations refer to features."""
    return F.transform(texts, lambda t, i: F.concat(t, F.lit(" "), i.cast("string")))


def utt_features(text: Column) -> Column:
    return tokens(text)


def act_name(a: Column) -> Column:
    return F.concat_ws("|", a["intent"], a["domain"], a["slot"], a["value"])


def da_features(utterances: Column) -> Column:
    """Acts of a turn's utterances (an array of act arrays); the sentinel of an utterance without acts is no feature."""
    return F.transform(F.flatten(F.filter(utterances, lambda u: ~is_none(u))), act_name)


def dia_features(texts: Column, utterances: Column) -> Column:
    """Tokens first, then acts."""
    return F.concat(F.flatten(F.transform(texts, tokens)), da_features(utterances))


def mask_apply_utt(toks: Column, mask: Column, replacement: str = MASK) -> Column:
    """Tokens without a bit, or with bit 0, become the mask token; the sequence keeps its length."""
    kept = let(mask, lambda m: F.transform(toks, lambda t, i: F.when(F.coalesce(F.get(m, i), F.lit(0)) == 1, t).otherwise(F.lit(replacement))))
    return F.trim(F.array_join(kept, " "))


def mask_apply_da(utterances: Column, mask: Column, offset=0) -> Column:
    """Acts with bit 0 go; an utterance that loses all is left with the sentinel, which takes no bit itself."""
    offset = offset if isinstance(offset, Column) else F.lit(offset)
    before = lambda us, i: offset + F.aggregate(F.slice(us, F.lit(1), i), F.lit(0), lambda n, u: n + F.when(is_none(u), 0).otherwise(F.size(u)))

    def of(us: Column, m: Column, u: Column, i: Column) -> Column:
        kept = let(before(us, i), lambda first: F.filter(u, lambda a, j: F.coalesce(F.get(m, first + j), F.lit(0)) == 1))
        return let(kept, lambda k: F.when(is_none(u) | (F.size(k) == 0), none_da()).otherwise(k))

    return let(utterances, lambda us: let(mask, lambda m: F.transform(us, lambda u, i: of(us, m, u, i)))).cast(f"array<{ACTS}>")


def mask_apply_dia(toks: Column, utterances: Column, mask: Column) -> tuple[Column, Column]:
    """Both modalities under one mask: bits of tokens, then bits of acts."""
    return mask_apply_utt(toks, mask), mask_apply_da(utterances, mask, F.size(toks))


def mask_drop_words(words: Column, mask: Column) -> Column:
    return F.array_join(let(mask, lambda m: F.filter(words, lambda w, i: F.coalesce(F.get(m, i), F.lit(0)) == 1)), " ")

"""Reports: phrase clouds, report texts and one HTML page per session."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cloud
from .text import template

SCOPE = ["scope", "intent", "domain", "slot", "side"]
#: Phrases of a scope that are merged, in pairs, by one task.
MOST_PHRASES = 2000
#: Texts of the report.
TOKEN_MOST = 'The model takes "$utterance" for $label-generated: $percent% of its tokens follow patterns of $label responses. In sentence $sentence the token "$token" stands at the $place, right after "$before".'
TOKEN_FIRST = 'The model takes "$utterance" for $label-generated: $percent% of its tokens follow patterns of $label responses. In sentence $sentence the token "$token" stands at the $place and opens the sentence.'
TOKEN_FEW = "The model takes this utterance for $label-generated because of $number of its words. In sentence $sentence it says '$before $token', a phrasing that is common in $label utterances."
ACT_MOST = "The utterance has $n dialogue acts, and $percent% of them are $label-like; for example it $intent $slot of $domain."
ACT_FEW = "Of the utterance's $n dialogue acts only $number are $label-like, such as that it $intent $slot of $domain; they still count."
ACT_NONE = "The utterance has no dialogue acts."


def phrase_weight(score: Column, phrase: Column) -> Column:
    """Longer phrases weigh more: score times ln(words + 1)."""
    return score * F.log(F.size(F.split(phrase, " ")) + 1)


def _joined(a: list[str], b: list[str], least: int) -> list[str] | None:
    for n in range(min(len(a), len(b)), least - 1, -1):
        if a[-n:] == b[:n]:
            return a + b[n:]
        if b[-n:] == a[:n]:
            return b + a[n:]
    return None


def _holding(words: dict[str, list[str]]) -> tuple[set[str], set[str]]:
    """Which phrases hold another, and which another holds. Parts of a phrase are looked up, so pairs are never tried."""
    of: dict[tuple[str, ...], list[str]] = {}
    for p, w in words.items():
        of.setdefault(tuple(w), []).append(p)
    lengths = sorted({len(w) for w in of} - {0})
    holds, held = set(), set()
    for own, ps in of.items():
        parts = {part for n in lengths if n < len(own) for i in range(len(own) - n + 1) if (part := own[i : i + n]) in of}
        if parts or len(ps) > 1:
            holds.update(ps)
        held.update(p for part in parts for p in of[part])
        if len(ps) > 1:
            held.update(ps)
    return holds, held


def _grown(queue: list[list[str]], least: int) -> list[list[str]]:
    """One pass: each phrase grows together with the first one after it that its ends overlap. Phrases are found by how they
    begin and end."""
    begins: dict[tuple[str, ...], list[int]] = {}
    ends: dict[tuple[str, ...], list[int]] = {}
    for i in reversed(range(len(queue))):  # the last of a list is the first phrase
        w = tuple(queue[i])
        for n in range(least, len(w) + 1):
            begins.setdefault(w[:n], []).append(i)
            ends.setdefault(w[-n:], []).append(i)
    gone, done = [False] * len(queue), []
    for i, first in enumerate(queue):
        if gone[i]:
            continue
        gone[i], w, partner = True, tuple(first), None
        for n in range(least, len(w) + 1):
            for found in (begins.get(w[-n:], []), ends.get(w[:n], [])):
                while found and gone[found[-1]]:
                    found.pop()
                if found and (partner is None or found[-1] < partner):
                    partner = found[-1]
        if partner is None:
            done.append(first)
        else:
            gone[partner] = True
            done.append(_joined(first, queue[partner], least))
    return done


def merged_phrases(scores: dict[str, float], least: int) -> dict[str, float]:
    """Phrases that hold no other or that no other holds, those in between left out; then phrases whose ends overlap by
    ``least`` words at least grow together until none do. A phrase scores as the best given one that it holds, else 1."""
    if len(scores) > MOST_PHRASES:
        raise ValueError(f"{len(scores)} phrases of one scope: cut profiles to their top first")
    words = {p: p.split() for p in scores}
    holds, held = _holding(words)
    queue = [words[p] for p in words if p not in holds] + [words[p] for p in words if p in holds and p not in held]
    while len(done := _grown(queue, max(1, least))) < len(queue):
        queue = done
    texts = dict.fromkeys(" ".join(w) for w in queue)
    best = sorted(scores.items(), key=lambda x: -x[1])
    return {t: next((s for p, s in best if p in t), 1.0) for t in texts}


def phrase_filter_merge(top: DataFrame, least: int = 2) -> DataFrame:
    """Rows (scope .. side, ngram, score) of the top profiles, at most some dozens in a scope: the merged phrases."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = merged_phrases(dict(zip(pdf["ngram"], pdf["score"])), least)
        return pd.DataFrame([(*pdf[SCOPE].iloc[0], p, float(s)) for p, s in found.items()], columns=[*SCOPE, "phrase", "score"])

    return top.select(*SCOPE, "ngram", "score").groupBy(*SCOPE).applyInPandas(run, "scope string, intent string, domain string, slot string, side string, phrase string, score double")


def clouds(top: DataFrame, least: int = 2) -> DataFrame:
    """Phrase clouds of every scope and class: phrase and weight."""
    rows = phrase_filter_merge(top, least)
    return rows.select(*SCOPE, "phrase", phrase_weight(F.col("score"), F.col("phrase")).alias("weight"))


def token_colour(score: Column, high: Column, low: Column, pred: Column) -> Column:
    """Opacity of a token: its share of the highest score where class 1 is predicted, else of the lowest; 0 on the other side."""
    share = F.when(pred == 1, F.try_divide(score, high)).otherwise(F.try_divide(score, low))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0))))


def report_text(rows: DataFrame) -> DataFrame:
    """Adds token_text and act_text. Expects utterance, label, percent, number, sentence, token, place, before,
    n_acts, act_percent, act_number, intent, domain and slot."""
    of = {k: F.col(k) for k in ("utterance", "label", "percent", "number", "sentence", "token", "place", "before")}
    first = F.col("before").isNull()
    token = F.when((F.col("percent") >= 50) & ~first, template(TOKEN_MOST, **of)).when(first, template(TOKEN_FIRST, **of)).otherwise(template(TOKEN_FEW, **of))
    acts = dict(n=F.col("n_acts"), percent=F.col("act_percent"), number=F.col("act_number"), label=F.col("label"), intent=F.col("intent"), domain=F.col("domain"), slot=F.col("slot"))
    act = F.when(F.col("n_acts") == 0, F.lit(ACT_NONE)).when(F.col("act_percent") >= 50, template(ACT_MOST, **acts)).otherwise(template(ACT_FEW, **acts))
    return rows.withColumn("token_text", token).withColumn("act_text", act)


def bars(values: list[float], width: int = 320, height: int = 80) -> str:
    """A line of probabilities as inline SVG."""
    step = width / max(1, len(values) - 1)
    points = " ".join(f"{i * step:.1f},{height - v * height:.1f}" for i, v in enumerate(values))
    return f'<svg width="{width}" height="{height}"><polyline fill="none" stroke="black" points="{points}"/></svg>'


def report_html(turns: list[dict]) -> str:
    """One page of a session's turns: text, tokens (text, alpha), pred, prob, token_text and act_text of each."""
    parts = ["<!doctype html><meta charset='utf-8'><title>Dialogue report</title>", bars([t["prob"] for t in turns])]
    for t in turns:
        rgb = "255,0,0" if t["pred"] == 1 else "0,0,255"
        words = " ".join(f'<span style="background:rgba({rgb},{a:.2f})">{html.escape(w)}</span>' for w, a in t["tokens"])
        parts.append(f"<section><p>{words}</p><p>{html.escape(t['token_text'])}</p><p>{html.escape(t['act_text'])}</p></section>")
    return "\n".join(parts)


def report_pages(texts: DataFrame, tokens: DataFrame, phrases: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """The pages of all dialogues: dia_no, label, n_turns and html, from texts (turn key, pred, prob, token_text, act_text),
    tokens (turn key, idx, token, alpha) and phrases (dia_no, label, side, phrase, weight). With ``members`` (dia_no, label,
    acts) phrases have acts in place of dia_no and label, and a cloud that many dialogues show is drawn once."""
    words = tokens.groupBy("dia_no", "label", "turn_no").agg(F.array_sort(F.collect_list(F.struct("idx", "token", "alpha"))).alias("tokens"))
    turns = texts.join(words, ["dia_no", "label", "turn_no"], "left")
    turns = turns.groupBy("dia_no", "label").agg(F.array_sort(F.collect_list(F.struct("turn_no", "pred", "prob", "token_text", "act_text", "tokens"))).alias("turns"))

    @F.pandas_udf("string")
    def page(turns: pd.Series) -> pd.Series:
        return pd.Series([report_html([{**t, "tokens": [(w["token"], w["alpha"]) for w in (t["tokens"] if t["tokens"] is not None else [])]} for t in ts]) for ts in turns])

    @F.pandas_udf("string")
    def drawn(phrases: pd.Series) -> pd.Series:
        return pd.Series([cloud_html([(c["side"], c["phrase"], -c["order"]) for c in cs]) for cs in phrases])

    key = ["dia_no", "label"] if members is None else ["acts"]
    own = phrases.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("side", (-F.col("weight")).alias("order"), "phrase"))).alias("cloud"))
    pages = turns.select("dia_no", "label", F.size("turns").alias("n_turns"), page("turns").alias("page"))
    if members is not None:
        pages = pages.join(members, ["dia_no", "label"], "left")
    pages = pages.join(own.select(*key, drawn("cloud").alias("drawn")), key, "left")
    return pages.select("dia_no", "label", "n_turns", F.concat("page", F.lit("\n"), F.coalesce("drawn", F.lit(""))).alias("html"))


def cloud_html(phrases: list[tuple[str, str, float]]) -> str:
    """Phrases (side, phrase, weight) as placed clouds, one for each side."""
    return "\n".join(f'<div class="cloud {side}">{cloud.svg([(p, w) for s, p, w in phrases if s == side])}</div>' for side in dict.fromkeys(s for s, *_ in phrases))


def last_acts(acts: DataFrame) -> DataFrame:
    """The acts of each dialogue's last user turn, without values and once each: dia_no, label and the array acts."""
    from pyspark.sql import Window as W

    last = acts.withColumn("_last", F.max("turn_no").over(W.partitionBy("dia_no", "label"))).where("turn_no = _last AND intent IS NOT NULL AND domain IS NOT NULL AND slot IS NOT NULL")
    return last.groupBy("dia_no", "label").agg(F.array_sort(F.collect_set(F.struct("intent", "domain", "slot"))).alias("acts"))


def act_clouds(members: DataFrame, top: DataFrame, least: int = 2) -> DataFrame:
    """Phrase clouds (acts, side, phrase, weight) of every set of acts that ``last_acts`` found, once for each set. The top
    profiles of its acts are added up; a class that no act has profiles for has no cloud."""
    each = members.select("acts").distinct().select("acts", F.inline("acts"))
    summed = each.join(top.where("scope = 'act'"), ["intent", "domain", "slot"]).groupBy("acts", "side", "ngram").agg(F.sum("score").alias("score"))
    lists = summed.groupBy("acts", "side").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "ngram"))).alias("grams"))

    @F.pandas_udf("array<struct<phrase:string,score:double>>")
    def merged(grams: pd.Series) -> pd.Series:
        return pd.Series([[{"phrase": p, "score": float(s)} for p, s in merged_phrases({g["ngram"]: -g["order"] for g in gs}, least).items()] for gs in grams])

    rows = lists.select("acts", "side", F.inline(merged("grams")))
    return rows.select("acts", "side", "phrase", phrase_weight(F.col("score"), F.col("phrase")).alias("weight"))


def last_turn_clouds(acts: DataFrame, top: DataFrame, least: int = 2) -> DataFrame:
    """Phrase clouds (dia_no, label, side, phrase, weight) of the acts of each dialogue's last user turn, as ``act_clouds`` has
    them for its set of acts."""
    members = last_acts(acts)
    return members.join(act_clouds(members, top, least), "acts").select("dia_no", "label", "side", "phrase", "weight")

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnlens.operators import evaluate as E
from turnlens.operators import matching as M
from turnlens.operators import profile as PR
from turnlens.operators import report as R
from turnlens.operators import selection as SE


def rows(spark, ai, human):
    data = [(w, 1.0) for w, n in ai.items() for _ in range(n)] + [(w, -1.0) for w, n in human.items() for _ in range(n)] + [("zero", 0.0)]
    return spark.createDataFrame([("inform", "d", "s", *x) for x in data], "intent string, domain string, slot string, ngram string, score double")


GOLDEN = {"lor": (1.156428, -1.811644, 0.935493), "fwlor": (1.023091, -1.952135, 1.068144), "agg_o": (1.083333, -0.75, 0.666667)}


@pytest.mark.parametrize("name", GOLDEN)
def test_metrics_of_a_known_profile(spark, name):
    counts = PR.profile_counts(rows(spark, {"hello": 2, "yes": 1}, {"hello": 1, "no": 3}))
    got = {r["ngram"]: r["score"] for r in PR.metric(counts, name).where("scope = 'global'").collect()}
    assert set(got) == {"hello", "no", "yes"}
    assert [round(got[w], 6) for w in ("hello", "no", "yes")] == pytest.approx(GOLDEN[name], abs=2e-6)


def test_swapping_classes_flips_the_sign(spark):
    a, b = {"x": 5, "y": 2}, {"x": 1, "z": 4}
    for name in ("lor", "lsr", "fwlor", "fwlsr"):
        one = {r["ngram"]: r["score"] for r in PR.profile_build(rows(spark, a, b), name).where("scope = 'act'").collect()}
        two = {r["ngram"]: r["score"] for r in PR.profile_build(rows(spark, b, a), name).where("scope = 'act'").collect()}
        assert all(one[w] == pytest.approx(-two[w]) for w in one)


def test_empty_scopes_and_tops(spark):
    p = PR.profile_build(rows(spark, {f"w{i}": i + 1 for i in range(30)}, {"n": 9}))
    acts = spark.createDataFrame([("inform", "d", "s"), ("bye", "d", "")], "intent string, domain string, slot string")
    full = PR.with_empty_scopes(p, acts)
    assert full.where("intent = 'bye'").first()["ngram"] is None
    top = PR.top_profile(p, 20)
    assert top.groupBy("scope", "side").count().agg(F.max("count")).first()[0] == 20 and top.where("score < 0").count() == 0


def test_spans_and_tags(spark):
    df = spark.createDataFrame([(1, i, f"t{i}", float(i)) for i in (2, 3, 5)], "k int, idx int, token string, score double")
    assert sorted((r["phrase"], r["utt_expl"]) for r in PR.phrases(df, ["k"]).collect()) == [("t2 t3", 2.5), ("t5", 5.0)]
    tag = lambda t, v, s: spark.createDataFrame([(t, v, s)], "t string, v string, s string").select(PR.slot_tag(F.col("t"), F.col("v"), F.col("s"))).first()[0]
    assert tag("to New YORK now", "new york", "city") == "to <city> now"
    assert tag("a.b costs (5)", "(5)", "price") == "a.b costs <price>" or "(5)" in tag("a.b costs (5)", "(5)", "price")
    assert tag("Élan vital", "élan", "x") == "<x> vital" and tag("same", "", "x") == "same" and tag("same", "same", "") == "same"
    got = spark.createDataFrame([(["<c>", "<c>", "a", "<c>"], [1.0, 3.0, 5.0, 7.0])], "t array<string>, s array<double>").select(PR.collapse_scores(F.col("t"), F.col("s"), F.lit("<c>")).alias("c")).select("c.*").first()
    assert got["t"] == ["<c>", "a", "<c>"] and got["s"] == [2.0, 5.0, 7.0]


def test_curves(spark):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate([0.9, 0.7, 0.8, 0.2])], "k int, step int, prob double")
    assert [round(r["aopc"], 6) for r in E.aopc(df, ["k"]).orderBy("step").collect()] == [0.0, 0.1, 0.1, 0.25]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2)), min_size=1, max_size=12))
def test_classification_metrics(spark, pairs):
    out = {r["class"]: r for r in E.metrics_cls(spark.createDataFrame(pairs, "label int, pred int")).collect()}
    assert set(out) == {x for p in pairs for x in p}
    for c, r in out.items():
        tp, fp, fn = (sum(f(y, p) for y, p in pairs) for f in (lambda y, p: y == p == c, lambda y, p: p == c != y, lambda y, p: y == c != p))
        assert r["precision"] == pytest.approx(tp / (tp + fp) if tp + fp else 0) and r["recall"] == pytest.approx(tp / (tp + fn) if tp + fn else 0)
        assert r["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn)) and r["n_samples"] == len(pairs)


def test_csls(spark):
    sim = [[0.9, 0.1, 0.3], [0.2, 0.8, 0.4]]
    df = spark.createDataFrame([(0, i, j, sim[i][j]) for i in range(2) for j in range(3)], "g int, i int, j int, sim double")
    got = {(r["i"], r["j"]): round(r["csls"], 4) for r in M.csls(df, ["g"]).collect()}
    assert [got[i, j] for i in range(2) for j in range(3)] == pytest.approx([0.8167, -0.6833, -0.1833, -0.6167, 0.6833, -0.0167], abs=1e-4)
    kept = M.rel_threshold(M.sim_to_table(M.csls(df, ["g"])), ["g"])
    assert {(r["i"], r["j"]) for r in kept.collect()} == {(0, 0), (1, 1)}


def test_blocks_match_as_rows_do(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    r = random.Random(4)
    rows = [(g, i, [r.gauss(0, 1) for _ in range(3)]) for g in range(2) for i in range(11)] + [(0, 3, [1.0, 0.0, 0.0]), (1, 2, [0.0, 0.0, 0.0])]
    left = spark.createDataFrame(rows, "g int, i long, vec array<double>")
    right = spark.createDataFrame([(g, 50 + i, v) for g, i, v in rows[:-5]], "g int, j long, vec array<double>")
    of = lambda df, c: {(x["g"], x["i"], x["j"]): x[c] for x in df.collect()}
    sim, blocks = M.pairwise_sim(left, right, ["g"]), M.Blocks(left, right, ["g"])
    assert of(blocks.pairwise_sim(), "sim") == pytest.approx(of(sim, "sim")) and of(blocks.csls(), "csls") == pytest.approx(of(M.csls(sim, ["g"]), "csls"))
    assert of(blocks.match_corpus(), "csls") == pytest.approx(of(M.match_corpus(left, right, ["g"]), "csls"))
    null = M.Blocks(left.limit(0).unionByName(spark.createDataFrame([(0, 1, None), (0, 2, [1.0, 0.0])], left.schema)), spark.createDataFrame([(0, 9, [1.0, 0.0])], right.schema), ["g"])
    assert of(null.pairwise_sim(), "sim") == {(0, 1, 9): None, (0, 2, 9): 1.0} and of(null.csls(), "csls") == {(0, 1, 9): None, (0, 2, 9): 0.0}


def test_selection_breaks_ties_by_index(spark):
    e = [{"idx": i, "text": f"w{i}", "score": s} for i, s in enumerate([0.5, -0.5, 0.1, 0.5])]
    df = spark.createDataFrame([(e, 1), (e, 0), (e, None), ([], 1)], "e array<struct<idx:int,text:string,score:double>>, pred int")
    ids = lambda c: [[x["idx"] for x in r[0]] for r in df.select(c).collect()]
    assert ids(SE.topk_absolute(F.col("e"), 3))[0] == [0, 1, 3]
    assert ids(SE.topk_prediction(F.col("e"), F.col("pred"), 2)) == [[0, 3], [1, 2], [0, 1], []]
    mask = df.select(SE.importance_mask(SE.important_ids(SE.topk_absolute(F.col("e"), 2)), F.size("e"))).collect()
    assert mask[0][0] == [1, 1, 0, 0] and mask[3][0] == []


def test_phrases_merge_to_a_fixpoint():
    got = R.merged_phrases({"a b": 1.0, "b c": 2.0, "a b c": 3.0, "c d e": 4.0, "d e f": 5.0, "q": 0.5}, 2)
    assert got == {"a b c": 3.0, "c d e f": 5.0, "q": 0.5}
    assert R.merged_phrases({"a b": 1.0, "a b c": 2.0, "z a b c": 3.0}, 3) == {"a b": 1.0, "z a b c": 3.0}
    assert R.merged_phrases({}, 2) == {}


def test_weights_and_pages(spark):
    w = spark.range(1).select(R.phrase_weight(F.lit(2.0), F.lit("a b"))).first()[0]
    assert w == pytest.approx(2 * math.log(3))
    page = R.report_html([{"prob": 0.7, "pred": 1, "tokens": [("<b>", 0.5)], "token_text": "x", "act_text": "y"}])
    assert "&lt;b&gt;" in page and "<svg" in page


def _merged_by_pairs(scores, least):
    """What ``merged_phrases`` means, pair by pair."""
    words = {p: p.split() for p in scores}
    within = lambda a, b: f" {' '.join(a)} " in f" {' '.join(b)} "
    holds = {p: any(q != p and within(words[q], words[p]) for q in words) for p in words}
    held = {p: any(q != p and within(words[p], words[q]) for q in words) for p in words}
    queue, grown = [words[p] for p in words if not holds[p]] + [words[p] for p in words if holds[p] and not held[p]], True
    while grown:
        grown, done = False, []
        while queue:
            first, rest = queue[0], queue[1:]
            partner = next(((i, m) for i, other in enumerate(rest) if (m := R._joined(first, other, least))), None)
            grown = grown or partner is not None
            done.append(first if partner is None else partner[1])
            queue = rest if partner is None else rest[: partner[0]] + rest[partner[0] + 1 :]
        queue = done
    return {t: max((s for p, s in scores.items() if p in t), default=1.0) for t in dict.fromkeys(" ".join(w) for w in queue)}


def test_phrases_merge_without_trying_pairs(monkeypatch):
    import random

    r = random.Random(3)
    for k in range(300):
        scores = {" ".join(r.choice("abcdefgh"[: 2 + k % 7]) for _ in range(r.randrange(1, 6))): round(r.random(), 2) for _ in range(r.randrange(25))}
        for least in (1, 2, 3):
            assert list(R.merged_phrases(scores, least).items()) == list(_merged_by_pairs(scores, least).items())
    tried, joined = [], R._joined
    monkeypatch.setattr(R, "_joined", lambda *a: tried.append(1) or joined(*a))
    apart = {f"a{i} b{i}": 1.0 for i in range(400)}
    assert len(R.merged_phrases({**apart, "b7 q r": 2.0}, 1)) == 400 and len(tried) == 1


def test_dialogues_with_the_same_last_acts_share_a_cloud(spark):
    from turnlens.operators import cloud

    acts = spark.createDataFrame([(d, d % 2, t, t, i, "g", "", "v") for d in range(30) for t, i in ((0, "bye"), (1, "ask"), (1, "say") if d % 3 else (1, "ask"))], "dia_no long, label int, turn_no int, act_i int, intent string, domain string, slot string, value string")
    top = spark.createDataFrame([("act", i, "g", "", side, g, s) for i, side, g, s in (("ask", "ai", "a b", 1.0), ("ask", "ai", "b c d", 2.0), ("ask", "ai", "c d e", 1.0), ("say", "ai", "a b", 3.0), ("say", "human", "x", 1.0), ("bye", "ai", "z", 9.0))], "scope string, intent string, domain string, slot string, side string, ngram string, score double")
    members = R.last_acts(acts)
    clouds = R.act_clouds(members, top)
    ask, say = ("ask", "g", ""), ("say", "g", "")
    found = {(tuple(map(tuple, r.acts)), r.side, r.phrase, round(r.weight, 6)) for r in clouds.collect()}
    weigh = lambda s, n: round(s * math.log(n + 1), 6)
    assert found == {((ask,), "ai", "b c d e", weigh(2, 4)), ((ask,), "ai", "a b", weigh(1, 2)), ((ask, say), "ai", "b c d e", weigh(2, 4)), ((ask, say), "ai", "a b", weigh(4, 2)), ((ask, say), "human", "x", weigh(1, 1))}
    each = R.last_turn_clouds(acts, top).collect()
    assert len(each) == 10 * 2 + 20 * 3 and {r.phrase for r in each if r.dia_no == 3} == {"a b", "b c d e"}
    texts = spark.createDataFrame([(d, d % 2, 0, 1, 0.5, "t", "a") for d in range(31)], "dia_no long, label int, turn_no int, pred int, prob double, token_text string, act_text string")
    tokens = spark.createDataFrame([(d, d % 2, 0, 0, f"w{d}", 0.5) for d in range(31)], "dia_no long, label int, turn_no int, idx int, token string, alpha double")
    pages = lambda df: {r.dia_no: r.html for r in df.collect()}
    by_set = pages(R.report_pages(texts, tokens, clouds, members))
    assert by_set == pages(R.report_pages(texts, tokens, R.last_turn_clouds(acts, top))) and len(by_set) == 31
    assert "b c d e" in by_set[0] and "cloud human" in by_set[1] and by_set[30].endswith("\n")
    # the first place along the spiral that is free, step by step
    words = [(f"{'w' * (i % 9 + 1)}{i}", float(i % 13)) for i in range(60)]
    taken = set()
    for b in cloud.layout(words):
        cells = lambda x, y: {(c, r) for c in range(math.floor(x / cloud.CELL), math.floor((x + b.width) / cloud.CELL) + 1) for r in range(math.floor(y / cloud.CELL), math.floor((y + b.height) / cloud.CELL) + 1)}  # noqa: E731, B023
        angle = 0.0
        while cells(at := 1.6 * cloud.GROWTH * angle * math.cos(angle) - b.width / 2, cloud.GROWTH * angle * math.sin(angle) - b.height / 2) & taken:
            angle += cloud.TURN
        assert b.x == at
        taken |= cells(b.x, b.y)

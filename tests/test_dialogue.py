import pytest
from pyspark.sql import functions as F

from turnlens.operators import acts as AC
from turnlens.operators import dialogue as D
from turnlens.operators import features as FE
from turnlens.operators import text as X
from turnlens.sources.conversations import ACTS

ACT = "intent domain slot value".split()


def act(*parts):
    return dict(zip(ACT, parts))


def lines(spark, rows):
    return spark.createDataFrame(rows, f"dia_no long, label int, pos int, role string, text string, acts {ACTS}")


GREETED = [(1, 0, 0, "user", "hi", [act("greet", "general", "", "")]), (1, 0, 1, "system", "yes", []), (1, 0, 2, "user", "more", [])]
ANSWERED = [(2, 1, 0, "system", "welcome", [act("inform", "travel", "name", "x")]), (2, 1, 1, "user", "one", [act("request", "travel", "price", "")])]


def test_previous_acts(spark):
    out = {(r["dia_no"], r["turn_no"]): (r["prev_acts"][0]["intent"], r["acts"][0]["intent"]) for r in D.da_turn(lines(spark, GREETED + ANSWERED)).collect()}
    assert out == {(1, 0): ("greet", "greet"), (1, 1): ("none", "none"), (2, 0): ("inform", "request")}


def test_act_sequence(spark):
    row = spark.createDataFrame([([act("none", "", "", "")], [act("inform", "travel", "dst_city", "X"), act("request", "travel", "price", "")])], f"p {ACTS}, a {ACTS}")
    got = row.select(D.da_sequence(F.col("p"), F.col("a")), D.da_sequence(F.col("p"), F.col("a"), use_value=True, use_turn=False)).first()
    assert got[0] == "<cls> none <sep> inform <slot_sep> travel <slot_sep> dst_city <da_sep> request <slot_sep> travel <slot_sep> price <sep>"
    assert got[1] == "<cls> inform <slot_sep> travel <slot_sep> dst_city <slot_sep> X <da_sep> request <slot_sep> travel <slot_sep> price <slot_sep>  <sep>"


def test_prefixes_undo_aggregation(spark):
    rows = [(1, 0, i, "user" if i % 2 == 0 else "system", f"t{i}", [act("inform", "d", str(i), "")]) for i in range(5)]
    whole = D.agg_dialogue(D.da_turn(lines(spark, rows)))
    assert [a[0]["slot"] for a in whole.first()["masked_da"]] == ["0", "1", "2", "3", "4"]
    out = D.prefix_expand(whole).orderBy("turn_no").collect()
    assert [(len(r["masked_da"]), len(r["masked_utt"]), r["is_complete"]) for r in out] == [(1, 1, False), (3, 2, False), (5, 3, True)]
    with pytest.raises(Exception, match="do not fit"):
        D.prefix_expand(whole.withColumn("masked_da", F.slice("masked_da", 1, 2))).collect()


def test_turn_numbers(spark):
    df = spark.createDataFrame([("user: a\nsystem: user: b", None), ("system: a", None), ("x", 4)], "dia string, turn_no int")
    assert [r["turn_nos"] for r in D.fill_turn_no(df).collect()] == [[0, 1], [], [4]]


def test_masks(spark):
    one = spark.createDataFrame([(["a", "b", "c"], [[act("inform", "d", "x", ""), act("inform", "d", "y", "")], [act("none", "", "", "")], [act("bye", "d", "", "")]])], f"tok array<string>, u array<{ACTS}>")
    bits = lambda *b: F.array(*map(F.lit, b))
    got = one.select(FE.mask_apply_utt(F.col("tok"), bits(1, 0, 1)).alias("t"), FE.mask_apply_da(F.col("u"), bits(0, 0, 1)).alias("m"), FE.mask_apply_da(F.col("u"), bits(1)).alias("short")).first()
    assert got["t"] == "a <mask> c"
    assert [[a["intent"] for a in u] for u in got["m"]] == [["none"], ["none"], ["bye"]]
    assert [[a["slot"] for a in u] for u in got["short"]] == [["x"], [""], [""]]


def test_act_parsers(spark):
    texts = ["[inform][hotel]([area][west],[stars][4]);[request][hotel]([phone][])", "[broken]([a][b]);[bye][general]([][])", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(AC.parse_da_serial(F.col("t")).alias("a")).collect()
    assert [[tuple(a) for a in r["a"]] for r in got] == [[("inform", "hotel", "area", "west"), ("inform", "hotel", "stars", "4"), ("request", "hotel", "phone", "")], [("bye", "general", "", "")], []]
    raw = spark.createDataFrame([('x <DA>[["a","b","c","d"]]</DA>',), ("<DA>oops</DA>",), ("none",), (None,)], "t string").select(AC.parse_da_json(F.col("t")).alias("a")).collect()
    assert [r["a"] for r in raw] == [[["a", "b", "c", "d"]], [], [], []]
    masked = spark.createDataFrame([([act("inform", "hotel", "phone", "123"), act("request", "hotel", "phone", "")],)], f"a {ACTS}").select(AC.mask_sensitive_slot(F.col("a")).alias("a")).first()["a"]
    assert [a["value"] for a in masked] == ["[phone]", ""]


KNOWN = AC.Ontology(frozenset({"inform", "request", "greet", "book", "reqmore"}), frozenset({"travel", "general"}), {"count": (), "amenities": ("True", "False"), "vicinity": ("True",), "beach": ("True",), "seat": ("business",), "price": (), "gst_rating": (), "n_children": ()})


@pytest.mark.parametrize("said,given,want", [
    ("usr", [["confirm", "travel", "price", "9"]], [["inform", "travel", "price", "9"]]),
    ("usr", [["confirm", "travel", "price", ""], ["sorry", "travel", "", ""]], []),
    ("usr", [["greet", "", "", ""], ["greet"]], [["greet", "general", "", ""], ["greet", "general", "", ""]]),
    ("sys says", [["inform", "travel", "choice", "3"]], [["inform", "travel", "count", "3"]]),
    ("usr", [["request", "travel", "info", "price"], ["request", "travel", "details", ""]], [["request", "travel", "price", ""], ["reqmore", "travel", "", ""]]),
    ("book it", [["inform", "travel", "confirmation", ""], ["inform", "travel", "booking", "x"]], [["book", "travel", "", ""], ["book", "travel", "", ""]]),
    ("usr", [["inform", "travel", "confirmation", ""], ["inform", "travel", "weather", ""], ["inform", "travel", "intent", ""]], []),
    ("usr", [["inform", "travel", "class", "business"], ["inform", "travel", "rating", "4"]], [["inform", "travel", "seat", "business"], ["inform", "travel", "gst_rating", "4"]]),
    ("usr", [["inform", "travel", "location", "beach house"]], [["inform", "travel", "beach", "True"]]),
    ("usr", [["inform", "travel", "amenities", "some"], ["inform", "travel", "amenities", "no pool"]], [["inform", "travel", "amenities", "True"], ["inform", "travel", "amenities", "False"]]),
    ("usr", [["greet", "travel", "seat", "you"]], [["greet", "travel", "", ""]]),
    ("usr", [["sorry", "travel", "", ""], ["inform", "travel", "unheard", ""], ["confirm", "travel", "price", "1"]], [["sorry", "travel", "", ""], ["inform", "travel", "unheard", ""], ["confirm", "travel", "price", "1"]]),
])
def test_repairs(said, given, want):
    assert AC.fixed(said, given, KNOWN) == want


def test_texts(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c).first()[0]
    t = F.col("t")
    assert one(X.parse_utterance(t, "user"), "so\nuser:hello\nthere ‘x’") == "user: hello there 'x'"
    assert one(X.parse_utterance(t, "user"), "user: a system: b") is None and one(X.parse_utterance(t, "user"), "user: a user: b") is None and one(X.parse_utterance(t, "user"), "user: 日本") is None
    assert one(X.strip_end(t)[0], "bye [END]") == "bye" and one(X.strip_end(t)[1], "bye *stop*") and not one(X.strip_end(t)[1], "the end")
    assert one(X.collapse_lines(t), "user: a\n  b\nsystem: c\nd") == "user: a b\nsystem: c d"
    assert one(X.parse_goal(t)[0], "<THINK>..</THINK><GOAL> g1\n</GOAL><OUTCOME>o</OUTCOME><ALT_GOAL>g2</ALT_GOAL>") == ["g1", "g2"]
    assert one(X.parse_goal(t)[0], "<GOAL>g</GOAL><OUTCOME>o</OUTCOME>") is None
    assert one(X.parse_admin(t), "<goal> 3 </goal>") == 3 and one(X.parse_admin(t), "<goal>x</goal>") is None
    assert one(X.mask_validate(F.lit("a\nb"), t), "c\nd") == "c\nd" and one(X.mask_validate(F.lit("a\nb"), t), "c") == "a\nb"
    rows = spark.createDataFrame([(1, i, w) for i, w in enumerate("Dr . Who came . he left ? Now !".split())], "k int, idx int, token string")
    assert [r["sentence"] for r in X.sentences(rows, ["k"]).orderBy("idx").collect()] == [1, 1, 1, 1, 1, 1, 1, 1, 2, 2]


def test_samples_and_unions(spark):
    df = spark.createDataFrame([(i, j) for i in range(30) for j in range(3)], "dia_no long, variant int")
    one = D.sample_one_per_key(df, "dia_no", "variant")
    assert one.count() == 30 and sorted(map(tuple, one.collect())) == sorted(map(tuple, D.sample_one_per_key(df.repartition(5), "dia_no", "variant").collect()))
    both = D.union_datasets_offset(one.select("dia_no"), one.select("dia_no"))
    assert both.select("dia_no").distinct().count() == 60
    pairs = D.negatives_random_pair(spark.range(500).withColumn("t", F.col("id")), ["id"], "t")
    assert pairs.where("t = negative").count() == 0 and pairs.count() > 450
    ids, mask = D.encode(F.lit("a b c"), 5)
    got = spark.range(1).select(ids.alias("i"), mask.alias("m")).first()
    assert got["m"] == [1, 1, 1, 0, 0] and len(got["i"]) == 5

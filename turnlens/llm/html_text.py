"""Main text of HTML pages: flat text blocks, judged by a decision tree on word counts and link density of neighbours.

A page falls into a flat sequence of blocks, the texts between tags that are not inline. A block has its number of words, its
link density (share of its words inside links), whether it is a heading or a paragraph, and what its open elements say of
themselves: part of the article, or of what surrounds it. The tree sees these together with the word count and link density of
the block before and the block after. It is grown (Gini impurity) on ``LABELLED``, a small table of blocks of invented pages
of several layouts, in the driver, within milliseconds; it then runs over the blocks as one expression of the plan.

Python only cuts a page into blocks, page by page; neighbours, tree and joining are expressions. No shuffle.

Defined cases: null and empty html give an empty text; unclosed and misplaced tags end where the next enclosing element
ends; a tag or comment that never ends hides the rest, as in browsers; "<" before anything but a letter, "/", "!" or "?" is
text; unknown character references stay as they are; repeated rows and null ids are extracted row by row; very long pages are
read whole; an empty table gives no rows; extra columns are ignored. White space is what Unicode calls so.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Elements whose content is no text of the page.
RAW = "script|style|title|textarea|iframe|noembed|noframes|xmp|template|svg|math|object|canvas|audio|video|select"
#: A tag (slash, name, attributes), such an element as a whole, a comment, a declaration, or a tag with a quote that never ends.
MARKUP = re.compile(
    rf"<(?:({RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:(?<=/)>|>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z))|(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|/[^a-z>][^>]*(?:>|\Z)|(/?)([a-z][^\s/>]*+)([^>]*)(?:>|\Z))",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Fixed values of HTML: elements that do not end a block, that have no content, and those that the same element ends.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HEADINGS, PARAGRAPHS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("p pre blockquote".split())
LEAVES = HEADINGS | PARAGRAPHS

#: What elements, roles and class names say. Class names are taken apart at what is no letter.
AROUND = frozenset("nav footer aside form menu dialog button fieldset noscript".split())
AROUND_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs masthead topbar footer sidebar aside widget widgets related "
    "recommended recommendations share sharing social newsletter subscribe subscription signup login cookie cookies consent gdpr notice notices alert popup modal overlay paywall comment comments commentlist reply replies "
    "responses discussion disqus respond form search pagination pager copyright legal disclaimer toolbar skip hidden".split()
)
MAIN, MAIN_WORDS = frozenset(("article", "main")), frozenset("article main content post entry story".split())
AROUND_ROLES, MAIN_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split()), frozenset(("main", "article"))
#: A class name that begins so speaks of another element.
OTHERS = frozenset("no has with without".split())

BLOCK = "text string, words int, links int, heading int, para int, around int, main int"


@lru_cache(maxsize=4096)
def _says(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element stands around the article, and whether it is the article. ``inside``: it lies in the article."""
    around, main = name in AROUND or (name == "header" and not inside), name in MAIN
    if attributes and not name.startswith(("html", "body")):
        for found in ATTRIBUTE.finditer(attributes):
            key, value = found[1].lower(), (found[2] or found[3] or found[4] or "").lower()
            if key in ("class", "id"):
                for one in value.split():
                    parts = re.findall("[a-z]+", one)
                    if parts and parts[0] not in OTHERS:
                        around |= not AROUND_WORDS.isdisjoint(parts) or ("header" in parts and not inside)
                        main |= not MAIN_WORDS.isdisjoint(parts)
            elif key == "role":
                around, main = around | (value in AROUND_ROLES), main | (value in MAIN_ROLES)
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                around = True
    return around, main and name not in AROUND


def blocks(page: str) -> list[tuple]:
    """The page's blocks in order, as rows of ``BLOCK``. Only whether any element says so is kept of those that are open."""
    out, texts, linked, links = [], [], False, 0
    stack: list[tuple[str, bool, bool]] = [("", False, False)]  # name, around, main, each with what encloses it
    open_: Counter[str] = Counter()  # how many of each name the stack holds
    leaf, leaf_around = "", False  # the open heading or paragraph, which any block ends

    def flush() -> None:
        nonlocal links
        if not texts:
            return
        text = " ".join("".join(texts).split())
        if text:
            _, around, main = stack[-1]
            words = text.count(" ") + 1
            out.append((text, words, min(links, words), int(leaf in HEADINGS), int(leaf in PARAGRAPHS), int(around or leaf_around), int(main)))
        texts.clear()
        links = 0

    def put(piece: str) -> None:
        nonlocal links
        piece = html.unescape(piece) if "&" in piece else piece
        texts.append(piece)
        if linked:
            links += len(piece.split())

    at = 0
    for m in MARKUP.finditer(page):
        if at < m.start():
            put(page[at : m.start()])
        at = m.end()
        _, slash, name, attributes, slash_, name_, attributes_ = m.groups()
        if name is None:
            if name_ is None:  # no tag, or an element without text of the page
                continue
            slash, name, attributes = slash_, name_, attributes_
        name = name.lower()
        if name in INLINE:
            if name == "a":
                linked = not slash
            elif name == "br":
                texts.append(" ")
            continue
        flush()
        if name in LEAVES:
            leaf, leaf_around = ("", False) if slash else (name, bool(attributes) and _says(name, attributes, stack[-1][2])[0])
            continue
        leaf, leaf_around = "", False
        if name in VOID:
            continue
        if slash:
            while open_[name]:  # ends what it encloses, too
                open_[stack[-1][0]] -= 1
                if stack.pop()[0] == name:
                    break
        else:
            while stack[-1][0] in SAME.get(name, ()):
                open_[stack.pop()[0]] -= 1
            open_[name] += 1
            around, main = _says(name, attributes, stack[-1][2])
            stack.append((name, around or stack[-1][1], main or stack[-1][2]))
        linked = linked and not slash
    put(page[at:])
    flush()
    return out


#: The labelled table: pages of invented layouts, a line for each block: its open elements (with their class after a dot), how many
#: words it has and how many of them in links, and whether it belongs to the main text (+) or not (-).
LABELLED = """
nav ul li 1/1 -
nav ul li 2/2 -
nav ul li 1/1 -
div.ad 9/0 -
article h1 8/0 +
article p 70/0 +
article p 1/0 +
article p 2/1 +
article p 140/3 +
footer 8/0 -

header h1 3/3 -
header p 6/0 -
nav a 1/1 -
main h1 6/0 +
main p 1/0 +
main p 40/1 +
main div.ad p 25/2 -
main p 30/0 +
main ul li 4/0 +
main ul li 3/3 +
main section.comments h2 1/0 -
main section.comments p 45/0 -
aside h3 2/0 -
aside p 30/0 -
footer p 12/3 -

div.cookie p 35/2 -
div.menu a 1/1 -
div.menu a 2/2 -
div.content h1 5/0 +
div.content p 55/2 +
div.content p 3/0 +
div.content p 6/6 +
div.sidebar p 22/1 -
div.sidebar li 4/4 -
form label 3/0 -
form p 12/0 -
div.footer 10/2 -

div a 1/1 -
div a 1/1 -
div span 2/2 -
h1 7/0 +
p 44/0 +
p 18/0 +
p 2/0 +
p 61/4 +
p 1/0 +
p 33/0 +
div a 3/3 -
div a 2/2 -
div 5/0 -

table tr td a 1/1 -
table tr td a 2/2 -
h2 4/0 +
div 52/0 +
div 38/2 +
div 80/1 +
div 29/0 +
div 4/4 -
div 3/3 -
div 6/0 -

article header h1 6/0 +
article header p 4/0 +
article p 5/5 +
article p 1/0 +
article ul li 2/2 +
article ul li 4/4 +
article p 2/0 +
article p 20/11 +
article div 1/0 +
article div 3/3 +
article div 17/0 +
article td 1/1 +
article blockquote 20/0 +
article p 12/12 +
article h2 3/0 +
article p 90/0 +
article pre 5/0 +
article footer 5/1 -
div.comments article.comment p 40/0 -
div.comments article.comment p 3/0 -
div.related a 6/6 -
div 4/0 -
p 14/0 -
p 60/0 -

p.notice 16/0 -
p.advert 30/1 -
div.post p 1/0 +
div.post p 26/0 +
div.post h3 2/0 +
div.post div 9/0 +
div.newsletter p 19/0 -
div 3/0 -
div 30/0 -

h1 4/0 +
p 12/0 +
p 1/0 +
p 50/0 +
p 8/0 +

div 41/0 +
div 66/1 +
div 24/0 +

a 1/1 -
a 1/1 -
h1 5/0 +
p 3/0 +
p 9/9 -
p 77/6 +
p 2/0 +

div 2/0 -
div 4/3 -
p 34/0 +
p 6/0 +
div 3/0 -
div 6/1 -

h1 9/0 +
p 6/0 +
p 2/0 +
p 1/0 +
ul li 2/2 -
ul li 1/1 -
ul li 3/3 -

table tr td 95/0 +
table tr td 31/2 +
table tr td 3/3 -
p 1/0 +

ul li 1/1 -
ul li 1/1 -
p 48/1 +
ul li 6/0 +
ul li 11/0 +
ul li 9/4 +
p 21/0 +
div 2/0 -

article h1 5/0 +
article p 12/0 +
article p 7/0 +

article p 2/0 +
article p 1/0 +
article div 2/0 +
article div 3/0 +

main div 1/0 +
main div 4/4 +
main div 4/0 +
main div 1/0 +
main div 1/1 +

article div 1/0 +

article span 3/0 +
div 4/0 -

main div 12/0 +
main li 2/2 +
main div 5/0 +

article p 25/0 +
article p 4/0 +
article p 9/0 +

main h1 3/0 +
main div 20/0 +
main div 5/0 +

h1 3/0 +
p 11/0 +
p 9/0 +
p 4/0 +

p 100/0 +

div 120/0 +

p 7/0 +
p 16/0 +

div 5/0 -
p 26/0 +
p 15/0 +
div 8/0 -
"""


def _example(lines: list[str]) -> tuple[str, list[int]]:
    """The html of one labelled page and the labels of its blocks."""
    out, labels = [], []
    for line in lines:
        *path, size, label = line.split()
        words, links = map(int, size.split("/"))
        opened = [(e.partition(".")[0], e.partition(".")[2]) for e in path if e != "a"]
        text = " ".join(["word"] * (words - links)) + (f" <a href=''>{' '.join(['link'] * links)}</a>" if links else "")
        out.append("".join(f'<{e} class="{c}">' if c else f"<{e}>" for e, c in opened) + text + "".join(f"</{e}>" for e, _ in reversed(opened)) + "<hr>")
        labels.append(int(label == "+"))
    return "<html><body>" + "".join(out) + "</body></html>", labels


#: What the tree sees of a block, in order.
FEATURES = ("around", "place", "density", "words", "density_before", "words_before", "density_after", "words_after", "para", "heading")


def features(own: list[tuple]) -> np.ndarray:
    """The features of a page's blocks. ``place``: 2 in the article, 0 beside an article, 1 where the page names none."""
    if not own:
        return np.empty((0, len(FEATURES)))
    words, links, heading, para, around, main = (np.array(c, float) for c in list(zip(*own))[1:])
    density = links / words
    before, after = (lambda c: np.concatenate([[0], c[:-1]])), (lambda c: np.concatenate([c[1:], [0]]))
    place = np.where(main > 0, 2.0, 0.0 if (main * (1 - around)).any() else 1.0)
    return np.stack([around, place, density, words, before(density), before(words), after(density), after(words), para, heading], axis=1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2):
    """A decision tree by Gini impurity: a label, or (feature, threshold, below or equal, above). Ties go to the first feature."""
    best, whole = None, y.mean() * (1 - y.mean()) * len(y)
    if depth and 0 < y.mean() < 1:
        for f in range(x.shape[1]):
            for cut in (values := np.unique(x[:, f]))[:-1]:
                low = x[:, f] <= cut
                a, b = y[low], y[~low]
                left = a.mean() * (1 - a.mean()) * len(a) + b.mean() * (1 - b.mean()) * len(b)
                if min(len(a), len(b)) >= least and left < whole - 1e-9 and (best is None or left < best[0] - 1e-9):
                    best = (left, f, float(cut + values[np.searchsorted(values, cut) + 1]) / 2, low)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, cut, low = best
    return (f, cut, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def decide(tree, row) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def train(labelled: str = LABELLED):
    """The tree of a labelled table."""
    xs, ys = [], []
    for page in labelled.strip().split("\n\n"):
        source, labels = _example(page.splitlines())
        own = blocks(source)
        if len(own) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(own)} blocks")
        xs.append(features(own))
        ys.append(labels)
    return grow(np.concatenate(xs), np.concatenate(ys).astype(float))


def _expression(tree, x: list[Column]) -> Column:
    if isinstance(tree, int):
        return F.lit(bool(tree))
    f, cut, low, high = tree
    return F.when(x[f] <= cut, _expression(low, x)).otherwise(_expression(high, x))


def _judged(own: Column, tree) -> Column:
    """The blocks that the tree keeps."""
    named = F.exists(own, lambda b: (b["main"] == 1) & (b["around"] == 0))
    size = lambda b: F.coalesce(b["words"].cast("double"), F.lit(0.0))
    density = lambda b: F.coalesce(b["links"] / b["words"], F.lit(0.0))

    def keep(b: Column, i: Column) -> Column:
        before, after = F.get(own, i - 1), F.get(own, i + 1)
        place = F.when(b["main"] == 1, 2).when(named, 0).otherwise(1)
        return _expression(tree, [b["around"], place, density(b), size(b), density(before), size(before), density(after), size(after), b["para"], b["heading"]])

    return F.filter(own, keep)


def extract(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "url"), tree=None) -> DataFrame:
    """One row per page: the given columns, text (main blocks, joined by line feeds) and n_blocks (all blocks of the page)."""
    rows = pages.select(*[pages[c] for c in columns], F.coalesce(pages["html"], F.lit("")).alias("html"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    entry = pa.struct([(n, pa.string() if t == "string" else pa.int32()) for n, t in (f.split() for f in BLOCK.split(", "))])
    names = [f.name for f in entry]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                own = [[dict(zip(names, b)) for b in blocks(page)] for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(own, pa.list_(entry))], [*columns, "_blocks"])

    found = rows.mapInArrow(cut, f"{kinds}, _blocks array<struct<{', '.join(f'{n}: {t}' for n, t in (f.split() for f in BLOCK.split(', ')))}>>")
    kept = _judged(F.col("_blocks"), train() if tree is None else tree)
    return found.select(*columns, F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"), F.size("_blocks").alias("n_blocks"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: All pages of the test tables hold their main text in one article element of headings and paragraphs, which SQL can cut out.
ORACLE = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '') AS h FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(h, '</?(?:h1|p)>'), lambda x: trim(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g'))) AS bs FROM a),
c AS (SELECT page_id, url, list_transform(bs, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS bs FROM b),
t AS (SELECT page_id, url, array_to_string(list_filter(bs, lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""

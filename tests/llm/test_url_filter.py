import random
import re

from turnlens.llm import url_filter as U
from turnlens.llm.oracle import _glob


def test_the_automaton_matches_like_regular_expressions():
    r = random.Random(1)
    globs = ["", "*", "**", "a*b", "a**b", "?", "*.x/**", "x/é?", "**/a/**", "ab" * 40, "a?*b**c", "***"]
    globs += ["".join(r.choice(["a", "b", "/", "*", "**", "?", "."]) for _ in range(r.randrange(1, 9))) for _ in range(60)]
    texts = ["", "a", "ab", "a/b", "x/éz", "q.x/r", "ab" * 40, "ab" * 3000, "日本/a/é"] + ["".join(r.choice("ab/.x") for _ in range(r.randrange(12))) for _ in range(200)]
    got = U.Automaton.of(globs).match(texts)
    for j, g in enumerate(globs):
        for i, t in enumerate(texts):
            assert got[i, j] == bool(re.fullmatch(_glob(g)[1:-1], t, re.S)), (g, t)


def judged(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(v, r) for v, r in U.RULES for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return (host, path, *max(fits, key=lambda x: len(x[1]))[::-1])
    return host, path, None, "block" if any(re.fullmatch(_glob(g)[1:-1], host + path, re.S) for g in U.GLOBS) else "allow"


def test_rows(spark):
    urls = [None, "", "no scheme", "http://", "http://ORG/x", "https://a.org/", "https://a.org", "http://example.org/es/1", "http://EN.example.org/en/17", "http://badexample.org/es/", "x://shop.com/fr/a?b#c", "x://com/de/", "x://com.de/fr/", "http://evil.net/a.com/fr/x", "http://a.com#/fr/", "http://ads.site.net/x", "http://q.net/f.exe", "http://q.net/a/login/b", "http://é.ÄB.com/fr/ü", "http://a.org:80/x", "a\nhttp://x.org/y\nz", "http://a.com/fr/?://b.com/de/", "http://x.net/" + "a" * 50_000]
    pages = spark.createDataFrame([(i, u, "<html>", 1) for i, u in enumerate([*urls, *urls])], "page_id long, url string, html string, verdict int")
    out = U.judge(pages).toPandas().sort_values("page_id")
    assert [(*x,) for x in out[["host", "path", "rule", "verdict"]].astype(object).where(lambda d: d.notna(), None).to_numpy().tolist()] == [judged(u) for u in [*urls, *urls]]
    assert U.judge(pages.where("false")).count() == 0


def test_long_urls_go_on_one_by_one(spark, monkeypatch):
    import random

    r = random.Random(3)
    texts = ["ads.x.net/" + "".join(r.choice("ab/.") for _ in range(n)) + tail for n in (0, 3, 40, 5000, 70_000) for tail in (".exe", "/wp-login.php?", "z")]
    machine = U.Automaton.of(("ads.*/**", "**.exe", "**/wp-login.php**", "*.net/?*", "a" * 70 + "*b"))
    one = machine.match(texts)
    monkeypatch.setattr(U, "FEW", 0)
    assert (machine.match(texts) == one).all() and one[:, 0].all() and one[:, 1].sum() == 5
    rows = [(i, f"http://{t}") for i, t in enumerate(texts * 3)]
    monkeypatch.setattr(U, "PART_BYTES", 1000)
    out = U.judge(spark.createDataFrame(rows, "page_id long, url string")).toPandas()
    assert len(out) == 45 and (out["verdict"] == "block").all()

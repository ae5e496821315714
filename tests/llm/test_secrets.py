import hashlib
import re

from turnlens.llm import secrets as S

from .conftest import messy_rows

KEY, SECRET = "AKIA" + "Q7" * 8, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
TEXTS = [
    f"id {KEY} and {SECRET} at https://s3.host.net/b?x", SECRET + " alone", "see https://plain.host.net/x", "user: someone wrote it",
    f"user: someone, password = 'abcdefghijkl12' on https://db.host.net/", "password: token: abcdefghijklmnop", "API-KEY api_key=\"0123456789abcdef0123\" apikey: short", "Ünï é " + KEY + " 日本 deadbeefdeadbeefdead",
    "token=" + "z" * 4000, KEY + " " * 600 + SECRET, "secret:" + "deadbeef" * 3 + KEY, "AKIASHORT AKIA deadbeef", "PassWord=AAAAAAAAAAAAAAAA;TOKEN : bbbbbbbbbbbbbbbbbb", f"{KEY}" * 3,
]


def matches(text):
    """(start, kind, end) of every kind, by the contract's rules."""
    for i, (_, pattern, group, least) in enumerate((*S.BASE, *S.WEAK)):
        for m in re.finditer(pattern, text, re.A):
            if len(m[group]) >= least:
                yield m.start(), i, m.end()


def brute(text):
    every = list(matches(text or ""))
    base = [x for x in every if x[1] < 3]
    near = lambda a, kinds: any(S.ORDER[b[1]] in kinds and (b[0] >= a[2] or b[2] <= a[0]) and b[0] - a[2] <= S.SCOPE and a[0] - b[2] <= S.SCOPE for b in every)
    open_ = [a for a in every if a[1] >= 3 and not any(b[0] < a[2] and a[0] < b[2] for b in base)]
    need = {"identity": [S.SECRET], "random": [S.IDENTITY], "endpoint": [S.IDENTITY, S.SECRET]}
    linked = [a for a in open_ if all(near(a, k) for k in need[S.ORDER[a[1]]])]
    put = lambda xs: ",".join(f"{S.ORDER[k]}:{s}:{e}" for s, k, e in sorted(xs))
    return (*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(put(base).encode()).hexdigest(), put(base + linked))


def test_against_brute_force(spark, nothing):
    docs = [(i, t) for i, t, *_ in messy_rows()] + [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(1000, TEXTS[0]), (2000, " ".join(TEXTS * 40))]
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in docs], "doc_id long, text string, rid int, kind int, start int").repartition(3)
    out = S.scan(df).toPandas()
    got = sorted(map(tuple, out[["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]].to_numpy().tolist()))
    assert got == sorted((i, *brute(t)) for i, t in docs)
    assert S.scan(nothing).count() == 0
    one = out[out["doc_id"] == 1000].iloc[0]
    assert one["n_linked"] == 2 and "random" in one["spans"] and "endpoint" in one["spans"]
    assert (out[out["doc_id"].isin([1001, 1002, 1003])]["n_linked"] == 0).all()


def test_the_base_patterns_are_the_contracts():
    raw = [(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16)]
    for text in [*TEXTS, *(t or "" for _, t, *_ in messy_rows())]:
        want = [(m.start(), i, m.end()) for i, (p, g, n) in enumerate(raw) for m in re.finditer(p, text, re.A | (re.I if i == 0 else 0)) if len(m[g]) >= n]
        assert sorted(want) == sorted(x for x in matches(text) if x[1] < 3)

"""URL filtering by a bit-parallel wildcard automaton.

All globs are packed into one row of bits over several 64-bit words. A glob of m symbols owns m + 1 bits; bit i is set
while its first i symbols have matched. One step reads one character of every URL of a batch at once: states shift by
one and are masked by the character's symbols (Shift-And), and states in front of a wildcard also stay. Globs: ``?`` is
any one character, ``*`` any run without ``/``, ``**`` any run. The automaton reads the canonical URL: host, then path.

Defined cases: a null URL or one without ``://`` has empty host and path and is judged as the empty string; an empty
table gives no rows; repeated rows are judged alike; of rules that fit the longest wins, and no two are equally long; extra
columns are ignored; URLs may have any length: a task holds a bounded number of bytes, one URL at least.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Texts that go on one by one once no more are left, and bytes of paths that a task looks at together.
FEW, PART_BYTES = 8, 4 << 20
#: Fixed values of the contract: verdict and rule (host, then path prefix).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The operator's own globs, for URLs that no rule fits; what no glob matches is allowed.
GLOBS = ("ads.*/**", "*.ads.*/**", "track.*/**", "*.track.*/**", "**/wp-login.php**", "**/cgi-bin/**", "**/login/**", "**/logout/**", "**/signin/**", "**.exe", "**.zip", "**.apk", "**.dmg")


@dataclass(frozen=True)
class Automaton:
    globs: tuple[str, ...]
    symbols: np.ndarray  # code points that occur in globs, sorted
    on: np.ndarray  # [symbol or other][word]: bits that a character may enter
    stay: np.ndarray  # [0: "/", 1: else][word]: bits that a character leaves set
    start: np.ndarray
    final: list[tuple[int, np.uint64]]

    @staticmethod
    def of(globs) -> "Automaton":
        parsed = []
        for g in globs:
            literals, loops, i = [], {}, 0
            while i < len(g):
                if g[i] == "*":
                    wide = g[i : i + 2] == "**"
                    loops[len(literals)] = loops.get(len(literals), False) or wide
                    i += 2 if wide else 1
                else:
                    literals.append(g[i])
                    i += 1
            parsed.append((literals, loops))
        symbols = np.array(sorted({ord(c) for lit, _ in parsed for c in lit if c != "?"} | {ord("/")}), np.uint32)
        at = {int(c): i for i, c in enumerate(symbols)}
        n = -(-(sum(len(lit) + 1 for lit, _ in parsed) or 1) // 64)
        on, stay, start = np.zeros((len(symbols) + 1, n), np.uint64), np.zeros((2, n), np.uint64), np.zeros(n, np.uint64)
        final, base = [], 0
        put = lambda row, b: row.__setitem__(b // 64, row[b // 64] | np.uint64(1 << b % 64))
        for literals, loops in parsed:
            put(start, base)
            for i, c in enumerate(literals):
                for row in range(len(symbols) + 1) if c == "?" else (at[ord(c)],):
                    put(on[row], base + i + 1)
            for i, wide in loops.items():
                put(stay[1], base + i)
                if wide:
                    put(stay[0], base + i)
            end = base + len(literals)
            final.append((end // 64, np.uint64(1 << end % 64)))
            base = end + 1
        return Automaton(tuple(globs), symbols, on, stay, start, final)

    def _alone(self, state: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """One text's state after the symbols of ``rows``."""
        whole = lambda words: int.from_bytes(words.astype("<u8").tobytes(), "little")
        slash = int(np.searchsorted(self.symbols, ord("/")))
        on, stay, s = [whole(r) for r in self.on], [whole(r) for r in self.stay], whole(state)
        for r in rows.tolist():
            s = s << 1 & on[r] | s & stay[r != slash]
        return np.frombuffer((s & (1 << 64 * len(state)) - 1).to_bytes(8 * len(state), "little"), "<u8").astype(np.uint64)

    def match(self, texts: list[str]) -> np.ndarray:
        """[text][glob]: whether the glob matches the whole text."""
        out = np.zeros((len(texts), len(self.globs)), bool)
        order = np.argsort([-len(t) for t in texts], kind="stable")
        length = np.array([len(texts[i]) for i in order], np.int64)
        code = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        where = np.searchsorted(self.symbols, code).clip(max=len(self.symbols) - 1)
        row = np.where(self.symbols[where] == code, where, len(self.symbols)).astype(np.int32)
        slash = (code != ord("/")).astype(np.int8)
        first = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
        state = np.tile(self.start, (len(texts), 1))
        live = int((length > 0).sum())
        for step in range(int(length.max(initial=0))):
            while live and length[live - 1] <= step:
                live -= 1
            if live <= FEW:  # long texts that are left go on one by one, with all words of their bits in one number
                for i in range(live):
                    state[i] = self._alone(state[i], row[first[i] + step : first[i] + length[i]])
                break
            s, at = state[:live], first[:live] + step
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.on[row[at]]) | (s & self.stay[slash[at]])
        for g, (word, bit) in enumerate(self.final):
            out[order, g] = (state[:, word] & bit) != 0
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def literal(text: str) -> str:
    if set(text) & set("*?"):
        raise ValueError(f"a rule is no glob: {text}")
    return text


def judge(pages: DataFrame, rules=RULES, globs=GLOBS, otherwise: str = "allow", at_once: int = 4096) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, glob (the operator's own glob that decided, else null).

    A rule fits its host and all subdomains where the path starts with the rule's; of those that fit, the longest
    decides. Where none fits, a glob that matches blocks, and else ``otherwise`` holds.
    """
    patterns = [f"{p}{literal(r)}**" for _, r in rules for p in ("", "*.")] + list(globs)
    machine = Automaton.of(patterns)
    rank = sorted(range(len(rules)), key=lambda i: len(rules[i][1]))

    def run(batches):
        for batch in batches:
            for part in (few.slice(low, at_once) for few in slices(batch, "path", PART_BYTES) for low in range(0, few.num_rows, at_once)):
                host, path = part.column("host").to_pylist(), part.column("path").to_pylist()
                hit = machine.match([h + p for h, p in zip(host, path)])
                rule, verdict, glob = np.full(len(host), None, object), np.full(len(host), otherwise, object), np.full(len(host), None, object)
                for g in range(len(globs) - 1, -1, -1):
                    own = hit[:, 2 * len(rules) + g]
                    verdict[own], glob[own] = "block", globs[g]
                for i in rank:
                    own = hit[:, 2 * i] | hit[:, 2 * i + 1]
                    rule[own], verdict[own], glob[own] = rules[i][1], rules[i][0], None
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("host"), part.column("path"), *(pa.array(x, pa.string()) for x in (rule, verdict, glob))], ["page_id", "host", "path", "rule", "verdict", "glob"])

    cut = pages.select(pages["page_id"], host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    return cut.mapInArrow(run, f"page_id {dict(cut.dtypes)['page_id']}, host string, path string, rule string, verdict string, glob string")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))

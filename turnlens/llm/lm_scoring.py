"""Language-model scores by a hidden Markov model.

Every word of the training documents is counted, by its 64-bit hash, in a table that grows with the corpus. The most
frequent words, chosen from those counts, are symbols of their own; all other words belong to one of ``CLASSES`` classes
by their hash, and a class is a symbol. Baum-Welch expectation runs on every partition of the training documents, the
expected counts are summed over all of them, and the maximisation of the small tables is the driver's. Scores are exact: the
scaled forward recursion gives log P of the symbols, and a word of a class then has its own share (c + 1) / (N + V + 1) of the
class, where c is its exact count, N and V the class's tokens and types in training and one type stands for all unseen words.
That share does not depend on the state, so it factors out of the recursion, and only sums of log(c + 1) per document have to
meet the table of counts; no table of words is ever collected but that of the symbols, whose number bounds what a task holds.

Baum-Welch starts from the whole corpus: how often any two of the ``USUAL`` most frequent words share a document is summed
over all training documents; states start at the words whose company differs most. Every round covers all training
documents and whole texts; rounds end when one raises the log-likelihood by a share below ``GAIN``.

Defined cases: a null or empty text is one end; repeated rows count and score as rows; ties are broken by hashes of words,
so that neither the order of rows nor their partitions matter (but for rounding); very long texts are read whole; without
training documents all words are unknown and the model falls back to even shares; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_table, collected, held_out, most_frequent, slices, table, word_hashes, words_of

#: Words that are symbols of their own, and classes of all others (a power of two).
STATES, VOCABULARY, CLASSES = 8, 1 << 17, 1 << 15
#: Baum-Welch ends with the first round whose log-likelihood is better by a smaller share than this, or with so many rounds.
GAIN, ROUNDS = 1e-3, 100
#: Words whose company tells where states start.
USUAL = 256
#: Weight of the unigram shares in every state's emissions, in tokens; tokens that a task recurses over at once.
PRIOR, AT_ONCE = 200.0, 1 << 18
#: Input partitions whose expected counts one task adds up.
TOGETHER = 4
END = 0  # the first symbol; classes follow, then words of the vocabulary
BLANK = byte_table()


@dataclass
class Hmm:
    start: np.ndarray  # [state]
    move: np.ndarray  # [state][state]
    emit: np.ndarray  # [symbol][state]


def lined_up(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols step by step over all sequences, longest first; where each step begins; the sequences' order."""
    length = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-length, kind="stable")
    alive = np.searchsorted(-length[order], -np.arange(1, length.max() + 1), "right")
    at = np.concatenate([[0], np.cumsum(alive)])
    flat = np.empty(at[-1], np.int64)
    for rank, i in enumerate(order):
        flat[at[: length[i]] + rank] = sequences[i]
    return flat, at, order


def runs(at: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of steps that have equally many sequences: where each begins and ends among the symbols, and its steps."""
    alive = np.diff(at)
    first = np.concatenate([[0], np.flatnonzero(np.diff(alive)) + 1, [len(alive)]])
    return [(int(at[i]), int(at[j]), int(j - i)) for i, j in zip(first[:-1], first[1:])]


def forward(model: Hmm, flat: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Scaled forward variables of each run, [step][state][sequence]; scales of all symbols; each run's emissions. A step's
    values lie together, so that each operation is one pass over them."""
    states, move, by_state = len(model.start), np.ascontiguousarray(model.move.T), np.ascontiguousarray(model.emit.T)
    one, scale, alphas, emits, before = np.ones(states), np.empty(len(flat)), [], [], None
    for low, high, steps in runs(at):
        symbols = flat[low:high].reshape(steps, -1)
        emit = np.empty((steps, states, symbols.shape[1]))
        for k in range(states):
            emit[:, k] = by_state[k][symbols]
        alpha, scales = np.empty_like(emit), scale[low:high].reshape(steps, -1)
        for e, a, c in zip(emit, alpha, scales):
            if before is None:
                a[:] = model.start[:, None]
            else:
                np.matmul(move, before if before.shape == a.shape else before[:, : a.shape[1]], out=a)
            a *= e
            np.dot(one, a, out=c)
            a /= c
            before = a
        alphas.append(alpha)
        emits.append(emit)
    return alphas, scale, emits


def likelihood(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of each sequence's probability."""
    flat, at, order = lined_up(sequences)
    _, scale, _ = forward(model, flat, at)
    rank = np.arange(len(flat)) - np.repeat(at[:-1], np.diff(at))
    out = np.empty(len(sequences))
    out[order] = np.bincount(rank, weights=np.log10(scale), minlength=len(sequences))
    return out


class Expected:
    """Expected counts of Baum-Welch."""

    def __init__(self, states: int, symbols: int):
        self.start, self.move, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))
        self.log = 0.0  # log-likelihood of what was added, under the model that it was added with

    def add(self, model: Hmm, sequences: list[np.ndarray]) -> None:
        flat, at, _ = lined_up(sequences)
        alphas, scale, emits = forward(model, flat, at)
        self.log += np.log(scale).sum()
        ahead, spans = None, runs(at)
        for (low, high, steps), alpha, emit in zip(reversed(spans), reversed(alphas), reversed(emits)):
            emit /= scale[low:high].reshape(steps, 1, -1)
            beta = np.empty_like(emit)
            beta[-1] = 1.0
            if ahead is not None:
                beta[-1][:, : ahead.shape[1]] = model.move @ ahead
                self.move += alpha[-1][:, : ahead.shape[1]] @ ahead.T
            ahead = emit[-1]
            ahead *= beta[-1]
            for e, b in zip(emit[-2::-1], beta[-2::-1]):
                np.matmul(model.move, ahead, out=b)
                e *= b
                ahead = e
            self.move += np.matmul(alpha[:-1], emit[1:].transpose(0, 2, 1)).sum(axis=0)
            alpha *= beta
        share = np.empty(len(flat))
        for k in range(len(model.start)):
            for (low, high, steps), alpha in zip(spans, alphas):
                share[low:high].reshape(steps, -1)[:] = alpha[:, k]
            self.emit[:, k] += np.bincount(flat, weights=share, minlength=len(self.emit))
        self.start += alphas[0][0].sum(axis=1)

    def model(self, before: Hmm, shares: np.ndarray) -> Hmm:
        move = self.move * before.move + 1.0
        emit = self.emit + PRIOR * shares[:, None]
        return Hmm((self.start + 1) / (self.start + 1).sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def grouped(sequences: list[np.ndarray], most: int = AT_ONCE):
    """Sequences of like length together, about ``most`` symbols at once."""
    order, held, total = np.argsort([len(s) for s in sequences], kind="stable"), [], 0
    for i in order:
        if held and total + len(sequences[i]) > most:
            yield np.array(held)
            held, total = [], 0
        held.append(i)
        total += len(sequences[i])
    if held:
        yield np.array(held)


def begin(company: np.ndarray, usual: np.ndarray, shares: np.ndarray, states: int = STATES, seed: int = 5) -> Hmm:
    """Where Baum-Welch starts: states at the usual symbols whose ``company`` [usual][usual] (in how many documents two of them
    meet) differs most."""
    sticky = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(sticky, 0.9 if states > 1 else 1.0)
    even = np.full(states, 1 / states)
    if not len(usual):
        return Hmm(even, sticky, np.repeat(shares[:, None], states, axis=1))
    x = np.sqrt(company) / np.maximum(np.sqrt(company.sum(axis=1, keepdims=True)), 1)
    picked = [0]
    while len(picked) < min(states, len(usual)):
        picked.append(int((x @ x[picked].T).max(axis=1).argmin()))
    emit = PRIOR * shares[:, None] * np.random.default_rng(seed).uniform(0.5, 1.5, (len(shares), states))
    for k in range(states):
        own = company[picked[k % len(picked)]]
        emit[usual, k] += 10 * PRIOR * own / max(1.0, own.sum())
    return Hmm(even, sticky, emit / emit.sum(axis=0))


def _company(rows: DataFrame, usual: np.ndarray, symbols: int) -> np.ndarray:
    """In how many of the documents any two usual symbols meet, summed over all of them."""
    n, place = len(usual), np.full(symbols, len(usual))
    place[usual] = np.arange(n)

    def run(batches):
        total = np.zeros((n, n))
        for batch in batches:
            sequences = _lists(batch.column("symbols"))
            for low in range(0, len(sequences), 512):
                there = np.zeros((len(sequences[low : low + 512]), n + 1), np.float32)
                for doc, symbols_ in enumerate(sequences[low : low + 512]):
                    there[doc, place[symbols_]] = 1
                total += there[:, :n].T @ there[:, :n]
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "n"])

    found = collected(rows.select("symbols").mapInArrow(run, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")))
    out = np.zeros((n, n))
    out[found["i"].to_numpy(), found["j"].to_numpy()] = found["n"].to_numpy()
    return out


def _counted(docs: DataFrame) -> DataFrame:
    """h and n: how often each word occurs, by its hash, once for each part of a batch."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, n = np.unique(word_hashes(words_of(part.column("text"), BLANK)[0]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long")


def _symbols(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, train, symbols of the document with its end, hashes of its words that are in a class."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                flat, at = words_of(part.column("text"), BLANK)
                h = word_hashes(flat)
                i = np.searchsorted(known, h).clip(max=max(0, len(known) - 1))
                inside = known[i] == h if len(known) else np.zeros(len(h), bool)
                n = part.num_rows
                symbols = np.full(len(h) + n, END, np.int32)
                ends = at[1:] + np.arange(n)
                words = np.ones(len(symbols), bool)
                words[ends] = False
                symbols[words] = np.where(inside, i + 1 + CLASSES, 1 + (h & np.uint64(CLASSES - 1)).astype(np.int64))
                outside = np.concatenate([[0], np.cumsum(~inside)])[at]
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("doc_id"), part.column("train"), pa.ListArray.from_arrays(pa.array((at + np.arange(n + 1)).astype(np.int32)), pa.array(symbols)), pa.ListArray.from_arrays(pa.array(outside.astype(np.int32)), pa.array(h[~inside].view(np.int64)))],
                    ["rid", "doc_id", "train", "symbols", "others"],
                )

    return docs.mapInArrow(run, f"rid long, doc_id {dict(docs.dtypes)['doc_id']}, train boolean, symbols array<int>, others array<long>")


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, at = np.asarray(column.flatten()).astype(np.int64), np.asarray(column.offsets)
    return [flat[a - at[0] : b - at[0]] for a, b in zip(at[:-1], at[1:])]


def _expectation(rows: DataFrame, model: Hmm) -> Expected:
    """One round's expected counts over all training documents; tasks report one row for each symbol that they met."""
    sent, states, symbols = rows.sparkSession.sparkContext.broadcast(model), len(model.start), len(model.emit)

    def run(batches):
        total = Expected(states, symbols)
        for batch in batches:
            sequences = _lists(batch.column("symbols"))
            for group in grouped(sequences):
                total.add(sent.value, [sequences[i] for i in group])
        met = np.flatnonzero(total.emit.any(axis=1))
        key = np.concatenate([met, -1 - np.arange(states), [-1 - states, -2 - states]])
        value = np.concatenate([total.emit[met], total.move, total.start[None, :], np.full((1, states), total.log)])
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), *(pa.array(np.ascontiguousarray(value[:, k])) for k in range(states))], ["key", *(f"s{k}" for k in range(states))])

    parts = rows.rdd.getNumPartitions()
    tables = rows.select("symbols").coalesce(max(1, -(-parts // TOGETHER))).mapInArrow(run, "key int, " + ", ".join(f"s{k} double" for k in range(states)))
    summed = collected(tables.groupBy("key").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)]))
    key, value = summed["key"].to_numpy(), summed.drop(columns="key").to_numpy(float)
    out = Expected(states, symbols)
    out.emit[key[key >= 0]] = value[key >= 0]
    for k, v in zip(key[key < 0], value[key < 0]):
        if k == -2 - states:
            out.log = v[0]
        elif k == -1 - states:
            out.start = v
        else:
            out.move[-1 - k] = v
    sent.unpersist()
    return out


def score(docs: DataFrame, modulus: int = 7, states: int = STATES, vocabulary: int = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    own = docs.select(F.monotonically_increasing_id().alias("rid"), docs["doc_id"], docs["text"], (~held_out(docs["doc_id"], modulus)).alias("train"))
    counted = scratch.keep(_counted(own.where("train")).groupBy("h").agg(F.sum("n").alias("n")), "counted")
    frequent = collected(most_frequent(counted.where("n > 1"), "n", vocabulary))
    order = np.argsort(frequent["h"].to_numpy(np.int64).view(np.uint64))
    words, times = frequent["h"].to_numpy(np.int64).view(np.uint64)[order], frequent["n"].to_numpy(np.int64)[order]
    rows = scratch.keep(_symbols(own, words), "symbols")

    # Tokens of each symbol: of classes what their words have that are not frequent, and how many words those are.
    of_class = collected(counted.groupBy(F.col("h").bitwiseAND(F.lit(CLASSES - 1)).cast("int").alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("types")))
    counts, types = np.zeros(1 + CLASSES + len(words), np.int64), np.zeros(CLASSES, np.int64)
    counts[1 + of_class["class"].to_numpy()], types[of_class["class"].to_numpy()] = of_class["n"].to_numpy(), of_class["types"].to_numpy()
    mine = (words & np.uint64(CLASSES - 1)).astype(np.int64)
    np.subtract.at(counts, 1 + mine, times)
    np.subtract.at(types, mine, 1)
    counts[1 + CLASSES :], counts[END] = times, rows.where("train").count()
    n_all, v_all = int(counts.sum()), int(types.sum()) + len(words) + int(counts[END] > 0)
    shares = (counts + 1) / (counts + 1).sum()
    of_its_own = np.ones(len(counts), bool)
    of_its_own[1 : 1 + CLASSES] = False
    logs, known = np.where(of_its_own, np.log10(counts + 1.0), 0.0), of_its_own & (counts > 0)
    within = np.zeros(len(counts))  # what a word's share is taken of, by symbol
    within[1 : 1 + CLASSES] = np.log10(counts[1 : 1 + CLASSES] + types + 1.0)

    # Words in classes meet their exact counts by hash, and each document gets the sum of log10(c + 1) of those that training has.
    met = rows.select("rid", F.explode("others").alias("h")).join(counted, "h")
    per_doc = scratch.keep(met.groupBy("rid").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("log"), F.count("*").alias("known")), "others")

    usual = 1 + CLASSES + np.lexsort((words, -times))[:USUAL]
    train = rows.where("train")
    model, before = begin(_company(train, usual, len(counts)), usual, shares, states), -np.inf
    for _ in range(rounds):
        expected = _expectation(train, model)
        model = expected.model(model, shares)
        if expected.log - before <= GAIN * abs(expected.log):
            break
        before = expected.log
    sent = spark.sparkContext.broadcast((model, logs, known, within))

    def recurse(batches):
        hmm, logs, known, within = sent.value
        for batch in batches:
            column = batch.column("symbols")
            sequences = _lists(column)
            flat, n = np.asarray(column.flatten()), np.array([len(s) for s in sequences], np.int64)
            at = np.concatenate([[0], np.cumsum(n)])
            out = np.empty(len(sequences))
            for group in grouped(sequences):
                out[group] = likelihood(hmm, [sequences[i] for i in group])
            total = lambda x: np.add.reduceat(x[flat], at[:-1]) if len(flat) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), batch.column("train"), pa.array(n), pa.array(total(known.astype(np.int64))), pa.array(total(logs)), pa.array(out - total(within))], ["rid", "doc_id", "train", "n_tokens", "inside", "logs", "hmm"])

    done = rows.select("rid", "doc_id", "train", "symbols").mapInArrow(recurse, f"rid long, doc_id {dict(rows.dtypes)['doc_id']}, train boolean, n_tokens long, inside long, logs double, hmm double")
    joined = done.join(per_doc, "rid", "left").select("*", F.coalesce("log", F.lit(0.0)).alias("other_logs"))
    value = F.col("hmm") + F.col("other_logs")
    return joined.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("inside") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("other_logs") - F.col("n_tokens") * F.lit(math.log10(n_all + v_all + 1))).alias("base_score"), value.alias("score"), F.pow(F.lit(10.0), -value / F.col("n_tokens")).alias("perplexity"),
    )


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))

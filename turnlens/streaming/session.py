"""Online detection: sessions that grow turn by turn, as a stateful stream and as its batch twin.

A session's state is a list of its masked turns and their kept acts, to which a turn appends, and one small value: how many
turns there are and the dialogue scorer's partial score. An ``Associative`` scorer merges a turn's part into that value, so what
a turn reads and writes does not grow with its session; for any other scorer the list is read and the whole dialogue scored
again. Arrival order is the only clock. A reset message empties the session, and an idle one ends: the value has a time to
live, which each turn renews, and a timer clears the list when the value is gone.

In batch, partial scores make the dialogue score a prefix scan: ranges of (session, seq) are scanned in parallel, each from what
the ranges before it hold of its first session, so a session may span many tasks. Scorers without parts get each session whole.

Defined cases: null texts are empty; a session without turns has no rows; rows of one session and seq go in any order; a
session begins at its first row or after its last reset; an empty table or batch gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.scoring import is_associative
from ..sources.scratch import Scratch

IDLE_MS = 30 * 60 * 1000
#: A turn as the stateful part gets it, what the list holds of it, and the value.
TURN = "session_id long, seq long, masked string, acts array<string>, utt_prob double, da_prob double, reset boolean"
HELD, VALUE = "masked string, acts array<string>", "n int, part array<double>"
OUT = "session_id long, turn_no int, masked string, masked_acts string, utt_prob double, da_prob double, dia_prob double"
NAMES = [c.split()[0] for c in OUT.split(", ")]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dialogue_text(turns: list[tuple]) -> str:
    """The masked turns so far, then the acts that they keep."""
    return " ".join([*(t for t, _ in turns), *(a for _, acts in turns for a in acts)])


def scored(scorer, pdf: pd.DataFrame, n: int, part: list[float] | None, earlier: Callable[[], list[tuple]]) -> tuple[pd.DataFrame, int, list[float] | None, list[tuple], bool]:
    """Rows of one session in order, after ``n`` turns with the partial score ``part``: what comes out, the new n and part, the
    turns since the last reset that are to be appended, and whether there was a reset. ``earlier`` gives all turns before
    and is only called for scorers without parts."""
    new, rows, reset, texts = [], [], False, []
    parts = scorer.parts([dialogue_text([(m or "", list(a))]) for m, a in zip(pdf["masked"], pdf["acts"])]) if is_associative(scorer) else None
    before = earlier() if parts is None and n else []
    for i, row in enumerate(pdf.itertuples(index=False)):
        if row.reset:
            new, before, n, part, reset = [], [], 0, None, True
            continue
        new.append((row.masked or "", [str(a) for a in row.acts]))
        if parts is not None:
            part = parts[i].tolist() if part is None else scorer.merge(np.asarray(part, float), parts[i]).tolist()
            texts.append(part)
        else:
            texts.append(dialogue_text([*before, *new]))
        rows.append((row.session_id, n, row.masked or "", ";".join(row.acts), row.utt_prob, row.da_prob))
        n += 1
    score = (scorer.finish(np.array(texts)) if parts is not None else scorer.predict(texts)) if texts else np.zeros(0)
    return pd.DataFrame([(*r, float(s)) for r, s in zip(rows, score)], columns=NAMES), n, part, new, reset


class Sessions(StatefulProcessor):
    """The stateful part of the stream."""

    def __init__(self, scorer, idle_ms: int | None):
        self.scorer, self.idle_ms = scorer, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", HELD)
        self.value = handle.getValueState("value", VALUE, **({} if self.idle_ms is None else {"ttlDurationMs": self.idle_ms}))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        alive = self.value.exists()
        n, part = self.value.get() if alive else (0, None)
        if not alive:  # what an idle session left
            self.turns.clear()
        earlier = lambda: [(m, list(a)) for m, a in self.turns.get()]
        out, n, part, new, reset = scored(self.scorer, pdf, n, None if part is None else list(part), earlier)
        if reset:
            self.turns.clear()
        for turn in new:
            self.turns.appendValue(turn)
        if n:
            self.value.update((n, part))
            if not alive and self.idle_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        else:
            self.value.clear()
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.value.exists():  # turns came meanwhile: look again later
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        else:
            self.turns.clear()
        yield pd.DataFrame(columns=NAMES)

    def close(self) -> None:
        pass


def with_store(spark: SparkSession) -> None:
    """States of several kinds need the RocksDB store; one that the user has chosen stays."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(name, ROCKSDB)


def sessions_stream(turns: DataFrame, scorer, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """A stream of turns (the columns of TURN) to one row per turn (OUT). Rows of one batch go in the order of seq. With
    ``idle_ms`` idle sessions end; with None only a reset ends them, and a bounded stream runs out."""
    with_store(turns.sparkSession)
    return turns.groupBy("session_id").transformWithStateInPandas(Sessions(scorer, idle_ms), OUT, "Append", "None" if idle_ms is None else "ProcessingTime")


def sessions_batch(turns: DataFrame, scorer) -> DataFrame:
    """The batch twin of ``sessions_stream``."""
    if not is_associative(scorer):
        whole = lambda pdf: scored(scorer, pdf.sort_values("seq", kind="stable"), 0, None, list)[0]
        return turns.groupBy("session_id").applyInPandas(whole, OUT)
    spark, scratch = turns.sparkSession, Scratch(turns.sparkSession, "sessions")
    ranged = scratch.keep(turns.repartitionByRange("session_id", "seq").sortWithinPartitions("session_id", "seq").withColumn("_part", F.spark_partition_id()), "ranged")

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        """What a range holds of its last session, and whether that session began there."""
        own = pdf[pdf["session_id"] == pdf["session_id"].max()].sort_values("seq", kind="stable")
        _, n, part, _, reset = scored(scorer, own, 0, None, list)
        return pd.DataFrame([(int(pdf["_part"].iloc[0]), int(own["session_id"].iloc[0]), n, part, bool(reset or len(own) < len(pdf)))], columns=["part", "session_id", "n", "held", "fresh"])

    # A row for each range; each takes from the ranges before it what is of one session, back to where that session began.
    ends = ranged.groupBy("_part").applyInPandas(last, "part int, session_id long, n int, held array<double>, fresh boolean").toPandas().sort_values("part")
    carried, session, n, held = {}, None, 0, None
    for row in ends.itertuples(index=False):
        carried[row.part] = (session, n, held)
        if row.fresh or row.session_id != session:
            session, n, held = row.session_id, row.n, None if row.held is None else list(row.held)
        elif row.n:
            n, held = n + row.n, list(row.held) if held is None else scorer.merge(np.array(held), np.array(row.held)).tolist()

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["session_id", "seq"], kind="stable")
        whose, n, held = carried[int(pdf["_part"].iloc[0])]
        out = [scored(scorer, own, *((n, held) if key == whose else (0, None)), list)[0] for key, own in pdf.groupby("session_id")]
        return pd.concat(out)

    return ranged.groupBy("_part").applyInPandas(scan, OUT)


def top_masked(text: str, weight: Callable[[str], float], k: int) -> str:
    """The text with all but its k strongest tokens masked; 0 keeps all."""
    words = text.split()
    keep = set(sorted(range(len(words)), key=lambda i: (-abs(weight(words[i])), i))[:k]) if k else set(range(len(words)))
    return " ".join(w if i in keep else "<mask>" for i, w in enumerate(words))


def detect_stream(messages: DataFrame, scorer, k: int = 3, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """A stream of (session_id, seq, text, reset) to one row per turn: session_id, turn_no, turn_prob, dia_prob, n_turns, masked,
    where the scorer's weights say which k tokens stay. ``pipeline.run_stream`` attributes, for scorers without weights."""

    def turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].fillna("").tolist()
            yield pdf[["session_id", "seq"]].assign(masked=[top_masked(t, scorer.weight, k) for t in texts], acts=[[] for _ in texts], utt_prob=scorer.predict(texts) if texts else [], da_prob=0.0, reset=pdf["reset"])

    out = sessions_stream(messages.select("session_id", F.col("seq").cast("long").alias("seq"), "text", "reset").mapInPandas(turns, TURN), scorer, idle_ms)
    return out.select("session_id", "turn_no", F.col("utt_prob").alias("turn_prob"), "dia_prob", (F.col("turn_no") + 1).alias("n_turns"), "masked")


def detect_batch(messages: DataFrame, k: int = 3) -> DataFrame:
    """The batch twin for the linear surrogate, in Column expressions: each turn with all turns before it."""
    from ..functions.columns import let
    from ..operators.selection import important_ids, topk_absolute
    from ..sources.conversations import lexicon_weight, tokens

    tok = tokens(F.col("text"))
    e = F.transform(tok, lambda t, i: F.struct(i.alias("idx"), t.alias("text"), lexicon_weight(t).alias("score")))
    rows = messages.withColumn("tok", tok).withColumn("e", e)
    ids = important_ids(topk_absolute(F.col("e"), k)) if k else F.transform("tok", lambda t, i: i)
    rows = rows.withColumn("ids", ids).withColumn("masked", F.array_join(let(F.col("ids"), lambda own: F.transform("tok", lambda t, i: F.when(F.array_contains(own, i), t).otherwise("<mask>"))), " "))
    total = lambda keep: F.aggregate(F.filter("e", keep), F.lit(0.0), lambda a, x: a + x["score"])
    rows = rows.withColumn("own", total(lambda x: F.lit(True))).withColumn("kept", let(F.col("ids"), lambda own: total(lambda x: F.array_contains(own, x["idx"]))))
    w = W.partitionBy("session_id").orderBy("seq")
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    return rows.select("session_id", (F.row_number().over(w) - 1).alias("turn_no"), sigmoid(F.col("own")).alias("turn_prob"), sigmoid(F.sum("kept").over(w)).alias("dia_prob"), F.row_number().over(w).alias("n_turns"), "masked")

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnlens.operators import scoring as S
from turnlens.sources import conversations as C
from turnlens.streaming import pipeline as P
from turnlens.streaming import session


class Odd:
    """A scorer that is not linear, has no weights, no logit and no parts, and for which the order of words matters."""

    def predict(self, texts):
        return np.array([1 / (1 + math.exp(-math.sin(sum((i % 3 + 1) * len(w) for i, w in enumerate(t.split()))))) for t in texts])


class Peaks(S.LexiconScorer):
    """Not linear, but its score follows from parts: the sum of weights and the longest word."""

    def parts(self, texts):
        return np.array([[float(self.logit([t])[0]), float(max(map(len, t.split()), default=0))] for t in texts]).reshape(-1, 2)

    def merge(self, a, b):
        return np.array([a[0] + b[0], max(a[1], b[1])])

    def finish(self, parts):
        return 1 / (1 + np.exp(-parts[:, 0] * np.log1p(parts[:, 1])))

    def predict(self, texts):
        return self.finish(self.parts(texts))


class Plain:
    """A scorer with its parts hidden."""

    def __init__(self, scorer):
        self.scorer = scorer

    def predict(self, texts):
        return self.scorer.predict(texts)


def pick(df):
    return sorted((r["session_id"], r["turn_no"], r["masked"], r["masked_acts"], *(round(r[c], 6) for c in ("utt_prob", "da_prob", "dia_prob"))) for r in df.collect())


def stream(spark, path, parts, name, files=1):
    source = spark.readStream.schema("session_id long, seq long, text string, reset boolean").option("maxFilesPerTrigger", files).parquet(path)
    q = P.run_stream(source, parts, idle_ms=None).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name)


@pytest.mark.parametrize("name,dia", [("parts", Peaks()), ("whole", Odd())])
def test_stream_is_its_batch_twin_for_any_scorer(spark, sf, tmp_path, name, dia):
    rows = C.user_turns(spark, sf).where("dia_no < 6").select(F.col("dia_no").alias("session_id"), F.col("turn_no").cast("long").alias("seq"), "text", (F.col("turn_no") == 2).alias("reset"))
    for low in (0, 2, 4):  # three micro-batches, one after another
        rows.where(f"seq >= {low} and seq < {low + 2 if low < 4 else 99}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    parts = P.Parts(utt=Odd(), da=Odd(), dia=dia, masks=40)
    got = pick(stream(spark, str(tmp_path / "in"), parts, name))
    assert got == pick(P.run_batch(rows, parts)) and len(got) == rows.where("not reset").count()


def test_parts_give_the_score_of_the_whole_wherever_a_session_is_cut(spark, sf):
    rows = C.user_turns(spark, sf).select((F.col("dia_no") % 3).alias("session_id"), (F.col("dia_no") * 1000 + F.col("turn_no")).cast("long").alias("seq"), "text", (F.col("dia_no") % 11 == 5).alias("reset"))
    turns = P.attributed(rows, P.Parts(masks=20)).cache()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        whole, cut = session.sessions_batch(turns, Plain(Peaks())), session.sessions_batch(turns, Peaks())
        assert pick(whole) == pick(cut)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        turns.unpersist()


class State:
    """A state as the processor sees it, which counts what is written and read."""

    def __init__(self):
        self.held, self.written, self.read = None, 0, 0

    def exists(self):
        return self.held is not None

    def get(self):
        self.read += 1
        return self.held if isinstance(self.held, tuple) else iter(self.held or [])

    def update(self, value):
        self.held, self.written = value, self.written + len(str(value))

    def appendValue(self, value):
        self.held, self.written = [*(self.held or []), value], self.written + len(str(value))

    def clear(self):
        self.held = None


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getListState(self, name, schema):
        return self.states.setdefault(name, State())

    def getValueState(self, name, schema, ttlDurationMs=None):
        return self.states.setdefault(name, State())

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def turn(seq, reset=False):
    return pd.DataFrame([(1, seq, "blue river", ["inform|general|name|x"], 0.5, 0.5, reset)], columns=["session_id", "seq", "masked", "acts", "utt_prob", "da_prob", "reset"])


def test_a_turn_writes_as_much_however_long_its_session_is():
    handle, processor, cost = Handle(), session.Sessions(S.DialogueScorer(), 1000), []
    processor.init(handle)
    for seq in range(200):
        before = sum(s.written for s in handle.states.values())
        out = pd.concat(processor.handleInputRows((1,), iter([turn(seq)]), Clock(seq)))
        assert out["turn_no"].tolist() == [seq]
        cost.append(sum(s.written for s in handle.states.values()) - before)
    assert max(cost[10:]) <= min(cost[10:]) + 20 and handle.states["turns"].read == 0 and len(handle.states["turns"].held) == 200
    assert handle.timers == [1000]


def test_idle_sessions_end_and_resets_empty_them():
    handle, processor = Handle(), session.Sessions(Odd(), 1000)
    processor.init(handle)
    run = lambda pdf, now: pd.concat(processor.handleInputRows((1,), iter([pdf]), Clock(now)))["turn_no"].tolist()
    assert run(pd.concat([turn(1), turn(0)]), 0) == [0, 1] and run(turn(2), 500) == [2]
    assert pd.concat(processor.handleExpiredTimer((1,), Clock(1000), None)).empty and handle.timers == [1000, 2000]
    handle.states["value"].held = None  # its time to live is over
    assert pd.concat(processor.handleExpiredTimer((1,), Clock(2000), None)).empty and handle.states["turns"].held is None
    assert run(pd.concat([turn(3), turn(4, True), turn(5)]), 3000) == [0, 0] and len(handle.states["turns"].held) == 1
    assert run(turn(6, True), 3100) == [] and handle.states["value"].held is None


def test_idle_sessions_end_in_a_stream(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "session_id long, seq long, text string, reset boolean"
    put = lambda *seqs: spark.createDataFrame([(1, q, f"turn number {q}", False) for q in seqs], schema).coalesce(1).write.mode("append").parquet(path)
    put(0, 1)
    q = P.run_stream(spark.readStream.schema(schema).parquet(path), P.Parts(masks=10), idle_ms=15_000).writeStream.format("memory").queryName("idle").outputMode("append").trigger(processingTime="1 second").start()

    def seen(n: int) -> None:
        """Waits for so many rows; a stream with timers is never out of batches."""
        end = time.time() + 90
        while spark.table("idle").count() < n and time.time() < end and q.exception() is None:
            time.sleep(0.5)

    try:
        seen(2)
        put(2)
        seen(3)
        time.sleep(18)
        put(3, 4)
        seen(5)
        assert q.exception() is None
        assert sorted((r["turn_no"], r["masked"].split()[-1]) for r in spark.table("idle").collect()) == [(0, "0"), (0, "3"), (1, "1"), (1, "4"), (2, "2")]
    finally:
        q.stop()

from types import SimpleNamespace

import corpus_pipeline as P
from pyspark.sql import functions as F

from turnlens.llm import mixing, sharding
from turnlens.llm.common import Scratch, table
from turnlens.sources import scratch

from .test_decontamination import brute as contaminated
from .test_minhash_dedup import brute as components


def test_stages_and_their_decisions(spark, tmp_path, sf):
    docs = table(spark, sf, "documents")
    columns, before = docs.columns, docs
    kept = {}
    for name, stage in P.STAGES:
        path = f"file://{tmp_path}/{name}"
        stage(spark, before, sf).write.parquet(path)
        after = spark.read.parquet(path)
        if name != P.STAGES[-1][0]:
            assert after.columns == columns
        kept[name] = (before.toPandas(), after.toPandas())
        before = after
    given, left = kept["minhash_dedup"]
    want = {i for i, _, root in components(list(zip(given["doc_id"], given["text"])), P.SIMILAR_PERCENT, P.SHINGLE_WORDS) if i == root}
    assert set(left["doc_id"]) == want and len(left) == len(want)
    given, left = kept["decontamination"]
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    assert set(left["doc_id"]) == {r[0] for r in contaminated(list(zip(given["doc_id"], given["text"])), items, P.WINDOW_WORDS) if not r[-1]}
    given, left = kept["mixing"]
    assert set(left["doc_id"]) <= set(given["doc_id"]) and left.groupby("doc_id").size().max() <= 2
    given, left = kept["sharding"]
    assert len(left) == len(given) and sorted(left["doc_id"]) == sorted(given["doc_id"])
    given, left = kept["toxicity"]
    labels = table(spark, sf, "labels").toPandas().set_index("doc_id")["toxic"]
    gone = set(given["doc_id"]) - set(left["doc_id"])
    clean = [i for i in given["doc_id"] if labels.get(i) == 0]
    assert len(gone & set(clean)) <= 0.03 * len(clean)


def test_messy_and_empty_tables(spark, messy, nothing, sf):
    for name, stage in P.STAGES[1:]:
        assert stage(spark, nothing, sf).count() == 0, name
    left = P.drop_near_duplicates(spark, messy, sf)
    assert left.columns == messy.columns and left.count() == left.select("doc_id").distinct().count()
    assert P.drop_contaminated(spark, messy, sf).columns == messy.columns
    mixed = P.mix_sources(spark, messy, sf)
    assert mixed.columns == messy.columns and P.cut_shards(spark, mixed, sf).count() == mixed.count()
    toxic = P.drop_toxic(spark, messy, sf)
    assert toxic.columns == messy.columns
    assert P.drop_toxic(spark, nothing, sf).count() == 0


def test_run(spark, sf):
    """Only the pipeline's own tables go while it runs: a result made before it, and not yet written, keeps its tables."""
    pending = sharding.op10_sharding(spark, sf)
    n = table(spark, sf, "documents").count()
    out = P.run(spark, sf)
    assert pending.count() == n
    assert 0 < out.count() and out.groupBy("shard", "slot").count().where("count > 1").count() == 0
    assert out.groupBy("shard").agg((F.max("slot") + 1 - F.count("*")).alias("gaps")).where("gaps <> 0").count() == 0
    assert out.select("doc_id").distinct().join(table(spark, sf, "documents"), "doc_id", "left_anti").count() == 0
    assert P.ORACLE_SQL is None and len(P.STAGES) == 5


def test_slots_follow_the_order_of_the_mix(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    mixed = mixing.mix(docs, whole=True, carry=True)
    draws = sorted((d["shard"], d["place"], r["doc_id"]) for r in mixed.select("doc_id", "draws").collect() for d in r["draws"])
    path = f"file://{tmp_path}/mixed"
    P.mix_sources(spark, docs, sf).write.parquet(path)
    written = spark.read.parquet(path)
    order = [r["doc_id"] for r in written.select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()]
    assert order == [d[-1] for d in draws]
    out = P.cut_shards(spark, written, sf).select("shard", "slot", "doc_id").toPandas()
    for shard, own in out.groupby("shard"):
        mine = set(own["doc_id"])
        assert own.sort_values("slot")["doc_id"].tolist() == [i for i in order if i in mine], shard
    assert len(out) == len(order)
    memory = spark.createDataFrame([(2, "b", "s"), (1, "a", "s")], "doc_id long, text string, source string")
    assert P.cut_shards(spark, memory, sf).count() == 2


def test_rows_of_files_have_numbers_of_their_own(spark, tmp_path):
    docs = spark.createDataFrame([(i % 7, f"text {i % 5}") for i in range(500)], "doc_id long, text string").repartition(6)
    docs.write.option("maxRecordsPerFile", 30).parquet(f"file://{tmp_path}/a")
    one = spark.read.parquet(f"file://{tmp_path}/a")
    given = P._with_row(spark, one, "row")
    assert len(one.inputFiles()) > 12 and "numbered" not in given.inputFiles()[0]
    assert given.select("row").distinct().count() == 500
    again = P._with_row(spark, spark.read.option("maxPartitionBytes", "1k").parquet(f"file://{tmp_path}/a"), "row")
    assert sorted(map(tuple, given.collect())) == sorted(map(tuple, again.collect()))
    docs.write.mode("append").parquet(f"file://{tmp_path}/a")  # a second writer numbers its files alike
    both = P._with_row(spark, spark.read.parquet(f"file://{tmp_path}/a"), "row")
    assert "numbered" in both.inputFiles()[0] and both.select("row").distinct().count() == 1000


def test_near_duplicates_by_row_whatever_the_ids(spark, sf):
    base = [" ".join(f"{c}{i}" for i in range(80)) for c in "abcdef"]
    rows = [(None, base[0]), (1, base[0]), (None, base[1]), (None, base[2]), (None, base[2]), (None, base[2] + " tail"), (7, base[3]), (7, base[4]), (9, base[3] + " tail"), (10, base[4] + " tail"), (7, base[3]), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [(r["doc_id"], (r["text"] or "")[:2]) for r in P.drop_near_duplicates(spark, docs, sf).collect()]
    assert sorted(left, key=str) == sorted([(1, "a0"), (None, "b0"), (None, "c0"), (7, "d0"), (7, "e0"), (None, ""), (None, "")], key=str)


def test_columns_that_clash_with_the_stages_own(spark, messy, sf):
    docs = messy.select("doc_id", "text", "source", "score", F.lit(1).alias("toxic"), F.lit(2).alias("row"), F.lit(3).alias("bad"), F.lit(4).alias("hashed"), F.lit(5).alias("draws"), F.lit(6).alias("place"))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.where("row <> 2 or bad <> 3 or hashed <> 4 or toxic <> 1 or draws <> 5 or place <> 6").count() == 0, name


def test_a_table_ends_with_a_collection_if_the_heap_has_grown(spark, monkeypatch):
    called = []
    of = lambda used: SimpleNamespace(_jvm=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: SimpleNamespace(totalMemory=lambda: used, maxMemory=lambda: 100)), System=SimpleNamespace(gc=lambda: called.append(used))))
    for used in (10, 50, 51, 100):
        scratch.release(of(used))
    assert called == [51, 100]
    monkeypatch.setattr(scratch, "release", called.append)
    Scratch(spark, "small").keep(spark.range(3), "rows")
    assert called[2:] == [spark]

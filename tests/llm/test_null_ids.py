"""Rows without an id: they are judged like others where rows are judged one by one, and never link or clash elsewhere."""

import pytest
from pyspark.sql import functions as F

from turnlens.llm import decontamination, embedding_dedup, lm_scoring, mixing, quality, secrets, sharding, toxicity, url_filter

from .conftest import prose


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, prose(i % 2, 30), None if i % 3 else "a") for i in range(6)] + [(i, prose(i, 25), "b") for i in range(30)] + [(None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_documents(spark, docs):
    n, labels = docs.count(), spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, prose(0, 30))], "item_id long, text string")
    assert lm_scoring.score(docs, vocabulary=20).count() == n
    assert mixing.mix(docs).count() == n and mixing.mix(docs, whole=True, carry=True).count() == n
    assert decontamination.contaminated(docs, bench).where("contaminated").count() == 3 + 1
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == n
    assert quality.score(docs, quality.train(docs, labels)).count() == n
    assert secrets.scan(docs).count() == n
    out = sharding.shard(docs, shards=3)
    assert out.count() == n and out.groupBy("shard", "slot").count().where("count > 1").count() == 0


def test_vectors_and_pages(spark):
    x = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(None, x), (None, x), (1, x), (2, x), (3, [-1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    out = sorted(map(tuple, embedding_dedup.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert out == sorted([(None, 0, None, True), (None, 0, None, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)], key=str)
    assert url_filter.judge(spark.createDataFrame([(None, "http://a.org/")], "page_id long, url string")).select(F.col("verdict")).first()[0] == "allow"

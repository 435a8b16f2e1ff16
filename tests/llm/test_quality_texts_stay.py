"""Quality rules: texts of trusted documents do not travel, and few map rows change no count."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_rules


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.fixture
def exchanged_joins(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def test_trusted_texts_are_not_exchanged(spark, exchanged_joins):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefghijklmnop", k=10_000)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).localCheckpoint()
    before = shuffled(spark)
    rows = quality_rules.weights(docs, docs.select("doc_id")).count()
    assert rows > 200 and shuffled(spark) - before < 600_000


def test_ids_taken_by_mistake_are_not_counted(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 100 != 7, F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    trusted = spark.range(0, 4000, 3).select(F.when(F.col("id") != 9, F.col("id")).alias("doc_id"))
    for map_rows in (1, 40, 300):
        out = quality_rules.trusted_folds(docs, trusted, map_rows)
        got = {r.text: r.fold for r in out.collect()}
        want = {r.text: r.fold if r.doc_id is not None and r.doc_id % 3 == 0 and r.doc_id != 9 else None for r in docs.withColumn("fold", quality_rules.fold(F.col("doc_id"))).collect()}
        assert out.count() == 3000 and got == want

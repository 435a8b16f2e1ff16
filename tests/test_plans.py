"""Plans that keep their partitions, paging far into a table, streams, column files in parts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera import operators as ops
from tessera.sources import register_columnfile, scratch_folder, text_rows, write_columns
from tessera.streaming import compute, project, where



def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_skyline_rounds_have_exchanges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(1000).select((F.col("id") % 7).alias("a"), (F.col("id") % 11).alias("b"), "id")
        text = plan_of(ops.pareto(df, ["a", "b", "id"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rounds = [int(n) for n in re.findall(r"RoundRobinPartitioning\((\d+)\)", text.split("== Physical Plan ==")[1])]
    assert "Coalesce" not in text and 8 in rounds


def test_skyline_ranges_have_fixed_bounds(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("a"), (F.col("id") * 53 % 97).alias("b"))
    assert "spark_partition_id" not in plan_of(ops.pareto(df, ["a", "b"])).lower()


@pytest.mark.parametrize("offset,count", [(0, 5), (90, 30), (400, 100), (1195, 50), (1300, 5)])
def test_deep_page(spark, offset, count):
    rng = random.Random(offset)
    rows = [(None if rng.random() < 0.1 else rng.randrange(4), float(rng.randrange(300)), i) for i in range(1200)]
    df = spark.createDataFrame(rows, "a int, b double, c int").repartition(5)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))[offset : offset + count]
    assert [tuple(r) for r in ops.deep_page(df, ["a", "b", "c"], offset, count, heap_rows=20).collect()] == want
    assert ops.deep_page(df.filter("c < 0"), ["a", "b"], offset, count, heap_rows=0).collect() == []


def test_page_of_unsorted_text_has_its_size(spark):
    df = spark.range(1000).repartition(7)
    assert text_rows(df, ["id"], 990, 20).count() == 10 and text_rows(df, ["id"], 3, 5).count() == 5


def test_operators_take_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(20).selectExpr("id", "id % 3 as k").write.parquet(src)
    stream = spark.readStream.schema("id long, k long").parquet(src)
    out = project(compute(where(stream, F.col("k") == 1), F.col("id") * 2, "twice", "int"), "id", "twice")
    assert out.isStreaming
    query = out.writeStream.format("memory").queryName("twice").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("twice").collect()) == [(i, 2 * i) for i in range(20) if i % 3 == 1]


def test_column_files_in_parts(spark):
    register_columnfile(spark)
    rows = [(i, "é" * (i % 5), i / 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "n long, s string, d double").repartition(4)
    path = scratch_folder(spark, "parts")
    write_columns(df, path)
    back = spark.read.format("columnfile").schema(df.schema).option("rowsPerPartition", "100").load(path)
    assert back.rdd.getNumPartitions() >= 10 and sorted(map(tuple, back.collect())) == rows
    empty = scratch_folder(spark, "empty")
    write_columns(df.filter("n < 0"), empty)
    with pytest.raises(Exception, match="nulls"):
        write_columns(df.select(F.when(F.col("n") > 5, F.col("n")).alias("n")), scratch_folder(spark, "nulls"))
    with pytest.raises(ValueError):
        write_columns(df.select(F.array("n").alias("n")), scratch_folder(spark, "kind"))


def test_sketches_merge(spark):
    df = spark.range(20_000).withColumn("k", F.col("id") % 5)
    each = ops.group_by(df, ["k"], ops.ndv_sketch("id", "s"))
    guess = ops.global_aggregate(each, ops.ndv_merged("s", "n")).first().n
    assert abs(guess - 20_000) < 2000

"""Queries at the reference's sizes take in all rows."""

from tessera.plans import QUERIES

DATA = "/root/testdata/sf0.01"


def test_merge_takes_all_lines(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_quantity", "l_linenumber", "l_orderkey")
    got = [tuple(r) for r in QUERIES["merge_sorted_runs"](spark, DATA).collect()]
    assert got == sorted(map(tuple, lines.collect()))


def test_reference_k_and_n(spark):
    big = "/root/testdata/sf0.1"
    assert QUERIES["topk_largek"](spark, big).count() == min(100_000, spark.read.parquet(f"{big}/orders.parquet").count())
    assert QUERIES["range_sum"](spark, DATA).first().s == 500_000_000_500_000_000

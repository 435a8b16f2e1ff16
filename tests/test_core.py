import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import operators as ops
from tessera.functions import call, from_julian_day, julian_day, lenient_date, one_char, round_up_cents
from tessera.plans import Plan
from tessera.sources import Catalog, register_columnfile, sorted_tuple_runs, text_rows, write_column, write_table

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute(points):
    full = [p for p in points if None not in p]
    return [p for p in points if None in p or not any(q != p and all(a <= b for a, b in zip(q, p)) for q in full)]


@pytest.mark.parametrize("dims,top,n", [(1, 9, 40), (2, 6, 200), (2, 1000, 300), (3, 5, 300), (4, 50, 200), (2, 3, 0), (3, 3, 1)])
def test_skyline_strategies_equal_brute_force(spark, dims, top, n):
    rng = random.Random(dims * 1000 + top)
    pts = [tuple(None if rng.random() < 0.03 else float(rng.randrange(top)) for _ in range(dims)) for _ in range(n)]
    cols = [f"k{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id long, " + ", ".join(f"{c} double" for c in cols)).repartition(5)
    want = sorted(brute(pts), key=repr)
    for s in ["auto", "gather", "anti"] + ["sweep"] * (dims == 2):
        assert rows(ops.pareto(df, cols, s).select(*cols)) == want, s


def test_skyline_maximises_and_keeps_columns(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 9, "c"), (2, 7, "d"), (1, 7, "e")], "x int, y int, n string")
    assert rows(ops.pareto(df, ["x", "-y"]).select("n")) == [("b",), ("c",), ("e",)]


def test_skyline_plan_has_no_nested_loop(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("a"), (F.col("id") % 11).alias("b"), "id")
    plan = ops.pareto(df, ["a", "b", "id"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_join_repeated_key_residual_nulls_and_bags(spark):
    left = spark.createDataFrame([(1.0, 1), (1.0, 2), (None, 3), (2.0, 4)], "a double, x int")
    right = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (2, 2, 9), (None, None, 5)], "b int, c int, y int")
    assert rows(ops.hash_join(left, right, ["a"], ["b"])) == rows(
        spark.createDataFrame([(1.0, 1, 1, 1, 0), (1.0, 1, 1, 2, 0), (1.0, 2, 1, 1, 0), (1.0, 2, 1, 2, 0), (2.0, 4, 2, 2, 9)], "a double, x int, b int, c int, y int"))
    assert len(rows(ops.hash_join(left, right, ["a", "a"], ["b", "c"], build="left"))) == 3
    assert rows(ops.hash_join(left, right, ["a"], ["b"], F.col("x") * 1.03 < F.col("y")).select("x")) == [(4,)]
    with pytest.raises(ValueError):
        ops.hash_join(left, left, ["a"], ["a"])


def test_aggregates(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 4)], "k int, v int")
    got = rows(ops.group_by(df, ["k"], ops.count("n"), ops.sum_("v", "s"), ops.max_("v", "m"), ops.avg("v", "a"), ops.avg("v", "t", truncate=True)))
    assert got == [(1, 2, 3, 2, 1.5, 1), (2, 1, 4, 4, 4.0, 4)]
    none = df.filter("k > 9")
    assert rows(ops.global_aggregate(none, ops.count("n"))) == [(0,)]
    assert rows(ops.global_aggregate(none, ops.count("n"), empty_rows=0)) == []
    assert rows(ops.group_by(df, ["k"], ops.count("n"), having=F.col("n") > 1)) == [(1, 2)]
    ties = spark.createDataFrame([(5, 7.0), (3, 7.0)], "k int, v double")
    assert rows(ops.top_group(ties, "k", F.max("v"), "m")) == [(3, 7.0)]
    assert abs(rows(ops.global_aggregate(spark.range(10000), ops.ndv("id", "n")))[0][0] - 10000) < 1500


def test_sorting(spark):
    df = spark.createDataFrame([(i * 7 % 10, i) for i in range(10)], "a int, b int")
    assert [r.a for r in ops.page(ops.sort(df, ["a"]), 3, 2).collect()] == [3, 4]
    assert [r.a for r in ops.sort(df, ["a"], desc=True).collect()][0] == 9
    assert [r.a for r in ops.page(ops.sort(df, ["a"]), 8).collect()] == [8, 9]
    assert ops.top_k(df, ["a"], 0).collect() == []
    assert "TakeOrderedAndProject" in ops.top_k(df, ["a", "b"], 3)._jdf.queryExecution().executedPlan().toString()
    runs = sorted_tuple_runs(spark, 4, 50, 3)
    got = [tuple(r) for r in ops.merge_runs(runs, ["c1", "c2", "c3"]).select("c1", "c2", "c3").collect()]
    assert got == sorted(got) and len(got) == 200
    code = ops.offset_value_code([F.lit(3), F.lit(8)], [F.lit(3), F.lit(9)])
    assert spark.range(1).select(code.alias("c")).first().c == 1992


def test_functions(spark):
    one = spark.createDataFrame([("2023-02-31", " 1995-03-15 ", "1995-13-01", "x")], "a string, b string, c string, d string")
    r = one.select(*[lenient_date(F.col(c)).alias(c) for c in "abcd"]).first()
    assert tuple(r) == (dt.date(2023, 3, 3), dt.date(1995, 3, 15), None, None)
    d = spark.range(1).select(julian_day(F.lit("1995-03-15").cast("date")).alias("j"), from_julian_day(F.lit(2449792)).alias("b"), round_up_cents(F.lit(1.231)).alias("p"), one_char(F.lit("x")).alias("o")).first()
    assert (d.j, d.b, d.p, d.o) == (2449792, dt.date(1995, 3, 15), 1.24, "x")
    df = spark.createDataFrame([(7, -2)], "a int, b int")
    r = df.select(call("int_divides", "a", "b").alias("q"), call("modulus", "a", "b").alias("m"), call(lambda x: x * 2, "a").alias("f")).first()
    assert tuple(r) == (-3, 1, 14)
    with pytest.raises(KeyError):
        call("nope", 1)


def test_plan_and_pruned_scan(spark):
    c = Catalog(spark, DATA)
    p = Plan.scan(c, "lineitem", "l_quantity", "l_discount").where(F.col("l_quantity") > 40).group_by(["l_discount"], ops.count("n"))
    text = p.df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in text and "l_tax" not in text
    with pytest.raises(KeyError):
        c.scan("orders", ["nope"])
    c.register()
    assert spark.sql("select count(*) n from partsupp").first().n > 0


def test_sinks_and_column_files(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "a int, s string")
    assert [r.value for r in text_rows(df.orderBy("a"), ["a", "s"]).collect()] == ["1 ", "2 b"]
    write_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("s", T.StringType()), T.StructField("d", T.DateType())])
    base = tmp_path / "cols"
    base.mkdir()
    values = {"n": [3, -1, 2**40], "s": ["", "né", "z" * 50], "d": [0, 1, 9204]}
    for f in schema:
        write_column(str(base / f"{f.name}.bin"), values[f.name], f.dataType)
    register_columnfile(spark)
    got = spark.read.format("columnfile").schema(schema).option("rowsPerPartition", "2").load(str(base)).collect()
    assert [(r.n, r.s) for r in got] == list(zip(values["n"], values["s"]))
    assert [r.d for r in got][2] == dt.date(1995, 3, 15)

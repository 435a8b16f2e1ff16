"""The query catalogue in DataFrame form, each with equivalent SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import operators as ops
from tessera.functions import call, from_julian_day, julian_day, lenient_date, one_char, round_up_cents
from tessera.plans.builder import Plan
from tessera.sources import SCHEMAS, Catalog, register_columnfile, scratch_folder, sorted_tuple_runs, text_rows, write_columns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        name = fn.__name__
        QUERIES[name] = lambda spark, sf_dir: fn(Catalog(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def _day(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("select round(sum(o_totalprice),2) as sum_of_total from orders")
def sample_sum(c: Catalog) -> DataFrame:
    return Plan.scan(c, "orders", "o_totalprice").aggregate(F.round(F.sum("o_totalprice"), 2).alias("sum_of_total")).df


@query("select o_custkey, max(o_totalprice) as max_order from orders group by o_custkey order by max_order desc, o_custkey limit 1")
def argmax_group(c: Catalog) -> DataFrame:
    return ops.top_group(c.scan("orders", ["o_custkey", "o_totalprice"]), "o_custkey", F.max("o_totalprice"), "max_order")


@query("select count(*) as cnt, round(sum(o_totalprice),2) as sum1 from orders where o_orderdate < date '1995-03-15'")
def filter_agg(c: Catalog) -> DataFrame:
    return (
        Plan.scan(c, "orders", "o_orderdate", "o_totalprice").where(F.col("o_orderdate") < _day("1995-03-15"))
        .aggregate(ops.count("cnt"), F.round(F.sum("o_totalprice"), 2).alias("sum1")).df
    )


@query("select cast(o_orderdate as date) as o_orderdate, count(*) as cnt, round(avg(o_totalprice),4) as avg_price, max(o_custkey) as max_cust from orders where o_orderdate < date '1995-03-15' group by o_orderdate order by o_orderdate")
def group(c: Catalog) -> DataFrame:
    return (
        Plan.scan(c, "orders", "o_orderdate", "o_totalprice", "o_custkey").where(F.col("o_orderdate") < _day("1995-03-15"))
        .map(F.col("o_orderdate"), "o_orderdate", "date")
        .group_by(["o_orderdate"], ops.count("cnt"), F.round(F.avg("o_totalprice"), 4).alias("avg_price"), ops.max_("o_custkey", "max_cust"))
        .sort(["o_orderdate"]).df
    )


@query("select l_returnflag, count(*) as cnt from lineitem group by l_returnflag")
def group_lowcard(c: Catalog) -> DataFrame:
    return Plan.scan(c, "lineitem", "l_returnflag").group_by(["l_returnflag"], ops.count("cnt")).df


@query("select o_custkey, count(*) as cnt from orders group by o_custkey having count(*) > 12")
def group_having(c: Catalog) -> DataFrame:
    return Plan.scan(c, "orders", "o_custkey").group_by(["o_custkey"], ops.count("cnt"), having=F.col("cnt") > 12).df


@query("select o_orderstatus, cast(sum(o_custkey) // count(o_custkey) as bigint) as avg_cust from orders group by o_orderstatus")
def avg_truncated(c: Catalog) -> DataFrame:
    return Plan.scan(c, "orders", "o_orderstatus", "o_custkey").group_by(["o_orderstatus"], ops.avg("o_custkey", "avg_cust", truncate=True)).df


@query("select n_name, n_regionkey, n_regionkey + 5 as nrnew from nation where n_regionkey < 2")
def map(c: Catalog) -> DataFrame:  # noqa: A001
    return (
        Plan.scan(c, "nation", "n_name", "n_regionkey").where(call("less", "n_regionkey", 2))
        .map(call("plus", "n_regionkey", 5), "nrnew", "int").df
    )


@query("select l_quantity, l_extendedprice, l_orderkey from lineitem order by l_quantity, l_extendedprice, l_orderkey limit 10 offset 5000")
def sort_page(c: Catalog) -> DataFrame:
    keys = ["l_quantity", "l_extendedprice", "l_orderkey"]
    return Plan.scan(c, "lineitem", *keys).sort(keys).page(5000, 10).df


@query("select l_quantity, l_extendedprice, l_orderkey from lineitem order by l_quantity, l_extendedprice, l_orderkey limit 10")
def topk(c: Catalog) -> DataFrame:
    return Plan.scan(c, "lineitem").top_k(["l_quantity", "l_extendedprice", "l_orderkey"], 10).df


@query("select o_orderkey, o_totalprice, o_custkey from orders order by o_orderkey, o_totalprice, o_custkey limit 100000")
def topk_largek(c: Catalog) -> DataFrame:
    return Plan.scan(c, "orders").top_k(["o_orderkey", "o_totalprice", "o_custkey"], 100000).df


def _lines_by_price_and_discount(c: Catalog) -> Plan:
    return (
        Plan.scan(c, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
        .where(F.col("l_quantity") * F.col("l_extendedprice") * F.col("l_discount") > 300000)
    )


@query("with f as (select l_orderkey, l_quantity, l_discount from lineitem where l_orderkey < 1000000) select l_orderkey, l_quantity, l_discount from f o where not exists (select 1 from f i where i.l_quantity <= o.l_quantity and i.l_discount <= o.l_discount and (i.l_quantity < o.l_quantity or i.l_discount < o.l_discount))")
def pareto_2d_lowcard(c: Catalog) -> DataFrame:
    return (
        Plan.scan(c, "lineitem", "l_orderkey", "l_quantity", "l_discount").where(F.col("l_orderkey") < 1000000)
        .pareto(["l_quantity", "l_discount"]).df
    )


@query("with f as (select l_orderkey, l_quantity, l_extendedprice from lineitem where l_orderkey < 10000000 and l_quantity*l_extendedprice > 400000) select l_orderkey, l_quantity, l_extendedprice from f o where not exists (select 1 from f i where i.l_quantity <= o.l_quantity and i.l_extendedprice <= o.l_extendedprice and (i.l_quantity < o.l_quantity or i.l_extendedprice < o.l_extendedprice))")
def pareto_2d_price(c: Catalog) -> DataFrame:
    return (
        Plan.scan(c, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice")
        .where((F.col("l_orderkey") < 10000000) & (F.col("l_quantity") * F.col("l_extendedprice") > 400000))
        .pareto(["l_quantity", "l_extendedprice"]).df
    )


_P3 = "with f as (select l_orderkey, l_quantity, l_extendedprice, l_discount from lineitem where l_quantity*l_extendedprice*l_discount > 300000) select l_orderkey, l_quantity, l_extendedprice, l_discount from f o where not exists (select 1 from f i where i.l_quantity <= o.l_quantity and i.l_extendedprice <= o.l_extendedprice and i.l_discount <= o.l_discount and (i.l_quantity < o.l_quantity or i.l_extendedprice < o.l_extendedprice or i.l_discount < o.l_discount))"


@query(_P3)
def pareto_3d(c: Catalog) -> DataFrame:
    return _lines_by_price_and_discount(c).pareto(["l_quantity", "l_extendedprice", "l_discount"]).df


@query(_P3 + " order by l_orderkey, l_quantity, l_extendedprice, l_discount limit 10 offset 10")
def pareto_3d_page(c: Catalog) -> DataFrame:
    return (
        _lines_by_price_and_discount(c).pareto(["l_quantity", "l_extendedprice", "l_discount"])
        .sort(["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"]).page(10, 10).df
    )


def _order_lines(c: Catalog, above: int) -> DataFrame:
    orders = Plan.scan(c, "orders", "o_orderkey", "o_totalprice").where(F.col("o_totalprice") > above)
    return (
        orders.join(Plan.scan(c, "lineitem", "l_orderkey", "l_discount"), ["o_orderkey"], ["l_orderkey"])
        .aggregate(ops.count("cnt"), F.round(F.sum(F.col("o_totalprice") - F.col("l_discount")), 2).alias("total")).df
    )


@query("select count(*) as cnt, round(sum(o_totalprice - l_discount),2) as total from orders o join lineitem l on l_orderkey = o_orderkey where o_totalprice > 1000")
def join_count_sum(c: Catalog) -> DataFrame:
    return _order_lines(c, 1000)


@query("select count(*) as cnt, round(sum(o_totalprice - l_discount),2) as total from orders o join lineitem l on l_orderkey = o_orderkey where o_totalprice > 400000")
def join_count_sum_sel(c: Catalog) -> DataFrame:
    return _order_lines(c, 400000)


@query("with partsupp as (select l_partkey as ps_partkey, l_suppkey as ps_suppkey, max(l_extendedprice) as ps_supplycost from lineitem group by l_partkey, l_suppkey) select o_orderkey, ps_partkey, ps_suppkey, o_totalprice, l_extendedprice, ps_supplycost from orders join lineitem on o_orderkey = l_orderkey join partsupp on ps_partkey = l_partkey and ps_suppkey = l_suppkey where o_totalprice * 1.03 < l_extendedprice and l_extendedprice * 1.03 < ps_supplycost")
def hashjoin_3way(c: Catalog) -> DataFrame:
    supplies = Plan.scan(c, "partsupp")
    lines = Plan.scan(c, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    priced = supplies.join(lines, ["ps_partkey", "ps_suppkey"], ["l_partkey", "l_suppkey"],
                           F.col("l_extendedprice") * F.lit(1.03) < F.col("ps_supplycost"))
    orders = Plan.scan(c, "orders", "o_orderkey", "o_totalprice")
    return (
        orders.join(priced, ["o_orderkey"], ["l_orderkey"], F.col("o_totalprice") * F.lit(1.03) < F.col("l_extendedprice"))
        .select("o_orderkey", "ps_partkey", "ps_suppkey", "o_totalprice", "l_extendedprice", "ps_supplycost").df
    )


@query("select o_totalprice, l_extendedprice from orders join lineitem on o_totalprice = l_extendedprice and o_totalprice = l_suppkey where o_totalprice > 0")
def hashjoin_selective(c: Catalog) -> DataFrame:
    orders = Plan.scan(c, "orders", "o_totalprice").where(F.col("o_totalprice") > 0)
    lines = Plan.scan(c, "lineitem", "l_extendedprice", "l_suppkey")
    return orders.join(lines, ["o_totalprice", "o_totalprice"], ["l_extendedprice", "l_suppkey"]).select("o_totalprice", "l_extendedprice").df


@query("select o_totalprice, l_extendedprice from orders join lineitem on o_totalprice = l_extendedprice where o_totalprice > 0")
def hashjoin_double_key(c: Catalog) -> DataFrame:
    orders = Plan.scan(c, "orders", "o_totalprice").where(F.col("o_totalprice") > 0)
    return orders.join(Plan.scan(c, "lineitem", "l_extendedprice"), ["o_totalprice"], ["l_extendedprice"]).df


@query("select n_name, cast(count(*) as bigint) as suppliers from nation join supplier on n_nationkey = s_nationkey group by n_name")
def join_dimension(c: Catalog) -> DataFrame:
    nations = Plan.scan(c, "nation", "n_nationkey", "n_name")
    return nations.join(Plan.scan(c, "supplier", "s_nationkey"), ["n_nationkey"], ["s_nationkey"]).group_by(["n_name"], ops.count("suppliers")).df


@query("select cast(sum(id) as bigint) as s from range(1, 1000000001) as t(id)")
def range_sum(c: Catalog) -> DataFrame:
    return ops.global_aggregate(c.spark.range(1, 1000000001), ops.sum_("id", "s"))


@query("select count(distinct o_custkey) as ndv from orders")
def distinct_groups(c: Catalog) -> DataFrame:
    return Plan.scan(c, "orders", "o_custkey").aggregate(ops.ndv_exact("o_custkey", "ndv")).df


@query("select true as close, count(distinct o_custkey) as ndv from orders")
def distinct_groups_approx(c: Catalog) -> DataFrame:
    """Whether the estimate is within a tenth of the exact number, and that number."""
    both = Plan.scan(c, "orders", "o_custkey").aggregate(ops.ndv("o_custkey", "guess"), ops.ndv_exact("o_custkey", "ndv")).df
    return both.select((F.abs(F.col("guess") - F.col("ndv")) <= F.col("ndv") / 10).alias("close"), "ndv")


@query("select true as close, count(distinct o_custkey) as ndv from orders")
def distinct_groups_merged(c: Catalog) -> DataFrame:
    """As above from one sketch for each order status, merged."""
    orders = c.scan("orders", ["o_orderstatus", "o_custkey"])
    sketches = ops.group_by(orders, ["o_orderstatus"], ops.ndv_sketch("o_custkey", "sketch"))
    guess = ops.global_aggregate(sketches, ops.ndv_merged("sketch", "guess"))
    exact = ops.global_aggregate(orders, ops.ndv_exact("o_custkey", "ndv"))
    both = guess.withColumn("one", F.lit(1)).join(exact.withColumn("other", F.lit(1)), F.col("one") == F.col("other"))
    return both.select((F.abs(F.col("guess") - F.col("ndv")) <= F.col("ndv") / 10).alias("close"), "ndv")


@query("select l_quantity as c1, l_linenumber as c2, l_orderkey as c3 from lineitem order by 1, 2, 3")
def merge_sorted_runs(c: Catalog) -> DataFrame:
    lines = c.scan("lineitem", ["l_quantity", "l_linenumber", "l_orderkey", "l_returnflag"])
    cols = [F.col("l_quantity").alias("c1"), F.col("l_linenumber").alias("c2"), F.col("l_orderkey").alias("c3")]
    flag = F.col("l_returnflag")
    runs = [lines.filter(flag == f).select(*cols) for f in ("A", "N", "R")]
    runs.append(lines.filter(flag.isNull() | ~flag.isin("A", "N", "R")).select(*cols))
    return ops.merge_runs(runs, ["c1", "c2", "c3"])


@query("select l_orderkey, l_linenumber, cast(case when q <> pq then 1000 - pq else 2000 - pn end as bigint) as ovc from (select l_orderkey, l_linenumber, cast(l_quantity as bigint) q, lag(cast(l_quantity as bigint)) over w pq, lag(l_linenumber) over w pn from lineitem window w as (partition by l_orderkey order by cast(l_quantity as bigint), l_linenumber)) t where pq is not null")
def offset_value_codes(c: Catalog) -> DataFrame:
    lines = c.scan("lineitem", ["l_orderkey", "l_linenumber", "l_quantity"]).withColumn("q", F.col("l_quantity").cast("long"))
    w = Window.partitionBy("l_orderkey").orderBy("q", "l_linenumber")
    lines = lines.withColumns({"pq": F.lag("q").over(w), "pn": F.lag("l_linenumber").over(w)}).filter("pq is not null")
    code = ops.offset_value_code([F.col("pq"), F.col("pn")], [F.col("q"), F.col("l_linenumber")])
    return lines.select("l_orderkey", "l_linenumber", code.cast("long").alias("ovc"))


@query("select cast((((id * 48271 + 69663) % 2147483647) * 16807 % 2147483647) % 1000 as int) as c1, cast((((id * 48271 + 139284) % 2147483647) * 16807 % 2147483647) % 1000 as int) as c2, cast((((id * 48271 + 208905) % 2147483647) * 16807 % 2147483647) % 1000 as int) as c3, cast((((id * 48271 + 278526) % 2147483647) * 16807 % 2147483647) % 1000 as int) as c4, cast((((id * 48271 + 348147) % 2147483647) * 16807 % 2147483647) % 1000 as int) as c5 from range(16000) as t(id) order by 1, 2, 3, 4, 5")
def generated_runs(c: Catalog) -> DataFrame:
    cols = [f"c{i}" for i in range(1, 6)]
    return ops.merge_runs(sorted_tuple_runs(c.spark, 16, 1000), cols).select(*cols)


@query("select n_nationkey || ' ' || n_name as value from nation order by n_nationkey limit 5 offset 3")
def print_rows(c: Catalog) -> DataFrame:
    return text_rows(c.scan("nation", ["n_nationkey", "n_name"]).orderBy("n_nationkey"), ["n_nationkey", "n_name"], 3, 5)


@query("select distinct cast(o_orderdate as date) as d, cast(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) + 2440588 as int) as jdn, cast(o_orderdate as date) as back, cast(o_orderdate as date) as parsed from orders")
def date_functions(c: Catalog) -> DataFrame:
    d = c.dates("orders", ["o_orderdate"]).select(F.col("o_orderdate").alias("d")).distinct()
    return d.select("d", julian_day(F.col("d")).alias("jdn"), from_julian_day(julian_day(F.col("d"))).alias("back"),
                    lenient_date(F.col("d").cast("string")).alias("parsed"))


@query("select o_orderkey, make_date(1995, cast(1 + o_orderkey % 12 as int), 1) + cast(o_orderkey % 31 as int) as d from orders")
def lenient_dates(c: Catalog) -> DataFrame:
    text = F.concat(F.lit("1995-"), 1 + F.col("o_orderkey") % 12, F.lit("-"), 1 + F.col("o_orderkey") % 31)
    return c.scan("orders", ["o_orderkey"]).select("o_orderkey", lenient_date(text).alias("d"))


@query("select count(*) as cnt, max(o_custkey) as top from orders where o_orderkey < 0 having count(*) > 0")
def global_agg_empty(c: Catalog) -> DataFrame:
    none = Plan.scan(c, "orders", "o_orderkey", "o_custkey").where(F.col("o_orderkey") < 0)
    return none.aggregate(ops.count("cnt"), ops.max_("o_custkey", "top"), empty_rows=0).df


@query("select o_totalprice, o_orderkey from orders order by o_totalprice desc, o_orderkey desc limit 25")
def sort_desc(c: Catalog) -> DataFrame:
    return Plan.scan(c, "orders", "o_totalprice", "o_orderkey").sort(["o_totalprice", "o_orderkey"], desc=True).page(0, 25).df


@query("select r_name, sum(l_quantity) as qty, cast(count(*) as bigint) as lines from region join nation on r_regionkey = n_regionkey join customer on n_nationkey = c_nationkey join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey where o_totalprice > 300000 group by r_name")
def join_bushy(c: Catalog) -> DataFrame:
    places = Plan.scan(c, "region", "r_regionkey", "r_name").join(Plan.scan(c, "nation", "n_nationkey", "n_regionkey"), ["r_regionkey"], ["n_regionkey"])
    people = places.join(Plan.scan(c, "customer", "c_custkey", "c_nationkey"), ["n_nationkey"], ["c_nationkey"])
    big = Plan.scan(c, "orders", "o_orderkey", "o_custkey", "o_totalprice").where(F.col("o_totalprice") > 300000)
    lines = big.join(Plan.scan(c, "lineitem", "l_orderkey", "l_quantity"), ["o_orderkey"], ["l_orderkey"])
    return people.join(lines, ["c_custkey"], ["o_custkey"]).group_by(["r_name"], ops.sum_("l_quantity", "qty"), ops.count("lines")).df


@query("with best as (select l_quantity as q, max(l_extendedprice) as p from lineitem group by l_quantity), before as (select q, p, max(p) over (order by q rows between unbounded preceding and 1 preceding) as ahead from best) select l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem join before on q = l_quantity and p = l_extendedprice where ahead is null or ahead < p")
def pareto_min_max(c: Catalog) -> DataFrame:
    return Plan.scan(c, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").pareto(["l_quantity", "-l_extendedprice"]).df


@query("select l_orderkey, l_linenumber, ceil(l_extendedprice*100)/100 as price, l_linenumber - 1 as minus, l_orderkey % 7 as modulus, cast(l_orderkey // 7 as bigint) as quotient, -l_linenumber as negated, (l_quantity >= 25 and not l_discount > 0.05) as flag, l_orderkey & 12 as bits from lineitem")
def scalar_functions(c: Catalog) -> DataFrame:
    flag = call("logical_and", call("greater_equal", "l_quantity", 25.0), call("logical_not", call("greater", "l_discount", 0.05)))
    return c.scan("lineitem").select(
        "l_orderkey", "l_linenumber", round_up_cents(F.col("l_extendedprice")).alias("price"),
        call("minus", "l_linenumber", 1).alias("minus"), call("modulus", "l_orderkey", F.lit(7).cast("long")).alias("modulus"),
        call("int_divides", "l_orderkey", F.lit(7).cast("long")).alias("quotient"), call("negate", "l_linenumber").alias("negated"),
        flag.alias("flag"), call("bit_and", "l_orderkey", F.lit(12).cast("long")).alias("bits"),
    )


def _scan(table: str, columns: list[str]) -> None:
    cols = {c: f"cast({c} as date) as {c}" if c.endswith("date") else c for c in columns}

    def fn(c: Catalog) -> DataFrame:
        return c.dates(table, columns)

    QUERIES[f"scan_{table}"] = lambda spark, sf_dir: fn(Catalog(spark, sf_dir))
    ORACLES[f"scan_{table}"] = f"select {', '.join(cols.values())} from {table}"


for _t, _schema in SCHEMAS.items():
    _scan(_t, _schema.names)


@query("select l_orderkey, l_linenumber, l_quantity * l_extendedprice as product, l_extendedprice / l_quantity as quotient, l_orderkey // 3 as whole, l_linenumber = 2 as same, l_linenumber <> 2 as other, l_linenumber <= 2 as most, (l_linenumber = 2 or l_quantity < 10) as either_one, l_orderkey | 12 as bits_or, xor(l_orderkey, 12) as bits_xor from lineitem")
def registry_functions(c: Catalog) -> DataFrame:
    long = lambda n: F.lit(n).cast("long")
    return c.scan("lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]).select(
        "l_orderkey", "l_linenumber", call("multiplies", "l_quantity", "l_extendedprice").alias("product"), call("divides", "l_extendedprice", "l_quantity").alias("quotient"),
        call("int_divides", "l_orderkey", long(3)).alias("whole"), call("equal_to", "l_linenumber", 2).alias("same"), call("not_equal_to", "l_linenumber", 2).alias("other"),
        call("less_equal", "l_linenumber", 2).alias("most"), call("logical_or", call("equal_to", "l_linenumber", 2), call("less", "l_quantity", 10.0)).alias("either_one"),
        call("bit_or", "l_orderkey", long(12)).alias("bits_or"), call("bit_xor", "l_orderkey", long(12)).alias("bits_xor"),
    )


@query("select l_returnflag as flag, l_linestatus as status, count(*) as cnt from lineitem where length(l_returnflag) = 1 group by all")
def char_groups(c: Catalog) -> DataFrame:
    """Columns of one character, read by the checking parser."""
    lines = c.scan("lineitem", ["l_returnflag", "l_linestatus"]).select(one_char(F.col("l_returnflag")).alias("flag"), one_char(F.col("l_linestatus")).alias("status"))
    return ops.group_by(lines, ["flag", "status"], ops.count("cnt"))


@query("select l_returnflag, l_linenumber, count(*) as cnt from lineitem group by all")
def hash_groups(c: Catalog) -> DataFrame:
    """Groups of equal word and tuple hashes are the groups of equal tuples."""
    lines = c.scan("lineitem", ["l_returnflag", "l_linenumber"]).withColumns({"one": call("hash", "l_linenumber"), "both": call("hash", "l_returnflag", "l_linenumber")})
    per = lines.groupBy("one", "both").agg(F.min("l_returnflag").alias("l_returnflag"), F.max("l_linenumber").alias("l_linenumber"), ops.count("cnt"))
    return per.drop("one", "both")


@F.pandas_udf(T.LongType())
def _line_tag(order: pd.Series, line: pd.Series) -> pd.Series:
    return order * 10 + line


@query("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as paid, l_orderkey * 10 + l_linenumber as tag from lineitem")
def user_functions(c: Catalog) -> DataFrame:
    """A function given as an expression, and one in Python over Arrow batches."""
    return c.scan("lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"]).select(
        "l_orderkey", "l_linenumber", call(lambda price, off: price * (1 - off), "l_extendedprice", "l_discount").alias("paid"), call(_line_tag, "l_orderkey", "l_linenumber").alias("tag"),
    )


@query("select o_orderkey, o_totalprice, l_linenumber from orders join lineitem on o_orderkey = l_orderkey and o_orderkey = l_suppkey")
def join_repeated_key(c: Catalog) -> DataFrame:
    orders = Plan.scan(c, "orders", "o_orderkey", "o_totalprice")
    lines = Plan.scan(c, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber")
    return orders.join(lines, ["o_orderkey", "o_orderkey"], ["l_orderkey", "l_suppkey"]).select("o_orderkey", "o_totalprice", "l_linenumber").df


@query("select l_quantity, l_extendedprice, l_orderkey from lineitem order by l_quantity, l_extendedprice, l_orderkey limit 10 offset (select count(*) - 2000 from lineitem)")
def sort_deep_page(c: Catalog) -> DataFrame:
    """A page near the end of the table."""
    keys = ["l_quantity", "l_extendedprice", "l_orderkey"]
    lines = c.scan("lineitem", keys)
    return ops.deep_page(lines, keys, lines.count() - 2000, 10, heap_rows=1000)


def _column_files(table: str) -> None:
    """Writes a table as column files and reads it back."""

    def fn(c: Catalog) -> DataFrame:
        path = scratch_folder(c.spark, table)
        rows = c.dates(table)
        write_columns(rows, path)
        register_columnfile(c.spark)
        return c.spark.read.format("columnfile").schema(rows.schema).load(path)

    QUERIES[f"columnfile_{table}"] = lambda spark, sf_dir: fn(Catalog(spark, sf_dir))
    ORACLES[f"columnfile_{table}"] = ORACLES[f"scan_{table}"]


for _t in ("nation", "orders", "part"):
    _column_files(_t)

"""Grouped and global aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def sum_(column: str | Column, name: str) -> Column:
    return F.sum(column).alias(name)


def max_(column: str | Column, name: str) -> Column:
    return F.max(column).alias(name)


def avg(column: str, name: str, truncate: bool = False) -> Column:
    """The mean as a double; truncate=True gives the integer quotient of an integer column."""
    if truncate:
        return F.call_function("div", F.sum(column), F.count(column)).alias(name)
    return F.avg(column).alias(name)


def ndv(column: str, name: str, rsd: float = 0.05) -> Column:
    """HyperLogLog++ estimate; partial sketches merge before the shuffle."""
    return F.approx_count_distinct(column, rsd).alias(name)


def ndv_sketch(column: str, name: str, bits: int = 12) -> Column:
    """A HyperLogLog sketch that can be kept and merged with others."""
    return F.hll_sketch_agg(column, bits).alias(name)


def ndv_merged(sketch: str, name: str) -> Column:
    """The estimate of all sketches together."""
    return F.hll_sketch_estimate(F.hll_union_agg(sketch)).alias(name)


def ndv_exact(column: str, name: str) -> Column:
    return F.count_distinct(column).alias(name)


def group_by(df: DataFrame, keys: list[str], *aggregates: Column, having: Column | None = None) -> DataFrame:
    out = df.groupBy(*keys).agg(*aggregates)
    return out if having is None else out.filter(having)


def global_aggregate(df: DataFrame, *aggregates: Column, empty_rows: int = 1) -> DataFrame:
    """One row; for empty input one row as in SQL, or none with empty_rows=0."""
    if empty_rows:
        return df.agg(*aggregates)
    out = df.agg(F.count(F.lit(1)).alias("_n"), *aggregates)
    return out.filter("_n > 0").drop("_n")


def top_group(df: DataFrame, key: str, aggregate: Column, name: str) -> DataFrame:
    """The group whose aggregate is largest; ties go to the smallest key."""
    return df.groupBy(key).agg(aggregate.alias(name)).orderBy(F.desc(name), F.asc(key)).limit(1)

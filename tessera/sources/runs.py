"""Seeded generators of sorted runs for merge queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Modulus and factors of the minimal standard generator and its revision.
_MODULUS, _FACTOR, _OTHER = 2147483647, 48271, 16807


def _uniform(row: Column, column: int, seed: int, top: int) -> Column:
    """An integer in 0..top-1; exact in 64 bits for rows below 2^47."""
    once = (row * _FACTOR + F.lit((column + 1) * 69621 + seed).cast("long")) % _MODULUS
    return (once * _OTHER % _MODULUS % top).cast("int")


def sorted_int_runs(spark: SparkSession, runs: int, size: int, top: int = 1000, seed: int = 42) -> DataFrame:
    """(run_id, pos, c1): `runs` ascending runs of `size` uniform ints in 0..top-1."""
    return sorted_tuple_runs(spark, runs, size, 1, top, seed)


def sorted_tuple_runs(spark: SparkSession, runs: int, size: int, width: int = 5, top: int = 1000, seed: int = 42) -> DataFrame:
    """(run_id, pos, c1..cN): lexicographically ascending runs of tuples.

    Values come from two rounds of a congruential generator over row and
    column, so they do not depend on partitioning.
    """
    cols = [f"c{i + 1}" for i in range(width)]
    df = spark.range(runs * size).select(
        (F.col("id") / size).cast("int").alias("run_id"),
        *[_uniform(F.col("id"), i, seed, top).alias(c) for i, c in enumerate(cols)],
        F.col("id").alias("_row"),
    )
    w = Window.partitionBy("run_id").orderBy(*cols, "_row")
    return df.select("run_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), *cols)

"""Filter, computed column, projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def where(df: DataFrame, predicate: Column) -> DataFrame:
    return df.filter(predicate)


def compute(df: DataFrame, expression: Column, name: str, kind: str) -> DataFrame:
    """Adds a column of a declared type; a double cast to an int type is truncated."""
    return df.withColumn(name, expression.cast(kind))


def project(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)

"""Sinks: space-separated text rows and Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sorting import page


def text_rows(df: DataFrame, columns: list[str], offset: int = 0, count: int = -1) -> DataFrame:
    """One `value` string per row, columns parted by a space; count -1 keeps all rows."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return page(df, offset, count).select(F.concat_ws(" ", *cells).alias("value"))


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)

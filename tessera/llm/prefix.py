"""Running sums over huge orders: totals of hash buckets, then sums inside each bucket.

No task holds more than one bucket's rows, the totals of SPAN buckets, or one
key's sums of SPAN buckets, so a key with a third of all rows is summed by many
tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 4096
# Buckets whose totals are summed together.
SPAN = 4096


def bucket_count(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_BUCKET))


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds `out`: the inclusive sum of `value` by keys, ordered by (bucket, *order).

    `order` must be total inside (keys, bucket); keys and bucket must not be
    null, and bucket is an integer from 0.
    """
    earlier = lambda by, c: Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_total")).withColumn("_span", F.floor(F.col(bucket) / SPAN))
    spans = totals.groupBy(*keys, "_span").agg(F.sum("_total").alias("_all"))
    spans = spans.select(*keys, "_span", F.coalesce(F.sum("_all").over(earlier(keys, "_span")), F.lit(0)).alias("_ahead"))
    totals = totals.withColumn("_near", F.coalesce(F.sum("_total").over(earlier([*keys, "_span"], bucket)), F.lit(0)))
    totals = totals.join(spans, [*keys, "_span"]).select(*keys, bucket, (F.col("_ahead") + F.col("_near")).alias("_before"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("_inside", F.sum(value).over(inside))
    return summed.join(totals, [*keys, bucket]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_before", "_inside")

"""Sort, paging, top-k, merge of sorted runs, offset-value codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort(df: DataFrame, keys: list[str], desc: bool = False) -> DataFrame:
    return df.orderBy(*keys, ascending=not desc)


def page(df: DataFrame, offset: int = 0, count: int = -1) -> DataFrame:
    """Rows offset..offset+count-1; -1 is all.  Over a total order the page is fixed."""
    if offset:
        df = df.offset(offset)
    return df if count < 0 else df.limit(count)


# Offsets up to this are left to a heap in each task.
_HEAP_ROWS = 100_000
_RANGES = 256


def deep_page(df: DataFrame, keys: list[str], offset: int, count: int, heap_rows: int = _HEAP_ROWS) -> DataFrame:
    """Rows offset..offset+count-1 of df by ascending numeric keys (nulls first), for offsets of any size.

    Ranges of the first key are counted; only those that hold the page are
    sorted.  A range of one value goes on with the next key.  No task or heap
    holds the rows before the page.
    """
    if offset + count <= heap_rows or not keys:
        return page(sort(df, keys) if keys else df, offset, count)
    key = keys[0]
    # At most _RANGES bounds and as many counts.
    found = df.agg(F.percentile_approx(key, [i / _RANGES for i in range(1, _RANGES)], 10_000)).first()[0]
    bounds = sorted(set(found or []))
    number = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x < F.col(key)))) if bounds else F.lit(-1)
    per = df.groupBy(number.alias("_p")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy("_p").collect()
    before, used = 0, []
    for r in per:
        if before + r.n > offset and before < offset + count:
            used.append((before, r))
        before += r.n
    if not used:
        return df.limit(0)
    skip, first = used[0]
    alone = len(used) == 1 and first.low == first.high
    low, high = first.low, used[-1][1].high
    within = F.col(key).isNull() if high is None else F.col(key) <= high
    if high is not None:
        within = within & (F.col(key) >= low) if low is not None else within | F.col(key).isNull()
    if alone and len(keys) > 1:
        return deep_page(df.filter(within), keys[1:], offset - skip, count, heap_rows)
    return page(sort(df.filter(within), keys), offset - skip, count)


def top_k(df: DataFrame, keys: list[str], k: int, desc: bool = False) -> DataFrame:
    """The first k rows by keys, key columns only: a bounded heap in each task, then one merge."""
    return df.select(*keys).orderBy(*keys, ascending=not desc).limit(k)


def merge_runs(runs: list[DataFrame] | DataFrame, keys: list[str], desc: bool = False) -> DataFrame:
    """One ordered frame from runs: range exchange, then each partition's external merge sort."""
    df = runs if isinstance(runs, DataFrame) else reduce(DataFrame.unionByName, runs)
    return df.orderBy(*keys, ascending=not desc)


def offset_value_code(previous: list[Column], current: list[Column], base: int = 1000) -> Column:
    """base*(i+1) - previous[i] at the first column i where the tuples differ, else at the last column."""
    if len(previous) != len(current) or not current:
        raise ValueError("tuples need equal, positive width")
    n = len(current)
    out = F.lit(base * n) - previous[n - 1]
    for i in range(n - 2, -1, -1):
        out = F.when(previous[i] != current[i], F.lit(base * (i + 1)) - previous[i]).otherwise(out)
    return out

"""Pareto (skyline) filter: rows that no other row dominates.

Every dimension is minimised (prefix a column with "-" to maximise it).  A key
tuple is dropped if another, different tuple is at most as large in every
dimension.  All rows that share a surviving tuple stay, with all their
columns.  A tuple that holds a null neither dominates nor is dominated.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Survivors are gathered in rounds of this many partitions to one.
_FAN_IN = 8
_BLOCK = 1024


def _dominated(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which points some row of `by` is at most as large as in every dimension."""
    out = np.zeros(len(points), dtype=bool)
    for at in range(0, len(by), _BLOCK):
        left = np.flatnonzero(~out)
        if not len(left):
            break
        out[left] = (by[at : at + _BLOCK, None, :] <= points[None, left, :]).all(axis=2).any(axis=0)
    return out


def _frontier(points: np.ndarray) -> np.ndarray:
    """Places of undominated rows among distinct rows.

    In lexicographic order a row comes after all that dominate it, so each
    block is compared with the frontier so far and with itself.
    """
    order = np.lexsort(points.T[::-1])
    kept: list[np.ndarray] = []
    front = np.empty((0, points.shape[1]), dtype=points.dtype)
    for at in range(0, len(order), _BLOCK):
        block = order[at : at + _BLOCK]
        block = block[~_dominated(points[block], front)]
        p = points[block]
        smaller = (p[:, None, :] <= p[None, :, :]).all(axis=2)
        np.fill_diagonal(smaller, False)
        block = block[~smaller.any(axis=0)]
        kept.append(block)
        front = np.concatenate([front, points[block]])
    return np.concatenate(kept) if kept else np.empty(0, dtype=np.int64)


def _local(dims: list[str]):
    def run(batches):
        best: pd.DataFrame | None = None
        for batch in batches:
            both = batch if best is None else pd.concat([best, batch], ignore_index=True)
            both = both.drop_duplicates(dims, ignore_index=True)
            best = both.iloc[_frontier(both[dims].to_numpy())].reset_index(drop=True)
        if best is not None:
            yield best
    return run


def _two_dims(keys: DataFrame, a: str, b: str) -> DataFrame:
    """Sweep: least b for each a, then those below every smaller a's b.

    The running minimum is taken inside ranges of a and over the ranges, so no
    task sorts the whole input.  Ranges have fixed bounds, one for each shuffle
    partition, so a task that runs again deals rows alike.
    """
    least = keys.groupBy(a).agg(F.min(b).alias(b))
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # At most one bound for each shuffle partition.
    bounds = keys.agg(F.percentile_approx(a, [i / n for i in range(1, n)] or [0.5], 1000)).first()[0]
    number = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(bounds or []))]), lambda x: x <= F.col(a))) if bounds else F.lit(0)
    ranged = least.withColumn("_p", number)
    before = (
        ranged.groupBy("_p").agg(F.min(b).alias("_m"))
        .withColumn("_before", F.min("_m").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
        .select("_p", "_before")
    )
    inside = F.min(b).over(Window.partitionBy("_p").orderBy(a).rowsBetween(Window.unboundedPreceding, -1))
    out = ranged.withColumn("_in", inside).join(before, "_p", "left")
    limit = F.least("_in", "_before")
    return out.filter(limit.isNull() | (F.col(b) < limit)).select(a, b)


def _gathered(keys: DataFrame, dims: list[str]) -> DataFrame:
    """Local frontiers, merged in rounds of shrinking partition count with an exchange between them."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = keys.mapInPandas(_local(dims), keys.schema)
    while n > 1:
        n = max(1, n // _FAN_IN)
        out = out.repartition(n).mapInPandas(_local(dims), keys.schema)
    return out


def _anti(keys: DataFrame, dims: list[str]) -> DataFrame:
    """The definition as an anti-join of distinct keys; for small inputs and for tests."""
    a, b = keys.alias("a"), keys.alias("b")
    le = reduce(lambda x, y: x & y, [F.col(f"b.{d}") <= F.col(f"a.{d}") for d in dims])
    lt = reduce(lambda x, y: x | y, [F.col(f"b.{d}") < F.col(f"a.{d}") for d in dims])
    return a.join(b, le & lt, "left_anti")


def pareto(df: DataFrame, keys: list[str], strategy: str = "auto") -> DataFrame:
    """Undominated rows of df by keys.

    strategy: "sweep" (two dimensions), "gather" (any number) or "anti"; "auto"
    takes sweep for two dimensions and gather otherwise.  Keys must be numeric.
    """
    names = [k.lstrip("-") for k in keys]
    if not names:
        raise ValueError("pareto needs a key")
    dims = [f"_d{i}" for i in range(len(names))]
    # -0.0 and 0.0 are one value; adding 0.0 makes them one bit pattern.
    value = lambda k, n: -F.col(n) if k.startswith("-") else F.col(n)
    tagged = df.withColumns({d: value(k, n) for d, k, n in zip(dims, keys, names)})
    distinct = tagged.select(*dims)
    full = reduce(lambda x, y: x & y, [F.col(d).isNotNull() for d in dims])
    distinct = distinct.filter(full).distinct()
    if strategy == "auto":
        strategy = "sweep" if len(dims) == 2 else "gather"
    if strategy == "sweep":
        if len(dims) != 2:
            raise ValueError("sweep takes two dimensions")
        best = _two_dims(distinct, *dims)
    elif strategy == "gather":
        best = _gathered(distinct, dims)
    elif strategy == "anti":
        best = _anti(distinct, dims)
    else:
        raise ValueError(f"no strategy {strategy}")
    best = best.select(*[F.col(d).alias(f"_k{d}") for d in dims])
    on = reduce(lambda x, y: x & y, [F.col(d) == F.col(f"_k{d}") for d in dims])
    kept = tagged.filter(full).join(best, on, "left_semi")
    return kept.unionByName(tagged.filter(~full)).select(*df.columns)

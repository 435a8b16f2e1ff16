"""Inner equi-join with composite or repeated keys and a residual predicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame


def hash_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str],
              residual: Column | None = None, build: str | None = None) -> DataFrame:
    """Rows of left and right whose keys agree in pairs; bag semantics, null keys drop out.

    A key may be repeated on either side.  Both inputs need distinct column
    names.  Sides are broadcast only by Spark's own size estimate; build="left"
    or "right" asks for a shuffled hash join with that build side, which is
    right where that side's partitions fit in memory.
    """
    if len(left_keys) != len(right_keys) or not left_keys:
        raise ValueError("left_keys and right_keys need equal, positive length")
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}; rename one")
    if build == "left":
        left = left.hint("shuffle_hash")
    elif build == "right":
        right = right.hint("shuffle_hash")
    on = reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in zip(left_keys, right_keys)])
    return left.join(right, on if residual is None else on & residual, "inner")

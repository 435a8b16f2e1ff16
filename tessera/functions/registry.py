"""Named functions over columns: arithmetic, comparison, logic, bits, and user-defined ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _divides(a: Column, b: Column) -> Column:
    """SQL division; for truncating integer division use int_divides."""
    return a / b


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "plus": lambda a, b: a + b,
    "minus": lambda a, b: a - b,
    "multiplies": lambda a, b: a * b,
    "divides": _divides,
    "int_divides": lambda a, b: F.call_function("div", a, b),
    "modulus": lambda a, b: a % b,
    "negate": lambda a: -a,
    "equal_to": lambda a, b: a == b,
    "not_equal_to": lambda a, b: a != b,
    "less": lambda a, b: a < b,
    "less_equal": lambda a, b: a <= b,
    "greater": lambda a, b: a > b,
    "greater_equal": lambda a, b: a >= b,
    "logical_and": lambda a, b: a & b,
    "logical_or": lambda a, b: a | b,
    "logical_not": lambda a: ~a,
    "bit_and": lambda a, b: a.bitwiseAND(b),
    "bit_or": lambda a, b: a.bitwiseOR(b),
    "bit_xor": lambda a, b: a.bitwiseXOR(b),
    "hash": lambda *a: F.xxhash64(*a),
}


def define(name: str, fn: Callable[..., Column]) -> None:
    """Adds a function of columns (a pandas UDF is one too) under a new name."""
    if name in FUNCTIONS:
        raise ValueError(f"{name} is defined")
    FUNCTIONS[name] = fn


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def call(fn: str | Callable[..., Column], *args) -> Column:
    """Applies a named or given function; strings name columns, other values are constants."""
    if isinstance(fn, str):
        if fn not in FUNCTIONS:
            raise KeyError(f"no function {fn}")
        fn = FUNCTIONS[fn]
    return fn(*[_column(a) for a in args])


def round_up_cents(x: Column) -> Column:
    return F.ceil(x * 100) / 100


def one_char(s: Column) -> Column:
    """The text where it is one character long, else an error."""
    return F.when(s.isNull() | (F.length(s) == 1), s).otherwise(F.raise_error(F.concat(F.lit("not one character: "), s)))

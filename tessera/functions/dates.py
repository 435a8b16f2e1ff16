"""Julian day numbers and a lenient date parser, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the Julian day number of 1970-01-01.
JULIAN_DAY_OF_EPOCH = 2440588


def julian_day(d: Column) -> Column:
    return F.unix_date(d) + F.lit(JULIAN_DAY_OF_EPOCH)


def from_julian_day(n: Column) -> Column:
    return F.date_from_unix_date(n - F.lit(JULIAN_DAY_OF_EPOCH))


def lenient_date(s: Column) -> Column:
    """Y-M-D with surrounding spaces; day 1-31 of any month, surplus days roll on.

    2023-02-31 is 2023-03-03.  Text of another form, a year over 9999, a month
    over 12 or a day over 31 gives null.
    """
    text = F.trim(s)
    form = text.rlike(r"^\d{1,4}-\d{1,2}-\d{1,2}$")
    y, m, d = (F.split_part(text, F.lit("-"), F.lit(i)).try_cast("int") for i in (1, 2, 3))
    return F.when(form & m.between(1, 12) & d.between(1, 31), F.date_add(F.make_date(y, m, F.lit(1)), d - 1))

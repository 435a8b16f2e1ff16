from tessera.functions.dates import from_julian_day, julian_day, lenient_date
from tessera.functions.registry import FUNCTIONS, call, define, one_char, round_up_cents

__all__ = ["FUNCTIONS", "call", "define", "from_julian_day", "julian_day", "lenient_date", "one_char", "round_up_cents"]

"""Functions of one or two values, as Column expressions that follow IEEE arithmetic.

ANSI errors and nulls of the builtins are guarded, so a value is never null:
what has no result is NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From here on every double is an integer.
_WHOLE = float(1 << 53)


def nan() -> Column:
    return F.lit(float("nan"))


def inf() -> Column:
    return F.lit(float("inf"))


def _both_real(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b)


def log(v: Column) -> Column:
    return F.when(F.isnan(v), nan()).when(v > 0, F.log(v)).when(v == 0, -inf()).otherwise(nan())


def log10(v: Column) -> Column:
    return F.when(F.isnan(v), nan()).when(v > 0, F.log10(v)).when(v == 0, -inf()).otherwise(nan())


def _to_whole(v: Column, f) -> Column:
    """``f`` to an integral double; what is none below 2^53 passes through."""
    small = ~F.isnan(v) & (F.abs(v) < _WHOLE)
    return F.when(small, f(F.when(small, v).otherwise(0.0)).cast("double")).otherwise(v)


def floor(v: Column) -> Column:
    return _to_whole(v, F.floor)


def ceil(v: Column) -> Column:
    return _to_whole(v, F.ceil)


def round_half_away(v: Column, tolerance: float | None = None) -> Column:
    """Nearest integer; with a tolerance only where the value lies within it."""
    if tolerance is not None and tolerance < 0:
        raise ValueError("the tolerance must not be negative")
    near = _to_whole(v, lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5))
    return near if tolerance is None else F.when(F.abs(v - near) <= tolerance, near).otherwise(v)


def sign(v: Column) -> Column:
    return F.when(F.isnan(v), 0.0).when(v > 0, 1.0).when(v < 0, -1.0).otherwise(0.0)


def limit(v: Column, low: float, high: float) -> Column:
    low, high = min(low, high), max(low, high)
    return F.when(F.isnan(v), v).when(v < low, float(low)).when(v > high, float(high)).otherwise(v)


def round_significant(v: Column, digits: int = 6) -> Column:
    """Rounded for display to a number of significant digits."""
    usable = ~F.isnan(v) & (v != 0) & (F.abs(v) != inf())
    safe = F.when(usable, v).otherwise(1.0)
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(safe))).cast("double") - (digits - 1))
    return F.when(usable, round_half_away(safe / power) * power).otherwise(v)


def as_double(raw: Column) -> Column:
    """A recorded value of any scalar type as the double that all arithmetic uses."""
    return F.coalesce(raw.cast("double"), nan())


UNARY = {
    "Abs": F.abs, "Sqrt": F.sqrt, "Log": log, "Sin": F.sin, "Cos": F.cos, "Tan": F.tan, "Asin": F.asin, "Acos": F.acos, "Atan": F.atan,
    "Exp": F.exp, "Log10": log10, "Floor": floor, "Ceil": ceil, "Round": round_half_away, "Sign": sign, "Negate": lambda v: -v,
}


def divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, nan()).otherwise(F.try_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the sign of ``a``."""
    return F.when(b == 0, nan()).otherwise(F.try_mod(a, b))


def lesser(a: Column, b: Column) -> Column:
    """A NaN in first place stays, one in second place is ignored."""
    return F.when(_both_real(a, b) & (b < a), b).otherwise(a)


def greater(a: Column, b: Column) -> Column:
    return F.when(_both_real(a, b) & (b > a), b).otherwise(a)


BINARY = {
    "Add": lambda a, b: a + b, "Subtract": lambda a, b: a - b, "Multiply": lambda a, b: a * b, "Divide": divide,
    "Power": F.pow, "Mod": modulo, "Atan2": F.atan2, "Min": lesser, "Max": greater,
}


def matches(v: Column, old: float, tolerance: float = 0.0) -> Column:
    """Whether a value is the one looked for, exactly or within the tolerance."""
    tolerance = abs(tolerance)
    same = (v == F.lit(float(old))) if not tolerance else F.abs(v - float(old)) <= tolerance
    return ~F.isnan(v) & same


def replaced(v: Column, new: Column, old: float, tolerance: float = 0.0) -> Column:
    return F.when(matches(v, old, tolerance), new).otherwise(v)

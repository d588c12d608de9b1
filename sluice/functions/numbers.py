"""Arithmetic where the filter language differs from SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MOST = 1.7976931348623157e308  # the largest double, which stands for infinity in output


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """Infinities as the largest doubles, NaN as null."""
    x = _c(x).cast("double")
    return F.when(F.isnan(x), None).otherwise(F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), x)))


def log(x: Column | str) -> Column:
    x = _c(x).cast("double")
    return F.when(x == 0, F.lit(-_MOST)).otherwise(F.ln(x))


def log2(x: Column | str) -> Column:
    x = _c(x).cast("double")
    return F.when(x == 0, F.lit(-_MOST)).otherwise(F.log2(x))


def log10(x: Column | str) -> Column:
    x = _c(x).cast("double")
    return F.when(x == 0, F.lit(-_MOST)).otherwise(F.log10(x))


def exp(x: Column | str) -> Column:
    return finite(F.exp(_c(x).cast("double")))


def exp2(x: Column | str) -> Column:
    return power(F.lit(2.0), _c(x).cast("double"))


def exp10(x: Column | str) -> Column:
    return power(F.lit(10.0), _c(x).cast("double"))


def trigonometric(name: str, x: Column | str) -> Column:
    """sin, cos, tan, asin, acos, atan, sinh, cosh, tanh, asinh, acosh or atanh; null outside a function's domain."""
    of = {f.__name__: f for f in (F.sin, F.cos, F.tan, F.asin, F.acos, F.atan, F.sinh, F.cosh, F.tanh, F.asinh, F.acosh, F.atanh)}
    return finite(of[name](_c(x).cast("double")))


def is_nan(x: Column | str) -> Column:
    return F.isnan(_c(x).cast("double"))


def power(x: Column | str, y: Column | float) -> Column:
    return finite(F.pow(_c(x).cast("double"), y))


def sqrt(x: Column | str) -> Column:
    return F.when(_c(x) >= 0, F.sqrt(_c(x)))


def modulo(x: Column | str, y: Column) -> Column:
    """Remainder of whole parts, with the sign of x; an error for a divisor whose whole part is 0; null for NaN."""
    whole = lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("long")
    divisor = F.abs(whole(y))
    checked = F.when(divisor == 0, F.raise_error(F.lit("cannot be divided because the divisor is zero")).cast("long")).otherwise(divisor)
    nan = F.isnan(_c(x).cast("double")) | F.isnan(y.cast("double"))
    return F.when(~nan, whole(_c(x)) % checked)


def divide(x: Column | str, y: Column) -> Column:
    wrong = F.raise_error(F.lit("cannot be divided because the divisor is zero")).cast("double")
    return F.when(y == 0, wrong).otherwise(_c(x) / y)


def to_number(s: Column | str) -> Column:
    """A number written strictly, without spaces around it; else null."""
    s = _c(s)
    return F.when(F.rlike(s, F.lit(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?$")), s.try_cast("double"))


def to_boolean(s: Column | str) -> Column:
    return F.when(_c(s) == "true", True).when(_c(s) == "false", False)

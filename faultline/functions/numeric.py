"""Numeric expressions: rounding, feature coercion, printable numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(col: Column, digits: int) -> Column:
    """Round the exact binary value of a double; only true ties go to the even neighbour.

    The product with the power of ten is taken together with its rounding error (the value is split
    so that both partial products are exact), so the comparison with the half-way point is exact. From
    a product of 2^53 on, neighbouring doubles are further apart than the last digit: the value stays.
    """
    if not 0 <= digits <= 11:
        raise ValueError("round_even takes 0 to 11 digits.")
    scale = F.lit(float(10 ** digits))
    product = col * scale
    wide = col * F.lit(134217729.0)
    high = wide - (wide - col)
    error = (high * scale - product) + (col - high) * scale
    base = F.floor(product).cast("double")
    past = ((product - base) - 0.5) + error
    up = (past > 0) | ((past == 0) & (base % 2 != 0))
    near = (base + up.cast("int")) / scale
    return F.when(F.abs(product) < 2.0 ** 53, near).otherwise(col)


def finite(col: Column) -> Column:
    """Doubles with NaN and both infinities turned to NULL."""
    bad = F.isnan(col) | (F.abs(col) == F.lit(float("inf")))
    return F.when(~bad, col)


def coerce(name: str) -> Column:
    """A column of any type as a finite double, or NULL."""
    return finite(F.expr(f"try_cast(`{name}` AS DOUBLE)"))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where undefined."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def fixed(col: Column, digits: int) -> Column:
    """Number with a fixed count of decimals, as text."""
    return F.format_string(f"%.{digits}f", round_even(col, digits))


def percent(col: Column) -> Column:
    """Fraction as a whole percentage, as text; a tie goes to the even one."""
    return F.format_string("%d%%", F.rint(col * 100.0).cast("long"))


def plain(col: Column) -> Column:
    """Double printed without an exponent: 25.0, 0.25, 12000000.0."""
    whole = (F.abs(col) >= 1e7) & (F.rint(col) == col)
    return F.when(whole, F.format_string("%.1f", col)).otherwise(col.cast("string"))

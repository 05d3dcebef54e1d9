"""Log clock text to naive timestamps, and window lengths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_UNITS = {
    "s": "second", "sec": "second", "second": "second", "seconds": "second",
    "min": "minute", "t": "minute", "minute": "minute", "minutes": "minute",
    "h": "hour", "hour": "hour", "hours": "hour",
    "d": "day", "day": "day", "days": "day",
}


def window_interval(window: str) -> str:
    """'5min', '1 minute', '2h' as a Spark interval string; anything else is an error."""
    match = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", window or "")
    unit = _UNITS.get(match.group(2).lower()) if match else None
    count = int(match.group(1) or 1) if match else 0
    if unit is None or count < 1:
        raise ValueError(f"Invalid window: {window!r}")
    return f"{count} {unit}"


def _six(col: Column) -> Column:
    text = F.regexp_replace(strip(col.cast("string")), r"\.0+$", "")
    return F.lpad(text, F.greatest(F.lit(6), F.length(text)), F.lit("0"))


def parse_clock(date: Column, time: Column) -> Column:
    """yymmdd + HHMMSS as timestamp_ntz, NULL when unparsable.

    Two-digit years 69..99 are 19xx, 00..68 are 20xx. Stripped leading zeros and float-style
    text such as 81109.0 are accepted.
    """
    digits = F.nullif(F.regexp_extract(F.concat(_six(date), _six(time)), "^([0-9]{12})$", 1), F.lit(""))

    def part(start: int) -> Column:
        return F.substring(digits, start, 2).try_cast("int")

    # Every part reads the one `digits` expression, and nothing is conditional on a row's validity,
    # so generated code evaluates the text work once per row.
    year = part(1)
    full = year + F.when(year >= 69, F.lit(1900)).otherwise(F.lit(2000))
    return F.try_make_timestamp_ntz(full, part(3), part(5), part(7), part(9),
                                    part(11).cast("decimal(16,6)"))

"""Text expressions: stripping, masking, Markdown clean-up, tokens. All JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MASKS

TOKEN_RE = r"(?U)([\w.\-]+)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once per row, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(col: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.trim(col, F.lit(" \t\n\u000b\f\r"))


def mask(col: Column) -> Column:
    """Replace block ids, addresses and long numbers so that alike messages read alike."""
    for pattern, replacement in MASKS:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def clean_markdown(col: Column) -> Column:
    """Normalise line ends, tabs, rules and blank runs of a document."""
    text = F.regexp_replace(col, r"\r\n|\r", "\n")
    text = F.replace(text, F.lit("\t"), F.lit("    "))
    text = F.regexp_replace(text, r"(?m) +$", "")
    text = F.regexp_replace(text, r"(?m)^\s*---+\s*$", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(text)


def tokens(col: Column) -> Column:
    """Lower-cased word tokens; inner dots and dashes stay, edge ones go."""
    raw = F.regexp_extract_all(F.lower(col), F.lit(TOKEN_RE), F.lit(1))
    trimmed = F.transform(raw, lambda t: F.trim(t, F.lit(".-")))
    return F.filter(trimmed, lambda t: t != "")


def counted(values: Column) -> Column:
    """Each distinct value of an array of strings with its count, ascending: array<struct<term, tf>>.

    The array is sorted, and the runs of equal neighbours are measured, so the work is that of a sort.
    """
    def runs(v: Column) -> Column:
        def measured(starts: Column) -> Column:
            until = F.when(F.size(starts) > 0, F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(v))))
            return F.transform(F.arrays_zip(starts.alias("a"), until.alias("b")), lambda p: F.struct(
                F.get(v, p["a"]).alias("term"), (p["b"] - p["a"]).cast("bigint").alias("tf")))

        places = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | (F.get(v, i) != F.get(v, i - 1)))
        none = F.array().cast("array<struct<term:string,tf:bigint>>")
        return F.when(F.size(v) > 0, let(places, measured)).otherwise(none)

    return let(F.sort_array(values), runs)

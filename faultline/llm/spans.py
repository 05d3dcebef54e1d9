"""Text spans: rows of (start, rank, end, kind), in code points, end exclusive."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string())]))


class Covered:
    """Places that some spans take up; asking takes the logarithm of their number."""

    def __init__(self, spans: list[tuple[int, int]]):
        ordered = sorted(spans)
        self.starts = [a for a, _ in ordered]
        self.reach = list(accumulate((b for _, b in ordered), max))

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.reach[before - 1] > start


def span(kinds: tuple[str, ...], kind: str, start: int, end: int) -> dict:
    return {"start": start, "rank": kinds.index(kind), "end": end, "kind": kind}


def joined(spans: Column) -> Column:
    """kind:start:end of the spans by start, then kind as listed, then end, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by [KIND] of its first span."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]

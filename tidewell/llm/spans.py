"""Spans in texts, as the secret and personal-data operators report them."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column
from pyspark.sql import functions as F

#: start and end in code points, end exclusive; kind: place in the operator's list of kinds; base: by the fixed rules.
SPAN = "struct<start:int,kind:int,end:int,base:boolean,group:int,level:int>"


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    one = lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def base_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class Taken:
    """Spans of a text, joined where they overlap; tells in logarithmic time whether another one overlaps any."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.begins, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.begins.append(a)
                self.ends.append(b)

    def leaves(self, start: int, end: int) -> bool:
        i = bisect_left(self.begins, end) - 1  # the last that begins before the end
        return i < 0 or self.ends[i] <= start

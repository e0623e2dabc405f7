"""Spans in texts: their columns and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind: string, start: long, end: long, base: boolean>"


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def in_order(spans: Column, kinds: list[str], kind_first: bool) -> Column:
    """The spans without repeats, by kind (as listed) and start, or by start and kind."""
    ranks = F.array(*[F.lit(k) for k in kinds])

    def key(s: Column) -> Column:
        rank = F.array_position(ranks, s["kind"])
        first, then = (rank, s["start"]) if kind_first else (s["start"], rank)
        return F.struct(first.alias("a"), then.alias("b"), s["end"].alias("c"), (~s["base"]).alias("d"), s.alias("s"))

    return F.transform(F.array_sort(F.transform(F.array_distinct(spans), key)), lambda x: x["s"])

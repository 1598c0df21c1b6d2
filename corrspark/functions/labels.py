"""Predicates on interval labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches_label(name: Column, labels: list[str], invert: bool = False) -> Column:
    """Case-insensitive substring match of any label. No labels match everything; a null name counts as empty."""
    low = F.lower(F.coalesce(name, F.lit("")))
    hit = reduce(lambda a, b: a | b, [low.contains(x.lower()) for x in labels], F.lit(False)) if labels else F.lit(True)
    return ~hit if invert else hit

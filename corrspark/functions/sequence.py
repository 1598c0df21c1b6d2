"""Expressions on sequences of bases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases and their complements.
_BASES, _COMPLEMENTS = "ACGTacgt", "TGCAtgca"


def reverse_complement(seq: Column, mode: str = "keep") -> Column:
    """mode: "keep" the case, "upper", or "swap_n" (the cases of n and N change places)."""
    if mode == "upper":
        seq = F.upper(seq)
    extra = ("nN", "Nn") if mode == "swap_n" else ("", "")
    return F.reverse(F.translate(seq, _BASES + extra[0], _COMPLEMENTS + extra[1]))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def non_n_length(seq: Column) -> Column:
    return F.length(F.regexp_replace(F.upper(seq), "N", "")).cast("long")


def fetch(seq: Column, start: Column, end: Column) -> Column:
    """Half-open 0-based part of a sequence; empty where out of range."""
    low = F.greatest(start, F.lit(0))
    return F.when(end > low, F.substring(seq, (low + 1).cast("int"), (end - low).cast("int"))).otherwise("")


def mask(seq: Column, intervals: Column, char: str = "n", soft: bool = False) -> Column:
    """The sequence with all (start, end) of an array of disjoint intervals masked: by ``char``, or in lower case.

    The pieces between and inside the intervals are cut once and joined once, whatever their number.
    """
    size = F.length(seq)
    inside = F.transform(intervals, lambda i: F.struct(F.greatest(i["start"], F.lit(0)).cast("int").alias("a"), F.least(i["end"], size).cast("int").alias("b")))
    held = F.sort_array(F.filter(inside, lambda i: i["b"] > i["a"]))
    low = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    part = lambda a, b: F.substring(seq, a + 1, b - a)
    before = lambda i: F.coalesce(F.get(held, i - 1)["b"], F.lit(0))
    pieces = F.transform(held, lambda x, i: F.concat(part(before(i), x["a"]), low(part(x["a"], x["b"])) if soft else F.repeat(F.lit(char), x["b"] - x["a"])))
    return F.concat(F.array_join(pieces, ""), part(F.coalesce(F.try_element_at(held, F.lit(-1))["b"], F.lit(0)), size))


def wrap(seq: Column, width: int) -> Column:
    """Lines of ``width`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(seq), F.lit(1)), F.lit(width))
    return F.array_join(F.transform(starts, lambda p: F.substring(seq, p, F.lit(width))), "\n")

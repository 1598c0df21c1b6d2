"""Coordinate expressions: 0-based, half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(start: Column, end: Column, length: Column, pad: int | Column = 0) -> tuple[Column, Column]:
    """Start and end, padded and held inside [0, length]."""
    return F.greatest(start - pad, F.lit(0)), F.least(end + pad, length)


def center(start: Column, end: Column) -> Column:
    return (start + end) / F.lit(2.0)


def invert(start: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """The interval on the reversed axis, in order."""
    a, b = length - end, length - start
    return F.least(a, b), F.greatest(a, b)


def strand_forward(start: Column, end: Column, length: Column, strand: Column) -> tuple[Column, Column]:
    """Query coordinates along the strand; its own inverse."""
    return F.when(strand == "-", length - end).otherwise(start), F.when(strand == "-", length - start).otherwise(end)


def lift(a: Column, b: Column, begin: Column, end: Column, strand: Column) -> tuple[Column, Column]:
    """A segment's part [a, b) in the coordinates of the sequence that the segment [begin, end) comes from."""
    return F.when(strand == "-", end - b).otherwise(begin + a), F.when(strand == "-", end - a).otherwise(begin + b)


def gap_bin(gap: Column, beta: float) -> Column:
    """Half-even rounding of gap / beta."""
    return F.bround(gap / F.lit(float(beta))).cast("int")

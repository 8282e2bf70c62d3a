"""Lists of flags, states and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriloom.operators.dims import QUALITY_RANK


def union_sorted(lists: Column) -> Column:
    """Over a group: the distinct values of all lists, sorted; null lists and values count for nothing (an aggregate)."""
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(lists)), lambda v: v.isNotNull())))


def worst(status: Column) -> Column:
    """Over a group: the worst quality state; unknown states count as none (an aggregate)."""
    rank = F.nullif(F.array_position(F.array(*map(F.lit, QUALITY_RANK)), status), F.lit(0))
    return F.max_by(status, rank)


def split_flags(text: Column) -> Column:
    """Pipe-joined flags as a list without blanks; null gives an empty list."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda f: f != "")


def join_flags(flags: Column) -> Column:
    """A list of flags, joined by pipes; null gives empty text."""
    return F.coalesce(F.array_join(flags, "|"), F.lit(""))


def unique_places(places: Column) -> Column:
    """Structs of a list, each content once, in order of first appearance."""
    return F.array_distinct(places)

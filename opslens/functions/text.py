"""Text clean-up: label maps, ordered regex rules, list and range columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def relabel(col: Column, mapping: dict[str, str]) -> Column:
    """Exact-value replacement; values outside the map are kept."""
    if not mapping:
        return col
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(pairs, col), col)


def normalise_reason(col: Column, rules: list[tuple[str, str]]) -> Column:
    """Apply case-insensitive regex rules one after another.

    A rule that starts with ``.*`` can only begin at the start of a line, and
    saying so spares the search from every later position. The rules run inside
    a one-item ``transform``, which Spark evaluates outside its generated code:
    in line, they make the scan's loop too long for the JVM to compile.
    """
    def apply(value: Column) -> Column:
        for pattern, replacement in rules:
            anchored = "(?im)^" + pattern if pattern.startswith(".*") else "(?i)" + pattern
            value = F.regexp_replace(value, anchored, replacement)
        return value

    return F.get(F.transform(F.array(col), apply), F.lit(0))


def merge_prefix(col: Column, prefix: str) -> Column:
    """Every label that starts with ``prefix`` becomes the prefix itself."""
    return F.regexp_replace(col, f"^{prefix}.*", prefix)


def list_items(col: Column) -> Column:
    """A comma list as an array, items not trimmed."""
    return F.split(col, ",")


def list_length(col: Column) -> Column:
    """Items in a comma list; null for a null list."""
    return F.when(col.isNotNull(), F.size(list_items(col)))


def range_start(col: Column) -> Column:
    """'10' out of a '10-12' slot."""
    return F.rtrim(F.split_part(col, F.lit("-"), F.lit(1)))


def clean_name(col: Column) -> Column:
    return F.lower(F.trim(col))

"""Lookups of a large table in a smaller one."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_join(facts: DataFrame, lookup: DataFrame, keys: list[str], condition: Column | None = None) -> DataFrame:
    """Left-join ``facts`` to a lookup table on ``keys`` and an optional further condition.

    Spark picks the plan by the lookup's size in bytes: broadcast below its threshold, else a shuffled
    join, whose hot keys adaptive execution splits on the side of the facts.
    """
    right = lookup.withColumnsRenamed({c: f"__lookup_{c}" for c in keys})
    matches = reduce(and_, [F.col(c) == F.col(f"__lookup_{c}") for c in keys])
    if condition is not None:
        matches = matches & condition
    return facts.join(right, matches, "left").drop(*[f"__lookup_{c}" for c in keys])

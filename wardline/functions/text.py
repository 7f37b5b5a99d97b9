"""Small text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def fill(template: str, value: Column | str) -> Column:
    """``template`` with ``value`` in the place of its ``%s``; null for a null value."""
    before, after = template.split("%s")
    return F.concat(F.lit(before), F.col(value) if isinstance(value, str) else value, F.lit(after))


def contained_terms(text: Column, terms: Column) -> Column:
    """The terms that occur in the text as substrings, in the order of ``terms``."""
    return bind(text, lambda t: F.filter(terms, lambda term: F.contains(t, term)))


def first_contained(text: Column, terms: Column) -> Column:
    """The first term of the list that occurs in the text; null if none does.

    No further term is searched for once one is found.
    """
    none = F.lit(None).cast("string")
    return bind(text, lambda t: F.aggregate(terms, none, lambda found, term: F.coalesce(found, F.when(F.contains(t, term), term))))


def token_count(text: Column) -> Column:
    """Number of whitespace-separated tokens."""
    return F.size(F.filter(F.split(text, r"[\s\x1c-\x1f\x85\p{Z}]+"), lambda token: token != ""))


def preview(text: Column, n: int, dots: str) -> Column:
    """The first ``n`` characters, with ``dots`` added whether or not anything was cut."""
    return F.concat(F.substring(text, 1, n), F.lit(dots))


def stripped(text: Column) -> Column:
    """Without leading and trailing whitespace of any kind."""
    return F.regexp_replace(text, r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+\z", "")

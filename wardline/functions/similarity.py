"""Near-match score of a text against the forbidden terms of its policy.

The measure is the Ratcliff-Obershelp ratio ``2 * M / (len(term) + len(text))``. ``M`` cannot
exceed the number of characters the two have in common as multisets, and a ratio above the
limit bounds the text's length, so native expressions drop nearly all texts. What is left goes
to an Arrow UDF as a column that is null everywhere else: one pass, no shuffle, no second scan.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.text import bind

# Fixed value: a ratio above this is a near match (kept apart from the policy's threshold).
NEAR_MATCH_RATIO = 0.80


def term_profiles(terms: Column) -> Column:
    """Per term: its length, its distinct characters and how often each occurs."""

    def profile(term: Column) -> Column:
        letters = F.split(term, "")
        return F.struct(
            F.length(term).alias("n"),
            F.array_distinct(letters).alias("letters"),
            F.transform(F.array_distinct(letters), lambda ch: F.size(F.filter(letters, lambda other: other == ch))).alias(
                "counts"
            ),
        )

    return F.transform(F.filter(terms, lambda term: F.length(term) > 0), profile)


def may_be_near(text: Column, profiles: Column, longest: Column) -> Column:
    """Whether any term could exceed the ratio; never false for one that does.

    In whole numbers: ratio > 4/5 needs ``5 * M > 2 * (len(term) + len(text))``.
    """

    def close_enough(t: Column, p: Column) -> Column:
        total = p["n"] + F.length(t)
        in_both = F.zip_with(
            p["letters"], p["counts"], lambda ch, n: F.least(n, F.length(t) - F.length(F.replace(t, ch, F.lit(""))))
        )
        shared = F.aggregate(in_both, F.lit(0), lambda acc, n: acc + n)
        in_band = 5 * F.least(p["n"], F.length(t)) > 2 * total
        return F.when(in_band, 5 * shared > 2 * total).otherwise(F.lit(False))

    # The widest band is that of the longest term; most texts stop here.
    def test(t: Column) -> Column:
        short = 2 * F.length(t) < 3 * longest
        return F.when(short, F.exists(profiles, lambda p: close_enough(t, p))).otherwise(F.lit(False))

    return bind(text, test)


@F.pandas_udf(T.DoubleType())
def _near_match_score(texts: pd.Series, terms: pd.Series) -> pd.Series:
    present = texts.notna().to_numpy()
    keys = [(text, tuple(some)) for text, some in zip(texts[present], terms[present])]
    seen: dict = {}
    for key in keys:
        if key not in seen:
            matcher = SequenceMatcher(None, "", key[0])
            seen[key] = 1.0
            for term in key[1]:
                matcher.set_seq1(term)
                if matcher.ratio() > NEAR_MATCH_RATIO:
                    seen[key] = 0.0
                    break
    scores = np.ones(len(texts))
    scores[present] = [seen[key] for key in keys]
    return pd.Series(scores)


# The score is a pure function of its inputs. Declared otherwise, it is evaluated once per row:
# the optimizer does not copy it, and the work it depends on, into filters on later columns.
_near_match_score = _near_match_score.asNondeterministic()


def near_candidate(text: Column, policy: Column, unless: Column) -> Column:
    """``struct(text, terms)`` where the text may be near a term of the policy, else null."""
    may_hit = ~unless & may_be_near(text, policy["profiles"], policy["longest"])
    return F.when(may_hit, F.struct(text.alias("text"), policy["forbidden"].alias("terms")))


def near_match_score(candidate: Column) -> Column:
    """0.0 for a candidate whose text nearly matches one of its terms, else 1.0 (also for null)."""
    return _near_match_score(candidate["text"], candidate["terms"])

"""Personal-identifier patterns as column expressions."""

from __future__ import annotations

import re
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.text import bind


class PiiPattern(NamedTuple):
    """``needs`` is an optional, cheap pattern that every text with a match contains."""

    type: str
    regex: str
    needs: str | None = None


# Each type but the first holds three digits in a row or a digit, a dot and a digit.
_DIGITS = r"\d(?:\d\d|\.\d)"

# The seven identifier types, in the order in which they are masked.
PII_PATTERNS = [
    PiiPattern("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "@"),
    PiiPattern("PHONE", r"\b(?:\+\d{1,3}[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}\b", _DIGITS),
    PiiPattern("CREDIT_CARD", r"\b(?:\d{4}[\s\-]?){3}\d{4}\b", _DIGITS),
    PiiPattern("SSN", r"\b(?:\d{3}-\d{2}-\d{4}|\d{9})\b", _DIGITS),
    PiiPattern("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", _DIGITS),
    PiiPattern("PASSPORT", r"\b[A-Z]{1,2}\d{6,9}\b", _DIGITS),
    PiiPattern("PHI_MRN", r"\b(?:MRN|mrn|Patient ID)[\s:#\-]*\d{5,10}\b", _DIGITS),
]

# Java spellings of the Unicode-aware classes that Python gives these escapes.
_WORD = r"[\p{L}\p{N}_]"
_UNICODE_ESCAPES = {
    "d": r"\p{Nd}",
    "s": r"[\s\x1c-\x1f\x85\p{Z}]",
    "w": _WORD,
    "b": rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))",
}


def java_regex(regex: str, boundaries: bool = True) -> str:
    """``regex`` with Unicode digits, spaces, word characters and word boundaries.

    Java reads these escapes as ASCII, and its boundary rule changed between releases, so
    they are spelled out. Without ``boundaries`` the result matches wherever the full pattern
    does (and maybe elsewhere), at a fraction of the cost.
    """

    def spell(match: re.Match) -> str:
        if match[1] == "b" and not boundaries:
            return ""
        return _UNICODE_ESCAPES.get(match[1], match[0])

    return re.sub(r"\\(.)", spell, regex, flags=re.S)


def search_regex(regex: str) -> tuple[str, str]:
    """``java_regex(regex)``, with what to put before a replacement, searched in time linear in the text.

    A pattern that begins with a boundary and a run of characters, up to one that is not of the run, would be
    tried anew at each boundary within a run. The leftmost beginning wins, so it is tried once per run: at its
    first boundary, or where the last match has ended. What stands before that boundary is group 1.
    """
    head = re.match(r"\\b(\[(?:\\.|[^\]\\])*\])\+([^\\\[\](){}.*+?|^$])", regex)
    if not head or re.fullmatch(head[1], head[2]):
        return java_regex(regex), ""
    run, rest = head[1], java_regex(regex[head.end(1) + 1 :])
    word, other = f"{run[:-1]}&&{_WORD}]", f"{run[:-1]}&&[^{_WORD[1:]}]"
    before_boundary = f"(?<={_WORD}){word}*+|(?<!{_WORD}){other}*+"
    return rf"(?:(?<!{run})({before_boundary})|\G{java_regex(chr(92) + 'b')}){run}++{rest}", "$1"


def _as_patterns(patterns) -> list[PiiPattern]:
    return [PiiPattern(*p) for p in patterns]


def _has(text: Column, needs: str) -> Column:
    return F.contains(text, F.lit(needs)) if re.escape(needs) == needs else text.rlike(java_regex(needs))


def _may_match(text: Column, pattern: PiiPattern) -> Column:
    """A cheap test that holds for every text the pattern matches."""
    if re.search(r"\(\?<?!", pattern.regex):
        return F.lit(True)
    # One character of a leading run will do: a whole run would be tried from each of its characters.
    one = re.sub(r"^(?:\\b)?(\[[^\]]*\])\+", r"\1", pattern.regex)
    return text.rlike(java_regex(one, boundaries=False))


def _groups(patterns: list[PiiPattern]):
    """Runs of patterns with the same ``needs``, which is then tested once per text."""
    return [(needs, list(run)) for needs, run in groupby(patterns, key=lambda p: p.needs)]


def masked(text: Column, patterns=PII_PATTERNS) -> Column:
    """``struct(clean, types)``: the masked text and the types found, pattern by pattern in order.

    Each pattern sees the text that the earlier ones left, and a match becomes ``<TYPE>``. All
    steps are bound inside one expression: as columns they would be multiplied out wherever the
    optimizer moves a filter on the result below them.
    """

    def result(clean: Column, types: Column) -> Column:
        return F.struct(clean.alias("clean"), types.alias("types"))

    def steps(state: Column, patterns: list[PiiPattern], texts: list[Column]) -> Column:
        done = len(texts) - 1
        if done == len(patterns):
            found = [F.when(after != before, F.lit(p.type)) for p, before, after in zip(patterns, texts, texts[1:])]
            return result(texts[-1], F.concat(state["types"], F.array_compact(F.array(*found))))
        before, pattern = texts[-1], patterns[done]
        regex, kept = search_regex(pattern.regex)
        replaced = F.regexp_replace(before, F.lit(regex), F.lit(f"{kept}<{pattern.type}>"))
        after = F.when(_may_match(before, pattern), replaced).otherwise(before)
        return bind(after, lambda t: steps(state, patterns, [*texts, t]))

    def group(state: Column, needs: str | None, patterns: list[PiiPattern]) -> Column:
        masked_further = steps(state, patterns, [state["clean"]])
        return masked_further if needs is None else F.when(_has(state["clean"], needs), masked_further).otherwise(state)

    def all_groups(state: Column, groups) -> Column:
        if not groups:
            return state
        return bind(group(state, *groups[0]), lambda after: all_groups(after, groups[1:]))

    empty = F.array().cast("array<string>")
    return bind(text, lambda t: bind(result(t, empty), lambda state: all_groups(state, _groups(_as_patterns(patterns)))))


def pii_types(text: Column, patterns=PII_PATTERNS) -> Column:
    """The types present in the raw text, each pattern on its own."""
    empty = F.array().cast("array<string>")

    def hits(t: Column, run: list[PiiPattern]) -> Column:
        found = [F.when(_may_match(t, p) & t.rlike(search_regex(p.regex)[0]), F.lit(p.type)) for p in run]
        return F.array_compact(F.array(*found))

    def group(t: Column, needs: str | None, run: list[PiiPattern]) -> Column:
        return hits(t, run) if needs is None else F.when(_has(t, needs), hits(t, run)).otherwise(empty)

    groups = _groups(_as_patterns(patterns))
    return bind(text, lambda t: F.concat(empty, *[group(t, *g) for g in groups]))

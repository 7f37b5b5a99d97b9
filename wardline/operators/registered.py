"""Guards of one's own, folded into the cascade.

A guard says where in the cascade it is asked, what it finds in a text, and what then follows. ``plan``
checks a set of guards and puts those of one place in their order; ``first_finding`` turns each place into one
expression that ends at the first guard that finds something. Guards of one place are peers: the cheaper
one is asked first, then the one whose name comes first, so the order in which they were listed is no matter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.text import bind, first_contained

BLOCK, REVIEW, FLAG = "BLOCKED", "PENDING_HITL", "FLAG"
#: Where a guard can be asked: before everything, or after one of the built-in guards that let the text pass.
PLACES = ("start", "forbidden", "score", "pii", "hitl")
#: What one search costs against another: a list of terms, a pattern, anything else.
TERM_COST, PATTERN_COST, OTHER_COST = 1, 10, 100


@dataclass(frozen=True)
class Guard:
    """One guard.

    ``find(text, lower_text)`` is a string column: what was found, null where the guard has nothing to say. ``reason``
    has ``%s`` for the finding or none. ``action`` is ``BLOCK``, ``REVIEW`` (held for a person) or ``FLAG`` (passes and is
    marked for review; asked after all others, ``after`` does not matter). A null text never reaches a guard.
    """

    name: str
    find: Callable[[Column, Column], Column]
    reason: str
    action: str = BLOCK
    after: str = "hitl"
    cost: int = OTHER_COST


def term_guard(name: str, terms: Sequence[str], reason: str, **options) -> Guard:
    """Stops texts that hold one of the terms, whatever their case; the first of the list is named."""
    listed = [term.lower() for term in terms]
    if not listed or not all(listed):
        raise ValueError(f"guard {name}: no terms, or an empty one")
    found = lambda text, lower: first_contained(lower, F.array(*map(F.lit, listed)))
    return Guard(name, found, reason, **{"cost": TERM_COST * len(listed), **options})


def pattern_guard(name: str, pattern: str, reason: str, **options) -> Guard:
    """Stops texts in which the pattern matches; the first match is named (an empty match counts)."""
    found = lambda text, lower: F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 0))
    return Guard(name, found, reason, **{"cost": PATTERN_COST, **options})


@dataclass(frozen=True)
class Plan:
    """Guards by place, each place in the order in which its guards are asked; ``flags`` come last."""

    places: dict[str, tuple[Guard, ...]]
    flags: tuple[Guard, ...]


def plan(guards: Sequence[Guard]) -> Plan:
    """Check the guards and order them; two of one name, or an unknown place or action, are errors."""
    names = [guard.name for guard in guards]
    for guard in guards:
        if names.count(guard.name) > 1:
            raise ValueError(f"guard {guard.name}: registered twice")
        if guard.after not in PLACES:
            raise ValueError(f"guard {guard.name}: no place {guard.after!r}, only {', '.join(PLACES)}")
        if guard.action not in (BLOCK, REVIEW, FLAG):
            raise ValueError(f"guard {guard.name}: no action {guard.action!r}")
        if guard.reason.count("%s") > 1:
            raise ValueError(f"guard {guard.name}: its reason has more than one place for the finding")
    ordered = sorted(guards, key=lambda guard: (guard.cost, guard.name))
    stops = {place: tuple(g for g in ordered if g.after == place and g.action != FLAG) for place in PLACES}
    return Plan({place: some for place, some in stops.items() if some}, tuple(g for g in ordered if g.action == FLAG))


def first_finding(guards: Sequence[Guard], text: Column, lower: Column) -> Column:
    """``struct(guard, action, reason)`` of the first guard that finds something; null if none does.

    No further guard is asked then.
    """

    def result(guard: Guard) -> Column:
        def named(found: Column) -> Column:
            before, *after = guard.reason.split("%s")
            reason = F.concat(F.lit(before), found, F.lit(after[0])) if after else F.lit(guard.reason)
            fields = F.struct(F.lit(guard.name).alias("guard"), F.lit(guard.action).alias("action"), reason.alias("reason"))
            return F.when(found.isNotNull(), fields)

        return bind(guard.find(text, lower), named)

    return F.coalesce(*map(result, guards)) if guards else no_finding()


def no_finding() -> Column:
    return F.lit(None).cast("struct<guard:string,action:string,reason:string>")

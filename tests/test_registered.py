"""Guards of one's own in the cascade."""

import pytest
from pyspark.sql import functions as F

from wardline.operators import registered as R
from wardline.operators.decide import decide


def decided(requests_of, policies, lexicon, prompts, guards, tenant="tenant_0"):
    rows = decide(requests_of(prompts, tenant), policies, lexicon, own_guards=guards)
    return [r.asDict() for r in rows.orderBy("request_id").collect()]


def test_no_guards_change_nothing(requests_of, policies, lexicon):
    prompts = ["malware", "hello", "The candidate seemed bossy.", "mail a@b.co"]
    plain = [r.asDict() for r in decide(requests_of(prompts), policies, lexicon).orderBy("request_id").collect()]
    assert decided(requests_of, policies, lexicon, prompts, []) == plain
    never = [R.term_guard("never", ["\u0000no such term"], "x", after=place) for place in ["hitl"]]
    assert decided(requests_of, policies, lexicon, prompts, never) == plain


def test_place_decides_which_guard_settles_a_request(requests_of, policies, lexicon):
    text = ["malware about project blue, mail a@b.co, medical advice"]
    blue = lambda after: [R.term_guard("blue", ["PROJECT BLUE"], "Secret: %s", after=after)]
    first = decided(requests_of, policies, lexicon, text, blue("start"))[0]
    assert (first["action"], first["reason"], first["anonymized_prompt"], first["pii_detected"]) == ("BLOCKED", "Secret: project blue", text[0], [])
    for place in ("forbidden", "score", "pii", "hitl"):
        assert decided(requests_of, policies, lexicon, text, blue(place))[0]["reason"] != first["reason"]
    # Without the forbidden term: before the identifiers the prompt stays, after them it is masked.
    text = ["project blue, mail a@b.co, medical advice"]
    for place, masked in (("forbidden", False), ("score", False), ("pii", True)):
        row = decided(requests_of, policies, lexicon, text, blue(place))[0]
        assert row["reason"] == "Secret: project blue" and ("a@b.co" in row["anonymized_prompt"]) != masked
        assert bool(row["pii_detected"]) == masked and row["explanation"].count("Secret: project blue") == 1
    assert decided(requests_of, policies, lexicon, text, blue("hitl"))[0]["action"] == "PENDING_HITL"


def test_peers_are_asked_cheapest_first_then_by_name(requests_of, policies, lexicon):
    costly = R.Guard("a costly one", lambda text, lower: F.lit("x"), "costly")
    pattern = R.pattern_guard("pattern", "[0-9]+", "number %s")
    terms = R.term_guard("terms", ["seven"], "term %s")
    other = R.term_guard("other", ["eight"], "other %s")
    prompts = ["seven 7", "eight seven 7", "only 7", "nothing"]
    for guards in ([costly, pattern, terms, other], [terms, other, pattern, costly]):
        got = [r["reason"] for r in decided(requests_of, policies, lexicon, prompts, guards)]
        assert got == ["term seven", "other eight", "number 7", "costly"]


def test_a_later_guard_is_not_asked_once_one_has_found_something(requests_of, policies, lexicon):
    # One that fails when asked shows it: the cheaper guard stops every text before it.
    failing = R.Guard("failing", lambda text, lower: F.raise_error(F.concat(F.lit("asked about "), text)).cast("string"), "x")
    stopping = R.pattern_guard("stopping", "(?s)^", "stopped")
    assert [r["reason"] for r in decided(requests_of, policies, lexicon, ["a", "b"], [failing, stopping])] == ["stopped"] * 2
    with pytest.raises(Exception, match="asked about a"):
        decided(requests_of, policies, lexicon, ["a"], [failing])


def test_review_and_flag(requests_of, policies, lexicon):
    guards = [R.term_guard("review", ["merger"], "Merger: %s", action=R.REVIEW), R.term_guard("mark", ["draft"], "Draft.", action=R.FLAG)]
    merger, draft, biased, both = decided(requests_of, policies, lexicon, ["a merger", "a draft", "a bossy draft", "a draft merger"], guards)
    assert (merger["action"], merger["allowed"], merger["requires_review"], merger["review_reason"]) == ("PENDING_HITL", False, True, None)
    assert (draft["action"], draft["requires_review"], draft["review_reason"]) == ("PASSED", True, "Draft.")
    assert "bossy" in biased["review_reason"]
    assert both["reason"] == "Merger: merger" and both["review_reason"] is None


def test_odd_texts(requests_of, policies, lexicon):
    guards = [R.pattern_guard("empty", "^$", "empty"), R.term_guard("percent", ["100 %"], "found %s"), R.pattern_guard("long", "z$", "end %s", after="start")]
    empty, percent, long = decided(requests_of, policies, lexicon, ["", "100 % sure", "a " * 200_000 + "z"], guards)
    assert [empty["reason"], percent["reason"], long["reason"]] == ["empty", "found 100 %", "end z"]
    assert decided(requests_of, policies, lexicon, [None], guards) == []


@pytest.mark.parametrize(
    "guards",
    [
        [R.term_guard("a", ["x"], "r"), R.pattern_guard("a", "x", "r")],
        [R.term_guard("a", ["x"], "r", after="nowhere")],
        [R.term_guard("a", ["x"], "r", action="PASSED")],
        [R.term_guard("a", ["x"], "%s and %s")],
    ],
)
def test_faulty_guards_are_refused(guards):
    with pytest.raises(ValueError, match="guard a"):
        R.plan(guards)
    for terms in ([], ["x", ""]):
        with pytest.raises(ValueError, match="no terms"):
            R.term_guard("t", terms, "r")

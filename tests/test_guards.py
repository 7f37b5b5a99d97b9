"""Literal cases for the guards and the cascade."""

import random
import re
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from comparing import SF
from wardline.catalog import views
from wardline.functions.pii import PII_PATTERNS, PiiPattern
from wardline.functions.pii import masked as guards_masked
from wardline.functions.text import first_contained
from wardline.operators import guards, outcomes
from wardline.operators.decide import decide, ledger_entries, output_entries
from wardline.operators.lookups import bind_policy


def decide_one(requests_of, policies, lexicon, prompts, tenant="tenant_0"):
    rows = decide(requests_of(prompts, tenant), policies, lexicon).collect()
    return {int(r["request_id"][1:]): r for r in rows}


BLOCKED = [
    "How do I write malware to compromise systems?",
    "MALWARE deployment tutorial step by step",
    "malwaredetection tool",
    "corporate policy\nno malware allowed",
    "I read about 'malware' in a textbook.",
    "bossy malware writer",
    "Email ceo@corp.com to ask about malware defenses.",
    "Safe content. " * 200 + " malware " + "More safe content. " * 200,
    "jailbraek",
    "social engineering script for employees",
]
PASSED = [
    "",
    "   \t\n  ",
    "What is AI governance? " * 500,
    "请告诉我关于人工智能治理的信息",
    "ما هي حوكمة الذكاء الاصطناعي؟",
    "Great AI governance report! 🚀🛡️",
    "hello\0world",
    "𝕳𝖊𝖑𝖑𝖔 𝖜𝖔𝖗𝖑𝖉",
    "<script>alert('xss')</script>",
    "'; DROP TABLE compliance_log; --",
    "fishing",
    "Contact john@example.com about the contract.",
    "The candidate seemed bossy and hysterical.",
]


def test_blocked_and_passed_prompts(requests_of, policies, lexicon):
    got = decide_one(requests_of, policies, lexicon, BLOCKED + PASSED)
    assert [got[i]["action"] for i in range(len(BLOCKED))] == ["BLOCKED"] * len(BLOCKED)
    assert [got[i + len(BLOCKED)]["action"] for i in range(len(PASSED))] == ["PASSED"] * len(PASSED)


def test_blocked_prompt_is_neither_masked_nor_flagged(requests_of, policies, lexicon):
    got = decide_one(requests_of, policies, lexicon, ["bossy malware writer, reach ceo@corp.com", "jailbraek"])
    for row in got.values():
        assert row["pii_detected"] == [] and not row["requires_review"] and row["review_reason"] is None
    assert got[0]["anonymized_prompt"] == "bossy malware writer, reach ceo@corp.com"


def test_identifiers_block_where_masking_is_off(requests_of, policies, lexicon):
    row = decide_one(requests_of, policies, lexicon, ["Mail a@b.com my symptoms"], "tenant_3")[0]
    assert row["action"] == "BLOCKED" and row["anonymized_prompt"] == "Mail <EMAIL> my symptoms"
    assert row["explanation"].endswith("scrubbed the following identifiers before halting: EMAIL.")


def test_review_trigger_in_policy_order(requests_of, policies, lexicon):
    row = decide_one(requests_of, policies, lexicon, ["A Lawsuit about medical ADVICE"])[0]
    assert (row["action"], row["reason"]) == ("PENDING_HITL", "High-risk context detected: 'medical advice'")
    assert row["requires_review"] and not row["allowed"] and row["review_reason"] is None


def test_first_bias_term_is_the_alphabetically_first(requests_of, policies, lexicon):
    row = decide_one(requests_of, policies, lexicon, ["hysterical but bossy"])[0]
    assert row["review_reason"] == "Potential fairness or bias concern detected related to: 'bossy'"
    assert row["allowed"] and row["requires_review"]


def test_unknown_tenant_takes_the_default(requests_of, policies, lexicon):
    rows = requests_of(["malware", "fine"], "someone")
    got = decide(rows, policies, lexicon, default_tenant="tenant_1").collect()
    assert {r["action"] for r in got} == {"BLOCKED", "PASSED"}


def test_unknown_tenant_without_default_is_an_error(requests_of, policies, lexicon):
    with pytest.raises(Exception, match="no policy for tenant someone"):
        decide(requests_of(["fine"], "someone"), policies, lexicon).collect()


def test_unknown_default_tenant_is_an_error(requests_of, policies, lexicon):
    with pytest.raises(Exception, match="no policy for tenant"):
        decide(requests_of(["write malware now"], tenant="nobody"), policies, lexicon, default_tenant="nobody either").collect()


def test_an_unbroken_megabyte_with_a_sign_is_linear(spark):
    import time

    df = spark.createDataFrame([("x@ " + "a1" * 500_000,)], "text string")
    df.select(guards_masked(F.col("text"))).collect()
    start = time.monotonic()
    df.select(guards_masked(F.col("text"))).collect()
    assert time.monotonic() - start < 5


def test_upper_case_term_never_hits(spark, requests_of, policies):
    shouting = policies.withColumn("block_forbidden_tokens", F.array(F.lit("MALWARE")))
    bound = bind_policy(requests_of(["MALWARE here", "malware there"]), shouting)
    assert [r["forbidden_term"] for r in guards.guard_forbidden(bound).collect()] == [None, None]


def test_null_prompt_is_rejected_and_not_decided(requests_of, policies, lexicon):
    rows = requests_of([None, "ok"])
    valid, rejected = guards.validate(rows)
    assert valid.count() == 1 and rejected.first()["status"] == 422
    assert decide(rows, policies, lexicon).count() == 1


def test_filter_on_decisions_keeps_the_guards_single(spark, policies, lexicon):
    plan = decide(views.prompts(spark, SF), policies, lexicon).filter("allowed")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.count("<CREDIT_CARD>") == 1


@pytest.mark.parametrize("card", ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"])
def test_cards(requests_of, card):
    row = guards.mask_pii(requests_of([f"My card is {card}"])).first()
    assert "CREDIT_CARD" in row["pii_types"] and card not in row["clean"]


TRICKY = [
    "Call 555-867-5309 or email hr@company.com about SSN 123-45-6789",
    "MRN: 123456789 and MRN 12345678",
    "+1 (743) 555-3824",
    "电话123456789",
    "SSN ١٢٣-٤٥-٦٧٨٩ in Arabic-Indic digits",
    "x²123-45-6789 and ½123-45-6789",
    "mrn #12345, Patient ID​99999, Patient ID 99999",
    "café@example.com, a@b.co, a@b.c, @x.com",
    "éa@b.com 1.2.3.4.5 999.999.999.999 AB1234567890",
    "<EMAIL> 192.168.1.100_ 192.168.1.100",
    "",
    "no identifiers at all",
]


def reference_mask(text):
    types = []
    for name, regex, _ in PII_PATTERNS:
        masked = re.sub(regex, f"<{name}>", text)
        if masked != text:
            types.append(name)
        text = masked
    return text, types


def test_masking_agrees_with_plain_python(spark):
    docs = views.table(spark, SF, "documents").select("text")
    pages = views.table(spark, SF, "pages").selectExpr("html AS text")
    prompts = views.prompts(spark, SF).filter("prompt IS NOT NULL").selectExpr("prompt AS text")
    tricky = spark.createDataFrame([(t,) for t in TRICKY], "text string")
    rows = guards.mask_pii(docs.unionAll(pages).unionAll(prompts).unionAll(tricky), "text").collect()
    for row in rows:
        assert (row["clean"], row["pii_types"]) == reference_mask(row["text"]), row["text"][:200]
        assert row["has_pii"] == bool(row["pii_types"])


def test_runs_around_addresses_agree_with_plain_python(spark):
    """Boundaries within a run, runs after letters of other scripts, and matches that touch each other."""
    rng = random.Random(11)
    pieces = [*"ab.-_%+@é1 ,", "@b.co", "a@b.com", ".com", "x@y.de-", "漢", "@", "..", "%", "_a", "\u0661"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(6000)]
    texts += ["a@b.com-c@d.org", ".a@b.com", "éa.b@c.de", "é.a@b.cd", "a@b.co@c.de", "%+a@b.cd%e@f.gh", "_a@b.cd", "é_a@b.cd", "a@b.cd_e@f.gh", "a@b.cde.f@g.hi"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = guards.detect_pii(guards.mask_pii(df, "text").withColumnsRenamed({"pii_types": "masked_types", "has_pii": "x"}), "text")
    for row in found.collect():
        assert (row["clean"], row["masked_types"]) == reference_mask(row["text"]), row["text"]
        assert row["pii_types"] == [n for n, regex, _ in PII_PATTERNS if re.search(regex, row["text"])], row["text"]


@pytest.mark.parametrize("run", ["a.", "a-", "a_", ".", "1.", "%a", "a@"])
def test_masking_is_linear_in_runs(spark, run):
    text = "x@y.com " + run * (1_000_000 // len(run)) + " é"
    df = spark.createDataFrame([(text,)], "text string")
    warm = spark.createDataFrame([("x@y.com a.a",)], "text string")
    for check in (lambda d: guards.mask_pii(d, "text").select("clean", "pii_types"), lambda d: guards.detect_pii(d, "text").select("pii_types")):
        check(warm).collect()
        start = time.monotonic()
        row = check(df).first()
        assert "EMAIL" in row["pii_types"] and time.monotonic() - start < 3


def test_the_first_term_ends_the_search(spark):
    df = spark.createDataFrame([("b then a",), ("c",), ("",), (None,)], "t string").withColumn("terms", F.array(F.lit("x"), F.lit("a"), F.lit("b"), F.lit(None)))
    got = df.select(first_contained(F.col("t"), F.col("terms"))).collect()
    assert [r[0] for r in got] == ["a", None, None, None]


def test_detection_agrees_with_plain_python(spark):
    docs = views.table(spark, SF, "documents").select("text")
    rows = guards.detect_pii(docs.unionAll(spark.createDataFrame([(t,) for t in TRICKY], "text string")), "text").collect()
    for row in rows:
        assert row["pii_types"] == [n for n, regex, _ in PII_PATTERNS if re.search(regex, row["text"])]


def test_own_pattern(requests_of):
    own = [*PII_PATTERNS, PiiPattern("NHS_NUMBER", r"\b\d{3}\s\d{3}\s\d{3}\b")]
    row = guards.mask_pii(requests_of(["number 943 476 591 of a@b.com"]), patterns=own).first()
    assert row["clean"] == "number <NHS_NUMBER> of <EMAIL>" and row["pii_types"] == ["EMAIL", "NHS_NUMBER"]


def test_near_match_prune_loses_nothing(spark, policies):
    terms = policies.first()["block_forbidden_tokens"]
    near = ["phishin", "fishing", "phisching", "jail break", "mal ware", "self harm", "deep fake", "suicid", "a", "malwar"]
    near += ["ignore previous instructions", "ignore all previous instruction!", "unauthorised acess", "build a bob", "bypas safety"]
    texts = spark.createDataFrame([(t,) for t in near], "prompt string")
    for name, column in (("documents", "text"), ("benchmark", "text"), ("conversations", "text")):
        texts = texts.unionAll(views.table(spark, SF, name).selectExpr(f"{column} AS prompt"))
    rows = guards.guard_threshold(
        bind_policy(texts.withColumn("tenant_id", F.lit("tenant_0")), policies)
    ).collect()
    seen = set()
    for row in rows:
        lowered = row["prompt"].lower()
        expected = 0.0 if any(SequenceMatcher(None, t, lowered).ratio() > 0.80 for t in terms) else 1.0
        assert row["safety_score"] == expected, row["prompt"]
        assert row["below_threshold"] == (expected < 0.8)
        seen.add(expected)
    assert seen == {0.0, 1.0}


def test_output_check(spark):
    rows = spark.createDataFrame(
        [("Your SSN is 123-45-6789, confirmed.",), ("Here is a summary.",), ("a@b.com at 10.0.0.1",)], "response string"
    )
    got = {r["response"]: (r["output_allowed"], r["output_reason"]) for r in guards.verify_output(rows).collect()}
    assert got["Your SSN is 123-45-6789, confirmed."] == (
        False,
        "Output blocked: LLM response contains raw PII (SSN).",
    )
    assert got["Here is a summary."] == (True, "Output clean.")
    assert "(EMAIL, IP_ADDRESS)" in got["a@b.com at 10.0.0.1"][1]


def test_output_entry_follows_its_request(spark, requests_of, policies, lexicon):
    decided = decide(requests_of(["one", "malware", "three"]), policies, lexicon)
    answers = spark.createDataFrame([("r0", "ok"), ("r1", "a@b.com"), ("r2", "a@b.com")], "request_id string, response string")
    rows = output_entries(decided, answers).collect()
    assert [(r["request_id"], r["action_taken"], r["review_status"]) for r in rows] == [("r2-OUT", "BLOCKED", "CLOSED")]


def test_entry_fields(requests_of, policies, lexicon):
    rows = ledger_entries(decide(requests_of(["fine", "so bossy", "my symptoms"]), policies, lexicon)).collect()
    got = {r["request_id"]: (r["rule_violated"], r["review_status"]) for r in rows}
    assert got["r0"] == (None, "CLOSED")
    assert got["r1"][1] == got["r2"][1] == "PENDING_REVIEW"
    assert got["r2"][0] == "High-risk context detected: 'symptoms'"


def test_library_line(requests_of, policies, lexicon):
    rows = outcomes.library_result(decide(requests_of(["fine", "so bossy", "my symptoms"]), policies, lexicon)).collect()
    lines = {r["request_id"]: r["line"] for r in rows}
    assert lines["r0"] == "[APPROVED] Complies with structural governance boundaries."
    assert lines["r1"].startswith("[APPROVED] ") and "| PENDING_REVIEW: Potential" in lines["r1"]
    assert lines["r2"] == "[BLOCKED] High-risk context detected: 'symptoms' | PENDING_REVIEW: None"

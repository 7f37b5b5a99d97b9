"""The cascade of guards, and what follows from a decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.pii import PII_PATTERNS, masked
from wardline.functions.similarity import near_candidate, near_match_score
from wardline.functions.text import fill, first_contained
from wardline.operators.guards import (
    HITL_REASON,
    SCORE_VIOLATION,
    UNFAIR_REASON,
    verify_output,
)
from wardline.operators.lookups import bind_policy
from wardline.operators.registered import PLACES, Guard, Plan, first_finding, plan
from wardline.sources.policies import lexicon_terms

# Messages.
PASSED_REASON = "Complies with structural governance boundaries."
EXPLAIN_BLOCKED = "Explainability Report: The request was halted by the runtime firewall. Reason: %s"
EXPLAIN_SCRUBBED = " The system scrubbed the following identifiers before halting: %s."
EXPLAIN_HITL = (
    "Explainability Report: The request triggered a Human-in-the-Loop (HITL) pause. It matched high-risk contexts."
    " Human authorization is required to proceed. Context: %s"
)
EXPLAIN_FLAGGED = "Explainability Report: The request passed but was flagged for human review. %s"
EXPLAIN_PASSED = "Explainability Report: The request passed all safety, privacy, and fairness checks."

# Which guard stopped a request, in the order in which they are asked.
FORBIDDEN, SCORE, PII, HITL, NONE = 1, 2, 3, 4, 0
# A guard of one's own: asked before identifiers are looked at, or after that.
OWN_EARLY, OWN_LATE = 5, 6

DECISION_COLUMNS = [
    "allowed",
    "action",
    "reason",
    "requires_review",
    "review_reason",
    "anonymized_prompt",
    "pii_detected",
    "explanation",
]


def explanation() -> Column:
    """Plain-language account of a decision, from its columns."""
    scrubbed = F.when(
        F.size("pii_detected") > 0, fill(EXPLAIN_SCRUBBED, F.array_join("pii_detected", ", "))
    ).otherwise("")
    return (
        F.when(F.col("action") == "BLOCKED", F.concat(fill(EXPLAIN_BLOCKED, "reason"), scrubbed))
        .when(F.col("action") == "PENDING_HITL", fill(EXPLAIN_HITL, "reason"))
        .when(F.col("requires_review"), fill(EXPLAIN_FLAGGED, F.coalesce("review_reason", "reason")))
        .otherwise(EXPLAIN_PASSED)
    )


def _own(place: str) -> str:
    return f"__own_{place}"


def _own_findings(own: Plan, text: Column, forbidden: Column) -> list[Column]:
    """A column per place that has guards; what a forbidden term has settled is not looked at."""
    found = []
    for place, some in own.places.items():
        finding = first_finding(some, F.col("prompt"), text)
        found.append((finding if place == "start" else F.when(~forbidden, finding)).alias(_own(place)))
    if own.flags:
        found.append(F.when(~forbidden, first_finding(own.flags, F.col("prompt"), text)).alias(_own("flags")))
    return found


def _stop(own: Plan) -> Column:
    """Which guard stops a request: the built-in ones in their order, and after each those registered there."""
    steps = [
        ("start", None, None),
        ("forbidden", F.col("forbidden_term").isNotNull(), FORBIDDEN),
        ("score", F.col("safety_score") < F.col("threshold"), SCORE),
        ("pii", (F.size("pii.types") > 0) & ~F.col("may_mask"), PII),
        ("hitl", F.col("trigger").isNotNull(), HITL),
    ]
    cases = []
    for place, test, code in steps:
        if test is not None:
            cases.append((test, code))
        if place in own.places:
            cases.append((F.col(_own(place)).isNotNull(), OWN_LATE if place in ("pii", "hitl") else OWN_EARLY))
    chain = F.when(*cases[0])
    for test, code in cases[1:]:
        chain = chain.when(test, code)
    return chain.otherwise(NONE)


def _own_stop(own: Plan) -> Column | None:
    """What the guard of one's own that stopped a request found: that of the first place with a finding."""
    return F.coalesce(*[F.col(_own(place)) for place in PLACES if place in own.places]) if own.places else None


def decide(
    requests: DataFrame,
    policies: DataFrame,
    lexicon: DataFrame,
    patterns=PII_PATTERNS,
    default_tenant: str | None = None,
    own_guards: Sequence[Guard] = (),
) -> DataFrame:
    """Decide on every request: forbidden term, near match, identifiers, human review, bias.

    ``own_guards`` are asked at their places in this cascade, in the same pass. One that stops a
    request before identifiers are looked at leaves the prompt as it came; a later one has it masked.

    The first guard that stops a request settles it; bias only flags. Requests without a
    prompt are not decided on. One narrow pass: the policies are looked up by broadcast, no row is
    shuffled, and each guard runs once per row. Filters on the result do not reach the scan, so
    pick days or tenants on ``requests``.
    """
    columns, own = requests.columns, plan(own_guards)
    rows = bind_policy(requests.filter("prompt IS NOT NULL"), policies, default_tenant)
    text, policy = F.col("lower_prompt"), F.col("policy")
    rows = rows.withColumns(
        {
            "lower_prompt": F.lower("prompt"),
            "forbidden_term": first_contained(F.lower("prompt"), policy["forbidden"]),
            "terms": lexicon_terms(lexicon),
        }
    )

    # All that reads the policy and the lexicon, so that rows do not carry them any further.
    forbidden = F.col("forbidden_term").isNotNull()
    rows = rows.select(
        *columns,
        "forbidden_term",
        near_candidate(text, policy, unless=forbidden).alias("near"),
        # A prompt with a forbidden term is not masked.
        F.when(~forbidden, masked(F.col("prompt"), patterns)).alias("pii"),
        F.when(~forbidden, first_contained(text, policy["triggers"])).alias("trigger"),
        F.when(~forbidden, first_contained(text, F.col("terms"))).alias("bias_term"),
        *_own_findings(own, text, forbidden),
        policy["threshold"].alias("threshold"),
        policy["mask_pii"].alias("may_mask"),
        policy["fallbacks"]["token_violation"].alias("token_violation"),
        policy["fallbacks"]["pii_violation"].alias("pii_violation"),
    )
    rows = rows.withColumn("safety_score", near_match_score(F.col("near")))
    rows = rows.withColumn("stop", _stop(own))

    stop, finding = F.col("stop"), _own_stop(own)
    flagged = (stop == NONE) & F.col("bias_term").isNotNull()
    review_reason = F.when(flagged, fill(UNFAIR_REASON, "bias_term"))
    if own.flags:
        # Bias is named first, as ever.
        marked = (stop == NONE) & F.col(_own("flags")).isNotNull()
        review_reason = review_reason.when(marked, F.col(_own("flags"))["reason"])
        flagged = flagged | marked
    action = F.when(stop == NONE, "PASSED").when(stop == HITL, "PENDING_HITL")
    reason = (
        F.when(stop == FORBIDDEN, F.col("token_violation"))
        .when(stop == SCORE, SCORE_VIOLATION)
        .when(stop == PII, F.col("pii_violation"))
        .when(stop == HITL, fill(HITL_REASON, "trigger"))
    )
    held = stop == HITL
    # The first guards leave the prompt as it came.
    halted = stop.isin(FORBIDDEN, SCORE)
    if finding is not None:
        is_own = stop.isin(OWN_EARLY, OWN_LATE)
        action = action.when(is_own, finding["action"])
        reason = reason.when(is_own, finding["reason"])
        held = held | F.when(is_own, finding["action"] == "PENDING_HITL").otherwise(False)
        halted = halted | (stop == OWN_EARLY)
    rows = rows.withColumns(
        {
            "allowed": stop == NONE,
            "action": action.otherwise("BLOCKED"),
            "reason": reason.otherwise(PASSED_REASON),
            "requires_review": held | flagged,
            "review_reason": review_reason,
            "anonymized_prompt": F.when(halted, F.col("prompt")).otherwise(F.col("pii.clean")),
            "pii_detected": F.when(halted, F.array().cast("array<string>")).otherwise(F.col("pii.types")),
        }
    )
    return rows.withColumn("explanation", explanation()).select(*columns, *DECISION_COLUMNS)


def ledger_entries(decisions: DataFrame) -> DataFrame:
    """What the ledger records of a decision; the mark of a late row stays with it."""
    return decisions.select(
        *[c for c in decisions.columns if c == "late"],
        "request_id",
        "tenant_id",
        "ts",
        F.lit(False).alias("is_output"),
        F.col("action").alias("action_taken"),
        F.when(F.col("allowed"), F.col("review_reason")).otherwise(F.col("reason")).alias("rule_violated"),
        F.when(F.col("requires_review"), "PENDING_REVIEW").otherwise("CLOSED").alias("review_status"),
    )


def output_entries(decisions: DataFrame, responses: DataFrame, patterns=PII_PATTERNS) -> DataFrame:
    """A further entry for every allowed request whose response leaks identifiers.

    Only the leaking responses, without their text, and the keys of allowed requests meet in
    the join.
    """
    leaking = verify_output(responses, "response", patterns).filter(~F.col("output_allowed"))
    allowed = decisions.filter("allowed").select("request_id", "tenant_id", "ts")
    return allowed.join(leaking.select("request_id", "output_reason"), "request_id").select(
        F.concat("request_id", F.lit("-OUT")).alias("request_id"),
        "tenant_id",
        "ts",
        F.lit(True).alias("is_output"),
        F.lit("BLOCKED").alias("action_taken"),
        F.col("output_reason").alias("rule_violated"),
        F.lit("CLOSED").alias("review_status"),
    )

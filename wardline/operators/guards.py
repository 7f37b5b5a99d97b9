"""The guards, one by one, each usable on its own.

Every guard takes a frame with ``prompt`` and, where rules are needed, the ``policy`` column
of ``bind_policy``; it adds columns and moves no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.pii import PII_PATTERNS, masked, pii_types
from wardline.functions.similarity import near_candidate, near_match_score
from wardline.functions.text import bind, fill, first_contained
from wardline.sources.policies import lexicon_terms

# Messages.
SCORE_VIOLATION = "Execution Halted: Semantic threat proximity verification failure."
FAIR_REASON = "Passed fairness checks."
UNFAIR_REASON = "Potential fairness or bias concern detected related to: '%s'"
HITL_REASON = "High-risk context detected: '%s'"
OUTPUT_CLEAN = "Output clean."
OUTPUT_BLOCKED = "Output blocked: LLM response contains raw PII (%s)."


def validate(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with a prompt, and the rejected ones with status 422; empty text is a prompt."""
    rejected = requests.filter("prompt IS NULL").withColumn("status", F.lit(422))
    return requests.filter("prompt IS NOT NULL"), rejected


def guard_forbidden(df: DataFrame) -> DataFrame:
    """Add ``forbidden_term``, the first forbidden term in the text, else null.

    Terms are compared as written with the lower-cased text, so one in upper case never hits.
    """
    return df.withColumn("forbidden_term", first_contained(F.lower("prompt"), F.col("policy.forbidden")))


def safety_candidates(df: DataFrame) -> DataFrame:
    """Add ``candidate``: the lower-cased text where it may nearly match a term, else null."""
    near = bind(F.lower("prompt"), lambda text: near_candidate(text, F.col("policy"), F.lit(False))["text"])
    return df.withColumn("candidate", near)


def safety_score(df: DataFrame) -> DataFrame:
    """Add ``safety_score``: 0.0 for a near match of a forbidden term, else 1.0."""
    near = bind(F.lower("prompt"), lambda text: near_candidate(text, F.col("policy"), F.lit(False)))
    scored = df.withColumn("__near", near)
    return scored.withColumn("safety_score", near_match_score(F.col("__near"))).drop("__near")


def guard_threshold(df: DataFrame) -> DataFrame:
    """Add ``below_threshold``: whether the score is under the policy's minimum."""
    return safety_score(df).withColumn("below_threshold", F.col("safety_score") < F.col("policy.threshold"))


def mask_pii(df: DataFrame, text: str = "prompt", patterns=PII_PATTERNS) -> DataFrame:
    """Add ``has_pii``, ``pii_types`` and ``clean``, the text with typed placeholders."""
    found = df.withColumn("__pii", masked(F.col(text), patterns))
    return found.withColumns(
        {"has_pii": F.size("__pii.types") > 0, "pii_types": F.col("__pii.types"), "clean": F.col("__pii.clean")}
    ).drop("__pii")


def detect_pii(df: DataFrame, text: str = "prompt", patterns=PII_PATTERNS) -> DataFrame:
    """Add ``has_pii`` and ``pii_types`` for the text as it stands."""
    found = df.withColumn("pii_types", pii_types(F.col(text), patterns))
    return found.withColumn("has_pii", F.size("pii_types") > 0)


def guard_pii_block(df: DataFrame, patterns=PII_PATTERNS) -> DataFrame:
    """Add ``pii_blocked``: identifiers found where the policy does not allow masking."""
    return mask_pii(df, "prompt", patterns).withColumn("pii_blocked", F.col("has_pii") & ~F.col("policy.mask_pii"))


def guard_hitl(df: DataFrame) -> DataFrame:
    """Add ``hitl_trigger``, the first trigger in policy order in the text, else null."""
    return df.withColumn("hitl_trigger", first_contained(F.lower("prompt"), F.col("policy.triggers")))


def fairness_flag(df: DataFrame, lexicon: DataFrame, text: str = "prompt") -> DataFrame:
    """Add ``is_fair``, ``fairness_score``, ``bias_term`` and ``fairness_reason``."""
    with_terms = df.withColumn("__terms", lexicon_terms(lexicon))
    # The list is sorted, so the first hit is the alphabetically first one.
    flagged = with_terms.withColumn("bias_term", first_contained(F.lower(text), F.col("__terms"))).drop("__terms")
    fair = F.col("bias_term").isNull()
    return flagged.withColumns(
        {
            "is_fair": fair,
            "fairness_score": F.when(fair, 1.0).otherwise(0.0),
            "fairness_reason": F.when(fair, FAIR_REASON).otherwise(fill(UNFAIR_REASON, "bias_term")),
        }
    )


def verify_output(df: DataFrame, text: str = "response", patterns=PII_PATTERNS) -> DataFrame:
    """Add ``output_allowed`` and ``output_reason``: a response with raw identifiers is stopped."""
    found = df.withColumn("__types", pii_types(F.coalesce(F.col(text), F.lit("")), patterns))
    leaks = F.size("__types") > 0
    return found.withColumns(
        {
            "output_allowed": ~leaks,
            "output_reason": F.when(leaks, fill(OUTPUT_BLOCKED, F.array_join("__types", ", "))).otherwise(
                OUTPUT_CLEAN
            ),
        }
    ).drop("__types")

"""Decisions as the callers of the gateway and of the library see them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the message while the switch is on.
SERVICE_OFF = "Service Unavailable: Global kill switch is active. Contact your compliance officer."


def gateway_response(decisions: DataFrame, turned_away: DataFrame, checked_responses: DataFrame | None = None) -> DataFrame:
    """One row per incoming request with its status and what is returned.

    ``turned_away`` has the requests that were not decided on, with ``kill_switch_active``: 503 while
    the switch was on, else 422 (no prompt). They are neither looked up by tenant nor joined, as neither
    answer depends on it. Decided ones get 403 if stopped before or after the model, else 200 with the
    masked prompt. ``checked_responses`` has ``request_id``, ``output_allowed`` and ``output_reason``;
    only the leaking ones join, and a request without an id has no response.
    """
    if checked_responses is not None:
        leaking = checked_responses.filter(~F.col("output_allowed") & F.col("request_id").isNotNull()).select(
            F.col("request_id").alias("__id"), F.lit(0).cast("long").alias("__spread"), "output_reason"
        )
        # Requests without an id are spread over tasks instead of meeting in one.
        spread = F.when(F.col("request_id").isNull(), F.xxhash64("tenant_id", "anonymized_prompt", "ts")).otherwise(0)
        same = [F.coalesce("request_id", F.lit("")) == F.col("__id"), F.col("__at") == F.col("__spread")]
        rows = decisions.withColumn("__at", spread).join(leaking, same, "left")
    else:
        rows = decisions.withColumn("output_reason", F.lit(None).cast("string"))
    ok = F.col("allowed") & F.col("output_reason").isNull()
    answered = rows.select(
        "request_id",
        "tenant_id",
        F.when(ok, 200).otherwise(403).alias("http_status"),
        F.when(ok, "APPROVED").alias("status"),
        F.when(ok, F.col("anonymized_prompt")).alias("forwarded_prompt"),
        F.when(ok, F.col("pii_detected")).alias("pii_redacted"),
        F.when(ok, F.col("requires_review")).alias("flagged_for_review"),
        F.when(ok, F.col("explanation")).alias("explanation"),
        F.when(~F.col("allowed"), F.col("explanation")).otherwise(F.col("output_reason")).alias("detail"),
    )
    off = F.col("kill_switch_active")
    undecided = turned_away.select(
        "request_id", "tenant_id", F.when(off, 503).otherwise(422).alias("http_status"), F.when(off, SERVICE_OFF).alias("detail")
    )
    return answered.unionByName(undecided, allowMissingColumns=True)


def library_result(decisions: DataFrame) -> DataFrame:
    """The result of a library call; a request paused for review counts as blocked."""
    review = F.when(
        F.col("requires_review"), F.concat(F.lit(" | PENDING_REVIEW: "), F.coalesce("review_reason", F.lit("None")))
    ).otherwise("")
    status = F.when(F.col("allowed"), "APPROVED").otherwise("BLOCKED")
    return decisions.select(
        "request_id",
        "tenant_id",
        status.alias("status"),
        "allowed",
        "reason",
        F.col("anonymized_prompt").alias("clean_prompt"),
        "pii_detected",
        F.col("requires_review").alias("flagged_for_review"),
        "review_reason",
        F.concat(F.lit("["), status, F.lit("] "), F.col("reason"), review).alias("line"),
    )


def forward_preview(decisions: DataFrame) -> DataFrame:
    """The starts of a forwarded prompt that messages quote (80 and 60 characters)."""
    head = lambda n: F.substring("anonymized_prompt", 1, n)
    return decisions.filter("allowed").select("request_id", head(80).alias("preview_80"), head(60).alias("preview_60"))

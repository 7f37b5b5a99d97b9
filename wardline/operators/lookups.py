"""Binding requests to what is known about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.pii import PII_PATTERNS
from wardline.operators.guards import verify_output
from wardline.plans.joins import lookup_join
from wardline.sources.policies import policy_structs


def bind_policy(requests: DataFrame, policies: DataFrame, default_tenant: str | None = None) -> DataFrame:
    """Add ``policy``, the rules of the request's tenant.

    Tenants without a policy of their own get that of ``default_tenant``. With no default they
    are an error, and so are those whose default has none: no request may pass because nobody
    wrote rules for it. Two policies of one tenant are an error too.
    """
    rules = _one_each(policy_structs(policies))
    bound = lookup_join(requests, rules, ["tenant_id"])
    missing = F.raise_error(F.concat(F.lit("no policy for tenant "), F.coalesce("tenant_id", F.lit("null"))))
    if default_tenant is None:
        return bound.withColumn("policy", F.coalesce("policy", missing))
    default = rules.filter(F.col("tenant_id") == default_tenant).select("policy").limit(1).scalar()
    return bound.withColumn("policy", F.coalesce("policy", default, missing))


def _one_each(rules: DataFrame) -> DataFrame:
    counted = rules.groupBy("tenant_id").agg(F.count("*").alias("n"), F.first("policy").alias("policy"))
    several = F.raise_error(F.concat(F.lit("several policies for tenant "), F.col("tenant_id")))
    return counted.select("tenant_id", F.when(F.col("n") > 1, several).otherwise(F.col("policy")).alias("policy"))


def pair_responses(requests: DataFrame, responses: DataFrame, patterns=PII_PATTERNS) -> DataFrame:
    """Each request with the check of its response."""
    checked = verify_output(responses, "response", patterns).select(
        "request_id", "response", "output_allowed", "output_reason"
    )
    return requests.join(checked, "request_id")


def pair_turns(conversations: DataFrame, patterns=PII_PATTERNS) -> DataFrame:
    """Each user turn of a conversation with the check of the assistant turn that follows it."""
    users = conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answers = conversations.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return verify_output(users.join(answers, ["conv_id", "turn"]), "response", patterns)

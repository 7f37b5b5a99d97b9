"""The whole way from requests to ledger entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.pii import PII_PATTERNS
from wardline.operators.decide import decide, ledger_entries, output_entries
from wardline.session import stage
from wardline.sources.control import flag_as_of


def gate(requests: DataFrame, active: Column | None = None, control_log: DataFrame | None = None) -> DataFrame:
    """Add ``kill_switch_active`` from the current state or from the history of the switch."""
    if control_log is not None:
        return flag_as_of(requests, control_log)
    return requests.withColumn("kill_switch_active", F.lit(False) if active is None else active)


def gateway_ledger(
    requests: DataFrame,
    responses: DataFrame,
    policies: DataFrame,
    lexicon: DataFrame,
    active: Column | None = None,
    control_log: DataFrame | None = None,
    patterns=PII_PATTERNS,
    default_tenant: str | None = None,
) -> DataFrame:
    """Entries of a run: one per decided request, one more per allowed request that leaked.

    Requests that met an active switch or had no prompt leave no entry. What the entries need
    of the decisions is staged, so that the guards run once although two branches read them.
    """
    open_requests = gate(requests, active, control_log).filter(~F.col("kill_switch_active")).drop("kill_switch_active")
    decisions = decide(open_requests, policies, lexicon, patterns, default_tenant).select(
        "request_id", "tenant_id", "ts", "allowed", "action", "reason", "requires_review", "review_reason"
    )
    decided = stage(decisions, "decisions")
    return ledger_entries(decided).unionByName(output_entries(decided, responses, patterns))

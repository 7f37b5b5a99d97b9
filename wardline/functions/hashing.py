"""The hash of a ledger row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what the first row of a chain takes as its previous hash (32 zeros).
GENESIS = "0" * 32


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit("None"))


def entry_payload(df_prefix: str = "") -> Column:
    """The hashed fields in order, without separators; a null rule counts as empty text."""
    col = lambda name: F.col(f"{df_prefix}{name}")
    return F.concat(
        _text(col("request_id")),
        _text(col("tenant_id")),
        _text(col("action_taken")),
        F.coalesce(col("rule_violated"), F.lit("")),
    )


def recomputed_hash() -> Column:
    """The hash that a stored row should carry, from its own stored fields."""
    return F.sha2(F.concat(entry_payload(), _text(F.col("previous_hash"))), 256)

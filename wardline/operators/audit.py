"""Checks of a ledger against what was noted of it before, and its status in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.hashing import GENESIS
from wardline.operators.ledger import chain_heads, verify_chain


def verify_seals(ledger: DataFrame, seals: DataFrame) -> DataFrame:
    """``tenant_id, chain, fault`` for every chain that is not as its stored seal has it.

    ``seals`` is a stored result of ``seal_segments``. ``seal``: the seal itself was altered, or the one
    before it is gone; ``lost``: the chain is gone; ``cut`` and ``grown``: rows were taken off or added;
    ``changed``: another last hash; ``unsealed``: a chain without a seal. A removed tail, chain or day
    leaves no broken link in the ledger and shows only here. Both sides have one row per chain.
    """
    heads = chain_heads(ledger).select(
        F.col("tenant_id").alias("__tenant"), F.concat_ws("/", "segment", "block").alias("__chain"), F.col("n_rows").alias("__rows"), F.col("head").alias("__head")
    )
    kept = seals.select(F.struct("tenant_id", "seal").alias("__before")).distinct().withColumn("__kept", F.lit(True))
    payload = F.concat("chain", F.coalesce("tenant_id", F.lit("None")), F.col("n_rows").cast("string"), "head", "previous_seal")
    checked = seals.withColumn("__before", F.struct("tenant_id", F.col("previous_seal").alias("seal"))).join(kept, "__before", "left")
    altered = F.sha2(payload, 256) != F.col("seal")
    alone = (F.col("previous_seal") != GENESIS) & F.col("__kept").isNull()
    stored = checked.select("tenant_id", "chain", "n_rows", "head", (altered | alone).alias("__bad"))
    fault = (
        F.when(F.col("chain").isNull(), "unsealed")
        .when(F.col("__bad"), "seal")
        .when(F.col("__chain").isNull(), "lost")
        .when(F.col("__rows") < F.col("n_rows"), "cut")
        .when(F.col("__rows") > F.col("n_rows"), "grown")
        .when(F.col("__head") != F.col("head"), "changed")
    )
    met = stored.join(heads, F.col("tenant_id").eqNullSafe(F.col("__tenant")) & (F.col("chain") == F.col("__chain")), "full")
    named = met.select(F.when(F.col("chain").isNull(), F.col("__tenant")).otherwise(F.col("tenant_id")).alias("tenant_id"), F.coalesce("chain", "__chain").alias("chain"), fault.alias("fault"))
    return named.filter("fault IS NOT NULL")


def health_status(ledger: DataFrame, active: Column) -> DataFrame:
    """One row: the service status, the state of the switch, and whether the ledger is intact or where it breaks."""
    # The wording of the status.
    integrity = F.when(F.col("intact"), "VERIFIED").otherwise(F.concat(F.lit("BROKEN at row "), F.col("broken_at").cast("string")))
    return verify_chain(ledger).select(F.lit("ok").alias("status"), active.alias("kill_switch"), integrity.alias("ledger_integrity"))

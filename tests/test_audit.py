"""Stored seals against ledgers that lost or gained something, the status row, and request ids."""

from pyspark.sql import functions as F

from comparing import SF
from wardline.catalog import queries
from wardline.operators import audit
from wardline.operators import ledger as L
from wardline.operators.identity import assign_request_ids
from wardline.session import stage


def faults(ledger, seals):
    return sorted((r["tenant_id"], r["chain"][:10], r["fault"]) for r in audit.verify_seals(ledger, seals).collect())


def test_seals_name_what_is_gone_and_what_was_altered(spark):
    ledger = queries.sealed_ledger(spark, SF)
    seals = stage(L.seal_segments(ledger), "test-seals")
    assert faults(ledger, seals) == []
    day = ledger.agg(F.min("segment")).first()[0]
    one = (F.col("tenant_id") == "tenant_1") & (F.col("segment") == day)
    last = ledger.where(one).agg(F.max("seq")).first()[0]
    # A cut tail and a lost chain leave no broken link.
    cut = ledger.where(~(one & (F.col("seq") == last)))
    assert L.chain_links(cut).count() == 0 and faults(cut, seals) == [("tenant_1", day, "cut")]
    assert faults(ledger.where(~one), seals) == [("tenant_1", day, "lost")]
    assert len(faults(ledger.where(F.col("segment") != day), seals)) == 4
    altered = ledger.withColumn("current_hash", F.when(one & (F.col("seq") == last), "x").otherwise(F.col("current_hash")))
    assert faults(altered, seals) == [("tenant_1", day, "changed")]
    # An edited seal is named; a removed one leaves its chain unsealed and the next seal without the one before.
    edited = seals.withColumn("n_rows", F.when((F.col("tenant_id") == "tenant_1") & (F.col("head_no") == 1), 1).otherwise(F.col("n_rows")))
    assert faults(ledger, edited) == [("tenant_1", day, "seal")]
    kinds = [f for _, _, f in faults(ledger, seals.where("tenant_id <> 'tenant_1' OR head_no <> 1"))]
    assert sorted(kinds) == ["seal", "unsealed"]
    assert {f for _, _, f in faults(ledger.limit(0), seals)} == {"lost"} and {f for _, _, f in faults(ledger, seals.limit(0))} == {"unsealed"}


def test_chains_without_a_tenant_have_seals(spark, entries_of):
    ledger = stage(L.seal(entries_of([("a", None, "PASSED", None), ("b", None, "BLOCKED", "x")])), "test-ledger")
    seals = stage(L.seal_segments(ledger), "test-seals")
    assert faults(ledger, seals) == []
    assert [r["fault"] for r in audit.verify_seals(ledger.where("seq = 1"), seals).collect()] == ["cut"]


def test_status(spark):
    ledger = queries.sealed_ledger(spark, SF)
    assert tuple(audit.health_status(ledger, F.lit(False)).first()) == ("ok", False, "VERIFIED")
    third = ledger.withColumn("action_taken", F.when(F.col("id") == 3, "x").otherwise(F.col("action_taken")))
    assert tuple(audit.health_status(third, F.lit(True)).first()) == ("ok", True, "BROKEN at row 3")


def test_request_ids_are_stable_and_keep_those_given(spark):
    rows = spark.createDataFrame([(None, "f", 1), ("own", "f", 2), (None, "f1", None), (None, "f", None), (None, None, 1)], "request_id string, file string, line long")
    first, second = ([r["request_id"] for r in assign_request_ids(df, ["file", "line"]).orderBy("file", "line").collect()] for df in (rows, rows.repartition(3)))
    assert first == second and len(set(first)) == 5 and "own" in first
    assert all(i == "own" or [len(p) for p in i.split("-")] == [8, 4, 4, 4, 12] for i in first)

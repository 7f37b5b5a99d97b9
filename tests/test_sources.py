"""Policies, lexicon, requests, corpus and pages as they are read."""

import json

import pytest

from wardline import config
from wardline.functions.text import stripped, token_count
from wardline.session import work_folder
from wardline.sources import corpus, policies, requests
from pyspark.sql import functions as F


def test_policy_shape_and_aliases(spark):
    for alias in config.POLICY_ALIASES:
        row = policies.load_policy(spark, alias).first()
        assert row["tenant_id"] == "corporate-global-hq"
        assert len(row["block_forbidden_tokens"]) == 13 and len(row["hitl_triggers"]) == 7
        assert row["enforce_pii_masking"] is True and row["minimum_safety_threshold"] == 0.8


def test_policy_defaults_and_rejects(spark, tmp_path):
    good = {
        "policy_metadata": {"tenant_id": "t", "version": "1"},
        "security_rules": {"block_forbidden_tokens": ["x"], "minimum_safety_threshold": 0.85},
        "fallbacks": {"token_violation": "no"},
    }
    (tmp_path / "good.json").write_text(json.dumps(good, indent=1))
    rows = policies.load_policy(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    assert rows[0]["hitl_triggers"] == [] and rows[0]["enforce_pii_masking"] is True


GOOD = {
    "policy_metadata": {"tenant_id": "t", "version": "1"},
    "security_rules": {"block_forbidden_tokens": ["x"], "minimum_safety_threshold": 0.85},
    "fallbacks": {"token_violation": "no"},
}


@pytest.mark.parametrize(
    "part, change",
    [
        ("policy_metadata", {"version": "1.0"}),
        ("security_rules", {"minimum_safety_threshold": 0.85}),
        ("security_rules", {"block_forbidden_tokens": ["x"]}),
        ("security_rules", {"block_forbidden_tokens": ["x"], "minimum_safety_threshold": "high"}),
        ("security_rules", {"block_forbidden_tokens": ["x"], "minimum_safety_threshold": 0.85, "enforce_pii_masking": False}),
        ("fallbacks", {}),
        (None, None),
    ],
)
def test_a_policy_that_lacks_a_rule_is_an_error(spark, tmp_path, part, change):
    (tmp_path / "good.json").write_text(json.dumps(GOOD))
    other = {**GOOD, part: change}
    (tmp_path / "other.json").write_text(json.dumps(other) if part else '{"policy_metadata": {')
    with pytest.raises(Exception, match="lacks|MALFORMED|FAILED_READ"):
        policies.load_policy(spark, str(tmp_path)).collect()


def test_lexicon(spark, tmp_path):
    rows = policies.bias_lexicon(spark).collect()
    assert len(rows) == 34 and len({r["category"] for r in rows}) == 5
    assert {"abrasive", "lame", "urban", "bossy"} <= {r["term"] for r in rows}
    assert policies.bias_lexicon(spark, str(tmp_path / "none.json")).count() == 0


def test_json_requests(spark, tmp_path):
    lines = [
        {"request_id": "a", "tenant_id": "t", "prompt": "text", "extra": 1},
        {"request_id": "b", "tenant_id": "t", "prompt": 12345},
        {"request_id": "c", "tenant_id": "t", "prompt": None},
        {"request_id": "d", "tenant_id": "t"},
        {"request_id": "e", "tenant_id": "t", "prompt": ""},
        {"request_id": "f", "tenant_id": "t", "prompt": {"x": 1}},
    ]
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, lines)))
    got = {r["request_id"]: r["prompt"] for r in requests.load_requests(spark, str(tmp_path), "json").collect()}
    assert got == {"a": "text", "b": None, "c": None, "d": None, "e": "", "f": None}


def test_corpus(spark):
    rows = corpus.load_corpus(spark)
    assert rows.count() == 6 and rows.filter("text <> trim(text)").count() == 0
    path = work_folder(spark, "test-corpus")
    corpus.corpus_upsert_new(rows, path)
    corpus.corpus_upsert_new(rows.withColumn("text", F.lit("other")), path)
    stored = corpus.corpus_scan(spark, path)
    assert stored.exceptAll(rows).count() == 0 and stored.count() == 6


def test_pages(spark):
    pages = spark.createDataFrame([("x" * 200, 200), ("x" * 201, 200), ("x" * 5000, 200), ("x" * 500, 404)], "html string, status int")
    assert sorted(len(r["html"]) for r in requests.admit_pages(pages).collect()) == [201, 4000]
    assert requests.admit_pages(pages.drop("status")).count() == 3


def test_text_helpers_agree_with_python(spark):
    samples = ["", "  a\tb\n\nc ", "one", " x y\x1cz\x85", "no-break space", "zero​width"]
    rows = spark.createDataFrame([(s,) for s in samples], "s string").select(
        "s", token_count(F.col("s")).alias("n"), stripped(F.col("s")).alias("t")
    )
    for row in rows.collect():
        assert row["n"] == len(row["s"].split()) and row["t"] == row["s"].strip()

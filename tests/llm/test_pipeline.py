"""The pipeline's stages, each against the operator's plain counterpart on its own input."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import corpus_pipeline  # noqa: E402
from wardline.session import stage  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, apply in corpus_pipeline.STAGES:
        out.append(stage(apply(spark, out[-1], SF), "test"))
    return out


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash_near_dedup", "pii", "packing"]
    assert all(s.columns == steps[0].columns and s.dtypes == steps[0].dtypes for s in steps[:-1])


def test_quality_stage(spark, steps):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in steps[1].collect()}
    good, bad = {i for i, q in labels.items() if q == 1}, {i for i, q in labels.items() if q == 0}
    assert len(good & kept) >= 0.98 * len(good) and len(bad & kept) <= 0.1 * len(bad)


def test_exact_stage(steps):
    wanted = {}
    for r in steps[1].collect():
        key = (r["text"] or "").encode().lower()
        wanted[key] = max(wanted.get(key, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in steps[2].collect()) == sorted(wanted.values())


def test_near_stage(steps):
    from tests.llm.test_copies import plain_components, plain_simhash

    prints = {r["doc_id"]: plain_simhash(r["text"], 3) for r in steps[2].orderBy("doc_id").collect()}
    assert sorted(r["doc_id"] for r in steps[3].collect()) == sorted(set(plain_components(prints).values()))


def test_pii_stage(steps):
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in steps[3:5])
    assert before.keys() == after.keys()
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    assert any(before[i]["text"] != after[i]["text"] for i in before)


def test_packing_stage(steps):
    from tokenizers import Tokenizer

    from tests.llm.test_tokens import check_packing
    from wardline.llm.packing import CAPACITY
    from wardline.llm.queries import tokenizer_path

    texts = {r["doc_id"]: r["text"] for r in steps[4].collect()}
    check_packing(steps[5].collect(), texts, Tokenizer.from_file(tokenizer_path()), CAPACITY)


def test_stages_of_empty_and_odd_tables(spark, odd, none):
    for docs in (odd, none):
        docs = docs.withColumnRenamed("row", "n_chars").selectExpr("doc_id", "text", "'en' AS lang", "n_chars AS source", "cast(length(text) AS long) AS n_chars")
        for name, apply in corpus_pipeline.STAGES:
            docs = stage(apply(spark, docs, SF), "odd")
        assert docs.columns[:2] == ["doc_id", "piece"]


#: Names that an operator gives to its results or uses inside, in either case.
CLASHING = (
    "score predicted Score_ __text __pattern __values __before n_card N_EMAIL __row __gone id row key lines kept_text n_lines n_dropped "
    "__id label counts quality keep_id group_size kept text_sha256 fingerprint component_id piece start length offset sequence_id ids_crc32 held_out"
).split()


def test_columns_of_any_name_go_through_each_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clashing = docs.select("*", *[F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")).alias(name) for name in CLASHING])
    plain = docs
    for name, apply in corpus_pipeline.STAGES[:-1]:
        plain, clashing = (stage(apply(spark, d, SF), "clash") for d in (plain, clashing))
        assert clashing.columns == [*docs.columns, *CLASHING], name
        assert sorted(clashing.select(docs.columns).collect()) == sorted(plain.collect()), name
        wrong = [c for c in CLASHING if clashing.where(F.col(c) != F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string"))).count()]
        assert wrong == [], name
    last = [corpus_pipeline.pack_sequences(spark, d, SF) for d in (plain, clashing)]
    assert sorted(last[0].select("doc_id", "piece", "ids_crc32").collect()) == sorted(last[1].select("doc_id", "piece", "ids_crc32").collect())

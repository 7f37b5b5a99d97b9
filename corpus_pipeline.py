"""A training corpus from raw documents: five stages, each a corpus operator.

Each stage is written as Parquet below ``spark.checkpoint.dir`` and read again by the next one. Null
and empty texts and repeated rows go the way that the operators document; an empty table gives an empty
result. Further columns of the documents, whatever their names, stay as they are up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import exactdedup, packing, pii, quality, simhash
from wardline.llm.common import fresh, table
from wardline.llm.queries import tokenizer_path
from wardline.session import stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit_from(docs, spark.read.parquet(table(sf_dir, "labels")))
    score, predicted = fresh(docs, "score"), fresh(docs, "predicted")
    judged = quality.scored(docs, model, score_col=score, predicted_col=predicted)
    return judged.where(F.col(predicted) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exactdedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the least id."""
    return simhash.dedup(docs, width=3)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data under pseudonyms; the length column follows the text."""
    before = fresh(docs, "__before")
    hidden = pii.pseudonymised(docs.withColumn(before, F.length("text")), counts=False)
    if "n_chars" in docs.columns:
        same = F.col(before) == F.length("text")
        hidden = hidden.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return hidden.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place in it."""
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", hide_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of ``sf_dir`` to packed pieces."""
    docs = spark.read.parquet(table(sf_dir, "documents"))
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: The stages classify, cluster and tokenize: no SQL has the same rows. Tests hold them against brute force.
ORACLE_SQL = None

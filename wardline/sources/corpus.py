"""The passages that retrieval searches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import config
from wardline.functions.text import stripped
from wardline.schemas import CORPUS


def load_corpus(spark: SparkSession, path: str = config.REGULATORY_CORPUS) -> DataFrame:
    """``(doc_id, text)`` rows of a JSON-lines file, texts stripped."""
    return spark.read.schema(CORPUS).json(path).withColumn("text", stripped(F.col("text")))


def corpus_scan(spark: SparkSession, path: str, schema=CORPUS) -> DataFrame:
    """The stored corpus; an absent one is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def new_documents(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates whose id is not stored yet, one per id; the first text in order wins.

    The candidates are cut to new ids before they are grouped, and grouping combines first.
    """
    fresh = candidates.join(stored.select("doc_id"), "doc_id", "left_anti")
    others = [c for c in candidates.columns if c != "doc_id"]
    picked = fresh.groupBy("doc_id").agg(F.min(F.struct(*others)).alias("row"))
    return picked.select("doc_id", "row.*").select(*candidates.columns)


def corpus_upsert_new(candidates: DataFrame, path: str) -> None:
    """Append the documents whose id is not present."""
    stored = corpus_scan(candidates.sparkSession, path, candidates.schema)
    new_documents(candidates, stored).write.mode("append").parquet(path)

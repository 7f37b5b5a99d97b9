"""Request and page sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.schemas import REQUESTS

MIN_PAGE_CHARS = 200
MAX_PAGE_CHARS = 4000


def load_requests(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False, schema=REQUESTS) -> DataFrame:
    """Request rows with a fixed schema, from files or as a stream of arriving files.

    JSON prompts that are not strings come out as null, so that validation rejects them;
    fields outside the schema are ignored.
    """
    reader = spark.readStream if streaming else spark.read
    if fmt != "json":
        return reader.schema(schema).format(fmt).load(path)
    lines = reader.text(path)
    row = F.from_json("value", schema)
    prompt = F.try_variant_get(F.try_parse_json("value"), "$.prompt", "variant")
    is_text = F.schema_of_variant(prompt) == "STRING"
    parsed = lines.select(row.alias("row"), is_text.alias("is_text"))
    fields = [F.col(f"row.{f.name}").alias(f.name) for f in schema if f.name != "prompt"]
    return parsed.select(*fields, F.when(F.col("is_text"), F.col("row.prompt")).alias("prompt"))


def admit_pages(pages: DataFrame, body: str = "html", status: str = "status") -> DataFrame:
    """Pages worth indexing: fetched well, longer than the minimum, cut to the maximum length."""
    kept = pages.filter(F.length(body) > MIN_PAGE_CHARS)
    if status in pages.columns:
        kept = kept.filter(F.col(status) == 200)
    return kept.withColumn(body, F.substring(body, 1, MAX_PAGE_CHARS))

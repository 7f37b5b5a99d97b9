"""The ledger as a stored table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.ledger import BLOCK_ROWS, CHAIN, day_segment, drop_duplicates, duplicate_requests, seal_staged
from wardline.schemas import AUDIT_COLUMNS, LEDGER
from wardline.session import stage
from wardline.sources.id_index import stored_ids, write_ids
from wardline.sources.manifest import Manifest, commit, read_manifest


class DuplicateRequestError(ValueError):
    """A request id that may occur only once was to be appended again."""


def ledger_scan(spark: SparkSession, path: str) -> DataFrame:
    """All ledger rows; an absent store gives none.

    Of a ledger with a manifest only the committed appends are read; one without (a stream's, or rows written
    by ``write_sealed``) is read whole.
    """
    try:
        committed = read_manifest(spark, path).folders(path)
        rows = spark.read.schema(LEDGER)
        return (rows.option("basePath", path).parquet(*committed) if committed else rows.parquet(path)).select(*LEDGER.names)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def ledger_append(
    entries: DataFrame,
    path: str,
    segment: Column | None = None,
    block_rows: int | None = BLOCK_ROWS,
    on_duplicate: str = "error",
) -> None:
    """Seal entries and append them, going on from the chains that are stored.

    ``on_duplicate='error'`` appends nothing if a request id is not new; ``'skip'`` keeps the first entry of each
    new id. What the append needs of the ledger is read from its manifest (the last id), from the heads of the
    batch's segments, and from the index of request ids: the rows themselves are not read. An append counts
    once its manifest is there; of two writers at a time the second gets an error.
    """
    spark, path = entries.sparkSession, path.rstrip("/")
    before = read_manifest(spark, path)
    if not before.appends and not ledger_scan(spark, path).isEmpty():
        raise ValueError(f"{path}: a ledger without a manifest, which only its stream or its writer can go on with")
    entries = stage(entries, "entries")
    known = stored_ids(entries, path, before.appends) if before.appends else None
    if on_duplicate == "skip":
        entries = stage(drop_duplicates(entries, known), "entries")
    else:
        repeated = duplicate_requests(entries, known).select("request_id").take(5)
        if repeated:
            raise DuplicateRequestError(", ".join(row[0] for row in repeated))
    heads = _heads_of(entries, path, before, day_segment() if segment is None else segment)
    append = before.new_name()
    write_sealed(seal_staged(entries, segment, block_rows, heads, before.last_id), f"{path}/append={append}")
    written = spark.read.schema(LEDGER).parquet(f"{path}/append={append}")
    new_heads = written.groupBy(*CHAIN).agg(F.max("seq").alias("last_seq"), F.max_by("current_hash", "seq").alias("head"), F.max("id").alias("last_id"))
    new_heads.write.parquet(f"{path}/_heads/append={append}")
    last_id = spark.read.schema(_HEADS).parquet(f"{path}/_heads/append={append}").agg(F.max("last_id")).first()[0]
    if last_id is None:
        return
    write_ids(entries, path, append)
    commit(spark, path, before, append, last_id)


_HEADS = "tenant_id string, segment string, block long, last_seq long, head string, last_id long"


def _heads_of(entries: DataFrame, path: str, before: Manifest, segment: Column) -> DataFrame | None:
    """The ends of the chains in the entries' segments; each append has those of the chains it touched."""
    if not before.appends:
        return None
    named = lambda column: F.coalesce(column, F.lit(""))
    own = entries.select(named(segment).alias("__segment")).distinct()
    stored = entries.sparkSession.read.schema(_HEADS).parquet(*before.folders(path, "/_heads"))
    touched = stored.withColumn("__segment", named(F.col("segment"))).join(own, "__segment", "left_semi")
    return touched.groupBy(*CHAIN).agg(F.max("last_seq").alias("last_seq"), F.max_by("head", "last_seq").alias("head"))


def write_sealed(sealed: DataFrame, path: str, mode: str = "append") -> None:
    """Write sealed rows, one folder per segment.

    The sealing job left each chain whole and in order in one task, so files hold whole chains
    and their statistics prune by tenant; a folder per tenant as well would only add small files.
    """
    sealed.write.mode(mode).partitionBy("segment").parquet(path)


def bootstrap_ledger(entries: DataFrame, path: str, **options) -> int:
    """Append a starting batch if the ledger is empty; the number of rows added."""
    spark = entries.sparkSession
    if not ledger_scan(spark, path).isEmpty():
        return 0
    ledger_append(entries, path, **options)
    return ledger_scan(spark, path).count()


def export_ledger_csv(ledger: DataFrame, path: str) -> None:
    """All eight audit columns with a header, in part files written in parallel."""
    ledger.select(*AUDIT_COLUMNS).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = "id long, " + ", ".join(f"{c} string" for c in AUDIT_COLUMNS[1:])
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)

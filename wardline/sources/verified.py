"""Verification of an appended ledger that goes on from what was verified before.

Each append that was found intact leaves a signed record per file: its name, its length and the SHA-256 of its bytes.
A later run holds the files against these records, as bytes, and decodes and hashes rows of those appends only
that are new or not as recorded. The records say nothing of appends that were taken off the manifest together
with their records: ``verify_seals`` does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.ledger import bad_rows
from wardline.schemas import LEDGER
from wardline.session import stage
from wardline.sources.manifest import names_below, read_manifest

_RECORD = "file string, length long, digest string, signature string"
_RESULT = "append_no int, status string, n_read long, first_bad_id long"
#: Spark reads a file's bytes as one value; of a longer file the rows are read in every run.
LONGEST = (1 << 31) - (1 << 20)


def _signature(key: str) -> Column:
    """A keyed hash of a record; the outer hash keeps the inner one from being gone on with."""
    message = F.concat_ws("|", "file", F.col("length").cast("string"), "digest")
    return F.sha2(F.concat(F.lit(key), F.sha2(F.concat(F.lit(key), message), 256)), 256)


def _files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``append, file, length, digest`` of the files in the folders; no digest where a file is too long for one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folders)
    return files.select(
        F.regexp_extract("path", r"/append=([^/]+)/", 1).alias("append"),
        F.substring_index("path", "/append=", -1).alias("file"),
        "length",
        F.when(F.col("length") <= LONGEST, F.sha2("content", 256)).alias("digest"),
    )


def _checked_rows(spark: SparkSession, path: str, appends: list[str]) -> DataFrame:
    """``append, n_read, first_bad_id``: every row's hash is worked out from its fields."""
    rows = spark.read.schema(LEDGER).option("basePath", path).parquet(*[f"{path}/append={name}" for name in appends])
    marked = rows.select(*LEDGER.names, F.regexp_extract(F.col("_metadata.file_path"), r"/append=([^/]+)/", 1).alias("append"))
    bad = bad_rows(marked).groupBy("append").agg(F.min("id").alias("first_bad_id"))
    return marked.groupBy("append").agg(F.count("*").alias("n_read")).join(bad, "append", "left")


def verify_appends(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One row per committed append: ``append_no, status, n_read, first_bad_id``.

    ``unchanged``: its files are as recorded, no row was read; ``verified``: its rows were read and are intact, and
    it had no record; ``altered``: a file was changed, added or lost since it was recorded, or a record is not signed with
    ``key`` (``first_bad_id`` is null if every row is consistent in itself); ``broken``: never recorded, and a row's
    hash is not that of its fields. Only what is intact is recorded, so faults are named by every run. A ledger without
    appends gives no rows.
    """
    if not key:
        raise ValueError("verify_appends needs a key to sign its records with")
    path, manifest = path.rstrip("/"), read_manifest(spark, path)
    if not manifest.appends:
        return spark.createDataFrame([], _RESULT)
    listed = set(names_below(spark, f"{path}/_verified"))
    recorded = [name for name in manifest.appends if f"append={name}" in listed]
    here = set(names_below(spark, path))
    present = [name for name in manifest.appends if f"append={name}" in here]
    suspects = _suspects(spark, path, [name for name in recorded if name in present], key)
    gone = set(manifest.appends) - set(present)
    new = [name for name in present if name not in recorded]
    read = [name for name in present if name in suspects or name in new]
    rows = _checked_rows(spark, path, read) if read else spark.createDataFrame([], "append string, n_read long, first_bad_id long")
    # Files could change between the reading and the recording: what is recorded is what lay there before.
    before = stage(_files(spark, [f"{path}/append={name}" for name in new]), "ledger-files") if new else None
    rows = stage(rows, "ledger-rows")
    states = [(n + 1, name, name in gone or name in suspects, name in read) for n, name in enumerate(manifest.appends)]
    known = spark.createDataFrame(states, "append_no int, append string, altered boolean, was_read boolean")
    status = (
        F.when(F.col("altered"), "altered").when(~F.col("was_read"), "unchanged").when(F.col("first_bad_id").isNotNull(), "broken").otherwise("verified")
    )
    result = stage(known.join(rows, "append", "left").select("append_no", "append", status.alias("status"), F.coalesce("n_read", F.lit(0)).cast("long").alias("n_read"), "first_bad_id"), "verified")
    if before is not None:
        good = before.where(F.col("digest").isNotNull()).join(result.where("status = 'verified'").select("append"), "append", "left_semi")
        # A folder of records appears per append, those of earlier runs stay as they are.
        good.withColumn("signature", _signature(key)).write.mode("append").partitionBy("append").parquet(f"{path}/_verified")
    return result.select("append_no", "status", "n_read", "first_bad_id")


def _suspects(spark: SparkSession, path: str, appends: list[str], key: str) -> set[str]:
    """The recorded appends of which a file or a record is not as it was."""
    if not appends:
        return set()
    records = spark.read.schema(_RECORD).parquet(*[f"{path}/_verified/append={name}" for name in appends])
    valid = records.where(_signature(key) == F.col("signature")).select("file", F.col("length").alias("__length"), F.col("digest").alias("__digest")).distinct()
    now = _files(spark, [f"{path}/append={name}" for name in appends])
    met = now.join(valid, "file", "full")
    other = F.col("digest").isNull() | ~(F.col("__length").eqNullSafe(F.col("length")) & F.col("__digest").eqNullSafe(F.col("digest")))
    name = F.coalesce("append", F.substring_index("file", "/", 1))
    # One name per append: the manifest that the driver has read lists them all.
    return {row[0] for row in met.where(other).select(name).distinct().collect()}

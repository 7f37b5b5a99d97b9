"""Which ids a table has, without reading them all.

Ids fall into prefixes of their hash. Each append stores its ids in the order of prefixes, and one Bloom
filter per prefix. Looking a batch's ids up reads the filters; ids that some append's filter may have are read
from that append's files alone, and there from the row groups of their prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import stage

#: Parts of the hash space. A task looks up one prefix at a time: its ids of the batch, and its filters of all
#: appends, two bytes per stored id.
PREFIXES = 256
BITS, PROBES = 16, 6

_IDS = "prefix int, request_id string, append string"
_FILTERS = "prefix int, bits binary, append string"


def keyed(rows: DataFrame) -> DataFrame:
    """``prefix, h, request_id`` of the ids; nulls have none."""
    ids = rows.select("request_id").where("request_id IS NOT NULL").withColumn("h", F.xxhash64("request_id"))
    return ids.select(F.pmod("h", F.lit(PREFIXES)).cast("int").alias("prefix"), "h", "request_id")


def _places(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The bits of each hash in a filter of ``size`` bits, a power of two."""
    first, step = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (first + np.uint64(i) * step) & np.uint64(size - 1)


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def build_filter(hashes: np.ndarray) -> bytes:
    size = 1 << max(6, (BITS * len(hashes) - 1).bit_length())
    bits = np.zeros(size, bool)
    for at in _places(hashes, size):
        bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_have(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    data, found = np.frombuffer(bits, np.uint8), np.ones(len(hashes), bool)
    for at in _places(hashes, 8 * len(data)):
        found &= (data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def _filter_of(table: pa.Table) -> pa.Table:
    bits = build_filter(_unsigned(table.column("h")))
    return pa.table({"prefix": table.column("prefix").slice(0, 1), "bits": pa.array([bits], pa.binary())})


def _suspects_of(asked: pa.Table, filters: pa.Table) -> pa.Table:
    parts = []
    if asked.num_rows and filters.num_rows:
        hashes = _unsigned(asked.column("h"))
        for bits, append in zip(filters.column("bits"), filters.column("append").to_pylist(), strict=True):
            hit = asked.select(["prefix", "request_id"]).filter(pa.array(may_have(bits.as_py(), hashes)))
            parts.append(hit.append_column("append", pa.array([append] * hit.num_rows, pa.string())))
    schema = pa.schema([("prefix", pa.int32()), ("request_id", pa.string()), ("append", pa.string())])
    return pa.concat_tables(p.cast(schema) for p in parts) if parts else schema.empty_table()


def write_ids(rows: DataFrame, path: str, append: str) -> None:
    """Store the ids of an append, and their filters."""
    ids = keyed(rows)
    ids.groupBy("prefix").applyInArrow(_filter_of, "prefix int, bits binary").write.parquet(f"{path}/_filters/append={append}")
    sorted_ids = ids.select("prefix", "request_id").repartitionByRange("prefix").sortWithinPartitions("prefix")
    sorted_ids.write.option("parquet.block.size", 1 << 22).parquet(f"{path}/_ids/append={append}")


def _read(spark: SparkSession, path: str, part: str, appends: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{path}/{part}").parquet(*[f"{path}/{part}/append={a}" for a in appends])


def stored_ids(rows: DataFrame, path: str, appends: tuple[str, ...]) -> DataFrame:
    """``request_id``: those of the rows' ids that one of the appends has."""
    spark, path = rows.sparkSession, path.rstrip("/")
    filters = _read(spark, path, "_filters", list(appends), _FILTERS)
    asked = keyed(rows).groupBy("prefix").cogroup(filters.groupBy("prefix")).applyInArrow(_suspects_of, _IDS)
    suspects = stage(asked, "suspects")
    # At most one row per prefix and append.
    places = suspects.select("prefix", "append").distinct().collect()
    if not places:
        return suspects.select("request_id")
    ids = _read(spark, path, "_ids", sorted({r["append"] for r in places}), _IDS).where(F.col("prefix").isin(sorted({r["prefix"] for r in places})))
    return suspects.join(ids, ["append", "prefix", "request_id"], "left_semi").select("request_id").distinct()

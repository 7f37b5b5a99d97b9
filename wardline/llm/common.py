"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows alike in their id and this value are copies of one row.
ROW_HASH = "__row_hash"


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row: with the id it names a row by its content, in any later scan."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def table(path: str, name: str) -> str:
    """The path of a table of the corpus."""
    return f"{path}/{name}.parquet"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with bars added until ``df`` has no column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those named like a result, which replaces them."""
    replaced = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in replaced]


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; a null counts as an empty text."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def slices(batch: pa.RecordBatch, text: str, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes of text, one row at least: what one step holds in memory."""
    start = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
        if held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def as_binary(text: str) -> Column:
    """The text as bytes, empty for null: Arrow hands them to Python without decoding."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def signed(value: int) -> int:
    """An unsigned 64-bit number as the signed one with the same bits."""
    return value - (1 << 64) if value >= 1 << 63 else value


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bit_positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two positions in a filter of ``bits`` (a power of two) bits for each unsigned 64-bit hash."""
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(31)) & mask


def has_bits(filter_bytes: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """For each hash, whether both of its bits are set."""
    found = np.ones(len(hashes), bool)
    for at in bit_positions(hashes, bits):
        found &= (filter_bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def set_bits(filter_bytes: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    for at in bit_positions(hashes, bits):
        np.bitwise_or.at(filter_bytes, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

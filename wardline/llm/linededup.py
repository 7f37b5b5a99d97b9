"""Removal of lines that many documents share.

A first pass over the documents fills two Bloom filters with line hashes: those seen, and those seen
again (within a task, or by two tasks: what two tasks both have is in the intersection of their
filters). Only lines in the second filter are suspects; they alone are shuffled, by their exact key,
to count documents and find the first occurrence. The filters have a fixed size: where a corpus fills
them, more lines become suspects, and the result stays exact.

The decisions go back to the texts, not the texts to them: the ``HOT`` repeated lines of most documents are sent
to every task by their exact keys. Of the other repeated lines a third filter is sent; only documents that may
have one of those are shuffled, to meet the numbers of their lines.

A null or empty text is one empty line. A document is a row; rows alike in everything count as
separate documents. An empty table gives an empty result. Columns named like a result are replaced by it;
all others come back as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import as_binary, fresh, has_bits, set_bits, shuffle_partitions, slices, texts_of, without
from wardline.session import stage

#: Bits of each of the two filters: 4 MB each, the only thing that is broadcast.
FILTER_BITS = 1 << 25
#: The most repeated lines that are sent to every task: at most 33 bytes each.
HOT = 100_000
_SEGMENT = 1 << 12
#: Keys up to so many bytes travel as they are, longer ones as their SHA-256.
_LITERAL = 32


_PARTIAL = "segment int, once binary, twice binary"


def line_key(line: bytes) -> bytes:
    """Without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _exact(key: bytes) -> bytes:
    return b"=" + key if len(key) <= _LITERAL else b"#" + hashlib.sha256(key).digest()


def seen_twice(df: DataFrame, text_col: str, min_chars: int) -> np.ndarray:
    """The filter of line hashes that two documents or more have, as bytes."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(FILTER_BITS // 8, np.uint8), np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            hashes: list[int] = []
            for text in texts_of(batch.column("text")):
                keys = set(map(line_key, text.split(b"\n")))
                hashes.extend(xxhash.xxh3_64_intdigest(k) for k in keys if _long_enough(k, min_chars))
            own, counts = np.unique(np.array(hashes, np.uint64), return_counts=True)
            set_bits(twice, own[(counts > 1) | has_bits(once, own, FILTER_BITS)], FILTER_BITS)
            set_bits(once, own, FILTER_BITS)
        yield _in_segments(once, twice)

    return _united(df.select(as_binary(text_col).alias("text")).mapInArrow(partial, _PARTIAL), shuffle_partitions(df))


def _in_segments(once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    """The segments of a task's two filters that have a bit."""
    rows = []
    for k, (a, b) in enumerate(zip(once.reshape(-1, _SEGMENT), twice.reshape(-1, _SEGMENT), strict=True)):
        if a.any():
            rows.append((k, zlib.compress(a.tobytes(), 1), zlib.compress(b.tobytes(), 1)))
    k, a, b = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["segment", "once", "twice"])


def _united(parts: DataFrame, partitions: int) -> np.ndarray:
    """The second filter over all tasks: what one has in it, or two have seen."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by segment; one segment's two bit strings are held at a time."""
        current, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"segment": pa.array([current], pa.int32()), "twice": pa.array([twice.tobytes()], pa.binary())})

        for batch in batches:
            for k, a, b in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice")), strict=True):
                if k != current:
                    if current is not None and twice.any():
                        yield done()
                    current, once, twice = k, np.zeros(_SEGMENT, np.uint8), np.zeros(_SEGMENT, np.uint8)
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                twice |= b | (once & a)
                once |= a
        if current is not None and twice.any():
            yield done()

    merged = (
        parts.repartition(partitions, "segment")
        .sortWithinPartitions("segment")
        .mapInArrow(merge, "segment int, twice binary")
        .toArrow()
    )
    out = np.zeros((FILTER_BITS // 8 // _SEGMENT, _SEGMENT), np.uint8)
    for k, bits in zip(merged.column("segment").to_pylist(), merged.column("twice").to_pylist(), strict=True):
        out[k] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def _suspect_schema() -> pa.Schema:
    return pa.schema([("key", pa.binary()), ("id", pa.int64()), ("row", pa.int64()), ("lines", pa.list_(pa.int32()))])


def _suspects_of(texts: Iterator[bytes], bits: np.ndarray, min_chars: int) -> Iterator[tuple[int, bytes, list[int]]]:
    """``place of the text, exact key, lines`` of each line key of the texts that the second filter has."""
    docs, keys, numbers, hashes = [], [], [], []
    for i, text in enumerate(texts):
        own: dict[bytes, list[int]] = {}
        for n, line in enumerate(text.split(b"\n")):
            key = line_key(line)
            if _long_enough(key, min_chars):
                own.setdefault(key, []).append(n)
        docs.extend([i] * len(own))
        keys.extend(own)
        numbers.extend(own.values())
        hashes.extend(map(xxhash.xxh3_64_intdigest, own))
    for k in np.flatnonzero(has_bits(bits, np.array(hashes, np.uint64), FILTER_BITS)).tolist():
        yield docs[k], _exact(keys[k]), numbers[k]


def suspects(df: DataFrame, id_col: str, text_col: str, min_chars: int, flags: Broadcast) -> DataFrame:
    """``key, id, row, lines`` of each line key of a document that the second filter, ``flags``, has."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(flags.value, np.uint8)
        for batch in batches:
            hits = list(_suspects_of(texts_of(batch.column("text")), bits, min_chars))
            at, keys, numbers = zip(*hits, strict=True) if hits else ((), (), ())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), batch.column("id").take(at), batch.column("row").take(at), pa.array(numbers, pa.list_(pa.int32()))],
                schema=_suspect_schema(),
            )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("row"), as_binary(text_col).alias("text"))
    return rows.mapInArrow(find, "key binary, id long, row long, lines array<int>")


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A filter of the exact keys of a column ``key``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            hashes = [xxhash.xxh3_64_intdigest(k) for k in batch.column("key").to_pylist()]
            set_bits(bits, np.array(hashes, np.uint64), FILTER_BITS)
        yield _in_segments(bits, bits)

    return _united(keys.select("key").mapInArrow(partial, _PARTIAL), shuffle_partitions(keys))


def dedup_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 1,
    min_docs: int = 10,
    keep_first: bool = False,
) -> DataFrame:
    """``df`` with ``kept_text``, ``n_lines`` and ``n_dropped``.

    Lines whose key has at least ``min_chars`` code points and stands in at least ``min_docs``
    documents go; with ``keep_first`` the first of them, by id and line number, stays (in each row
    that is a copy of its row). The other lines stay as they are, joined by a newline.
    """
    spark = df.sparkSession
    flags = spark.sparkContext.broadcast(seen_twice(df, text_col, min_chars).tobytes())
    found = stage(suspects(df, id_col, text_col, min_chars, flags), "line-suspects")
    first = F.min(F.struct("id", "row", F.col("lines")[0].alias("line"))).alias("first")
    repeats = stage(found.groupBy("key").agg(F.count("*").alias("docs"), first).where(F.col("docs") >= min_docs), "line-repeats")
    most = repeats.orderBy(F.desc("docs"), "key").limit(HOT).select("key", "docs", "first.*").toArrow()
    names = ("id", "row", "line") if keep_first else ()
    stays = zip(*(most.column(c).to_pylist() for c in names), strict=True) if keep_first else [None] * len(most)
    hot = spark.sparkContext.broadcast(dict(zip(most.column("key").to_pylist(), stays, strict=True)))

    row, read, kept_columns = fresh(df, "__row"), fresh(df, "__text"), without(df, "kept_text", "n_lines", "n_dropped")
    marked = df.withColumns({row: F.xxhash64(id_col, text_col), read: as_binary(text_col)})
    own_id, gone = fresh(marked, "__id"), fresh(marked, "__gone")
    inputs = [*[marked[c] for c in kept_columns], marked[id_col].cast("long").alias(own_id), marked[row], marked[read]]
    nothing = F.lit(None).cast("array<int>").alias(gone)
    schema = T.StructType([*(df.schema[c] for c in kept_columns), T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(flags.value, np.uint8)
        for batch in batches:
            for part in slices(batch, read):
                *columns, ids, rows, texts, gone_lines = part.columns
                ids, rows, texts = ids.to_pylist(), rows.to_pylist(), list(texts_of(texts))
                drops = [set(numbers or ()) for numbers in gone_lines.to_pylist()]
                for i, key, lines in _suspects_of(texts, bits, min_chars):
                    if key in hot.value:
                        stay = hot.value[key]
                        drops[i].update(n for n in lines if stay != (ids[i], rows[i], n))
                kept = [
                    b"\n".join(line for n, line in enumerate(text.split(b"\n")) if n not in numbers) if numbers else text
                    for text, numbers in zip(texts, drops, strict=True)
                ]
                counts = [pa.array([text.count(b"\n") + 1 for text in texts], pa.int64()), pa.array(map(len, drops), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary()).cast(pa.string()), *counts], names=schema.names)

    if len(most) < HOT:
        return marked.select(*inputs, nothing).mapInArrow(rebuild, schema)

    # The repeated lines behind the last hot one, and the documents that may have one of them.
    least, last = most.column("docs")[-1].as_py(), most.column("key")[-1].as_py()
    rest = repeats.where((F.col("docs") < least) | ((F.col("docs") == least) & (F.col("key") > F.lit(last))))
    others = spark.sparkContext.broadcast(_filter_of(rest).tobytes())

    @F.pandas_udf(T.BooleanType())
    def may_have(texts: pd.Series) -> pd.Series:
        bits, rare = np.frombuffer(flags.value, np.uint8), np.frombuffer(others.value, np.uint8)
        out = np.zeros(len(texts), bool)
        hits = list(_suspects_of(map(bytes, texts), bits, min_chars))
        if hits:
            found_at = has_bits(rare, np.array([xxhash.xxh3_64_intdigest(key) for _, key, _ in hits], np.uint64), FILTER_BITS)
            out[np.array([i for i, _, _ in hits])[found_at]] = True
        return pd.Series(out)

    hits = found.join(rest, "key")
    if keep_first:
        own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row") == F.col("first.row"))
        hits = hits.withColumn("lines", F.when(own, F.expr("filter(lines, x -> x <> first.line)")).otherwise(F.col("lines")))
    # A row that occurs twice has its lines twice here; a set of line numbers does not mind.
    drops = stage(hits.groupBy("id", "row").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias(gone)), "line-drops")
    flag = fresh(marked, "__flag")
    told = marked.select(*inputs, may_have(F.col(read)).alias(flag))
    plain = told.where(~F.col(flag)).drop(flag).withColumn(gone, nothing)
    some = told.where(F.col(flag)).drop(flag)
    same = some[own_id].eqNullSafe(drops["id"]) & (some[row] == drops["row"])
    met = some.join(drops, same, "left").select(*[some[c] for c in some.columns], drops[gone])
    return plain.unionAll(met).mapInArrow(rebuild, schema)

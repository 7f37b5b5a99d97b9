"""Exact deduplication by polynomial fingerprints that compose.

A text is hashed as a polynomial over its bytes modulo two primes. The hash of a long text is put
together from the hashes of its segments, each shifted by the number of bytes behind it, so that the
segments of one huge document are hashed in many tasks and summed. Texts with equal fingerprints are
compared chunk by chunk: of each fingerprint and chunk only the least and the greatest chunk travel,
combined before the shuffle, and they are the same exactly when all are.

Null and empty texts are equal. Rows alike in everything count as separate rows, of which one stays.
A null id is smaller than any other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import ROW_HASH, as_binary, has_bits, row_hash, set_bits, texts_of
from wardline.session import stage

#: Primes below 2**39 and bases: a byte times a power, summed over a chunk, stays below 2**63.
PRIMES = (549755813881, 549755813869)
BASES = (400000000019, 270000000011)
CHUNK = 1 << 16
#: Bytes from which a document's segments are hashed in tasks of their own.
SEGMENT = 1 << 22
#: Size of the filter that keeps unrepeated texts out of the comparison; 2 MB, whatever the corpus.
FILTER_BITS = 1 << 24

_PRINT = ["fp_a", "fp_b", "n_bytes"]


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """``base ** (n - 1), ..., base, 1`` modulo the prime."""
    out = [1] * n
    for i in range(1, n):
        out[i] = out[i - 1] * base % prime
    return np.array(out[::-1], np.uint64)


class Polynomial:
    """The fingerprint of bytes, and its parts."""

    def __init__(self) -> None:
        self.powers = [_powers(b, p, CHUNK) for b, p in zip(BASES, PRIMES, strict=True)]

    def of(self, data: bytes) -> tuple[int, int]:
        """Horner's rule over chunks: shift what came before by the chunk's length, add the chunk."""
        h = [0, 0]
        for at in range(0, len(data), CHUNK):
            chunk = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - at), at).astype(np.uint64) + np.uint64(1)
            for k, prime in enumerate(PRIMES):
                part = int(np.dot(chunk, self.powers[k][-len(chunk) :])) % prime
                h[k] = (h[k] * pow(BASES[k], len(chunk), prime) + part) % prime
        return h[0], h[1]

    def shifted(self, data: bytes, behind: int) -> tuple[int, int]:
        """The share of a segment in its text's fingerprint, with ``behind`` bytes after it."""
        a, b = self.of(data)
        return a * pow(BASES[0], behind, PRIMES[0]) % PRIMES[0], b * pow(BASES[1], behind, PRIMES[1]) % PRIMES[1]


def _prints_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    poly = Polynomial()
    for batch in batches:
        rows = []
        for text in texts_of(batch.column("text")):
            low = text.lower()
            rows.append((*poly.of(low), len(low), hashlib.sha256(low).hexdigest()))
        a, b, n, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column(ROW_HASH), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())],
            names=["id", ROW_HASH, *_PRINT, "text_sha256"],
        )


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of huge texts, one row each, with the bytes behind them."""
    for batch in batches:
        ids, hashes, rows = batch.column("id").to_pylist(), batch.column(ROW_HASH).to_pylist(), batch.column("row").to_pylist()
        for i, text in enumerate(texts_of(batch.column("text"))):
            low = text.lower()
            sha = hashlib.sha256(low).hexdigest()
            for at in range(0, len(low), SEGMENT):
                part = low[at : at + SEGMENT]
                yield pa.RecordBatch.from_pylist(
                    [{"id": ids[i], ROW_HASH: hashes[i], "row": rows[i], "segment": at // SEGMENT, "behind": len(low) - at - len(part), "part": part, "text_sha256": sha}],
                    pa.schema([("id", pa.int64()), (ROW_HASH, pa.int64()), ("row", pa.int64()), ("segment", pa.int32()), ("behind", pa.int64()), ("part", pa.binary()), ("text_sha256", pa.string())]),
                )


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    poly = Polynomial()
    for batch in batches:
        out = [(*poly.shifted(part.as_py(), behind.as_py()), len(part.as_py())) for part, behind in zip(batch.column("part"), batch.column("behind"), strict=True)]
        a, b, n = zip(*out, strict=True) if out else ((), (), ())
        kept = [batch.column(c) for c in ("id", ROW_HASH, "row", "text_sha256")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["id", ROW_HASH, "row", "text_sha256", *_PRINT])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the row's hash, fingerprint, length in bytes and SHA-256 of each lower-cased text."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), row_hash(df).alias(ROW_HASH), F.monotonically_increasing_id().alias("row"), as_binary(text_col).alias("text"))
    size = F.octet_length("text")
    short = rows.where(size <= SEGMENT).drop("row").mapInArrow(_prints_of_texts, f"id long, {ROW_HASH} long, fp_a long, fp_b long, n_bytes long, text_sha256 string")
    # The sums are of numbers below 2**39: no overflow below millions of segments.
    long = (
        rows.where(size > SEGMENT)
        .mapInArrow(_segments, f"id long, {ROW_HASH} long, row long, segment int, behind long, part binary, text_sha256 string")
        .repartition("row", "segment")
        .mapInArrow(_shares, f"id long, {ROW_HASH} long, row long, text_sha256 string, fp_a long, fp_b long, n_bytes long")
        .groupBy("id", ROW_HASH, "row", "text_sha256")
        .agg((F.sum("fp_a") % PRIMES[0]).alias("fp_a"), (F.sum("fp_b") % PRIMES[1]).alias("fp_b"), F.sum("n_bytes").alias("n_bytes"))
    )
    return short.unionByName(long.select(short.columns))


def _mixed(fp_a: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    x = fp_a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + n_bytes.astype(np.uint64)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _repeat_filter(repeated: DataFrame) -> bytes:
    """A filter of fixed size over the repeated fingerprints: built in parts, sent as non-zero words."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            set_bits(own, _mixed(batch.column("fp_a").to_numpy(), batch.column("n_bytes").to_numpy()), FILTER_BITS)
        words = own.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words[at], pa.int64())], names=["at", "word"])

    words = np.zeros(FILTER_BITS // 64, np.int64)
    merged = repeated.select("fp_a", "n_bytes").mapInArrow(parts, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words[merged.column("at").to_numpy()] = merged.column("word").to_numpy()
    return words.tobytes()


def unlike_texts(df: DataFrame, repeated: DataFrame, text_col: str = "text") -> DataFrame:
    """The fingerprints that texts share although the texts differ (in practice none)."""
    flags = df.sparkSession.sparkContext.broadcast(_repeat_filter(repeated))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly, bits = Polynomial(), np.frombuffer(flags.value, np.uint8)
        names = [*_PRINT, "chunk", "part"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows, held = [], 0
            for text in texts_of(batch.column("text")):
                low = text.lower()
                a, b = poly.of(low)
                if not has_bits(bits, _mixed(np.array([a]), np.array([len(low)])), FILTER_BITS)[0]:
                    continue
                for at in range(0, len(low), CHUNK):
                    rows.append((a, b, len(low), at // CHUNK, low[at : at + CHUNK]))
                    held += len(rows[-1][-1])
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return (
        df.select(as_binary(text_col).alias("text"))
        .mapInArrow(chunks, "fp_a long, fp_b long, n_bytes long, chunk long, part binary")
        .groupBy(*_PRINT, "chunk")
        .agg(F.min("part").alias("least"), F.max("part").alias("most"))
        .where("least <> most")
        .select(*_PRINT)
        .distinct()
    )


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, the id that stays, the group's size, whether it is the one.

    Of equal texts (after lower-casing A-Z) the row with the largest id stays; of rows with the same
    id, one. ``text_sha256`` is that of the lower-cased text.
    """
    prints = stage(fingerprints(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "prints")
    repeated = stage(prints.groupBy(*_PRINT).count().where("count > 1").select(*_PRINT), "repeated")
    unlike = stage(unlike_texts(df, repeated, text_col), "unlike")
    if unlike.isEmpty():
        tagged = prints.withColumn("tag", F.lit(""))
    else:
        # Texts that only share a fingerprint are told apart by their SHA-256.
        tagged = prints.join(unlike.withColumn("differ", F.lit(True)), _PRINT, "left").withColumn("tag", F.when(F.col("differ"), F.col("text_sha256")).otherwise("")).drop("differ")
    keys = [*_PRINT, "tag"]
    groups = stage(
        tagged.groupBy(*keys)
        .agg(F.count("*").alias("group_size"), F.max(F.struct("id", ROW_HASH, "row")).alias("stays"))
        .where("group_size > 1"),
        "groups",
    )
    return tagged.join(groups, keys, "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("stays").isNull(), F.col("id")).otherwise(F.col("stays.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("stays").isNull() | (F.col("stays.row") == F.col("row"))).alias("kept"),
        "text_sha256",
        ROW_HASH,
    )


def drop_rows(df: DataFrame, verdicts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose verdict (by id and row hash) is ``kept``; of copies of a row, as many as kept.

    Rows named in ``verdicts`` as dropped leave by an anti-join, so that only small columns are needed
    of them.
    """
    named = verdicts.groupBy(id_col, ROW_HASH).agg(F.count("*").alias("copies"), F.sum(F.col("kept").cast("int")).alias("stay"))
    odd = stage(named.where("stay < copies"), "dropped")
    marked = df.withColumn(ROW_HASH, row_hash(df))
    gone = odd.select(F.col(id_col).alias("__id"), F.col(ROW_HASH).alias("__hash"), "stay")
    same = marked[id_col].eqNullSafe(gone["__id"]) & (marked[ROW_HASH] == gone["__hash"])
    left = marked.join(gone, same, "left_anti")
    partly = gone.where("stay > 0")
    if not partly.isEmpty():
        again = marked.join(partly, same, "left_semi").dropDuplicates([id_col, ROW_HASH])
        left = left.unionByName(again)
    return left.drop(ROW_HASH)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    return drop_rows(df, exact_groups(df, id_col, text_col), id_col)

"""Importance resampling towards a target distribution of hashed n-grams.

The texts of a batch are joined, with a sentinel between them, and one regex pass finds all words. The
words' places, searched among the documents' offsets, tell each word's document; an n-gram is one whose
first and last word have the same document. Features fall into buckets by checksum, and ``bincount``
makes the corpus counts (one table of ``buckets`` rows, whatever the corpus) and, in a second pass, each
document's sum of bucket gains.

A document's score is its mean gain plus Gumbel noise drawn from its id, so that the highest scores are
a sample without replacement by importance. Ranks are exact over the whole table: rows are range
partitioned by score, no group of equal scores or ids meets in one task.

Null and empty texts have no features: weight 0, never drawn while ``min_words`` is above 0. A null id
draws its noise as the text ``null``. Repeated rows each count, and each has its own place in the order;
ties in score go to the lesser id, equal ids come in any order. An empty target or table counts 0
everywhere. Columns beside the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import as_binary, slices, texts_of
from wardline.session import stage

BUCKETS = 10_000
MIN_WORDS = 20
SEED = 2024
#: Letters, digits and all bytes of other characters; upper case is lowered before.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: No word byte.
_SENTINEL = b"\x00"
#: Words that one step holds; bytes of a batch that are joined.
BLOCK = 1 << 16
JOINED = 1 << 20


def features(texts: list[bytes], max_words: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Blocks of ``(document, bucket)`` of all features of the texts, and how many of them are single words.

    A feature is a run of up to ``max_words`` words of one document, joined by one space. The single
    words of a block come first.
    """
    joined = _SENTINEL.join(texts).lower()
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    found = _WORD.finditer(joined)
    carried: list[tuple[bytes, int]] = []
    while block := [(m[0], m.start()) for m in islice(found, BLOCK)]:
        old = len(carried)
        words, starts = zip(*carried, *block, strict=True)
        doc = np.searchsorted(offsets, np.array(starts), "right") - 1
        sums = np.fromiter(map(crc32, words), np.int64, len(words))
        docs, hashes = [doc[old:]], [sums[old:]]
        spaced = [b" " + w for w in words] if max_words > 1 else []
        for n in range(2, max_words + 1):
            # Runs of n words are runs of n - 1 words and the next one; those that lie in the carried words are counted already.
            sums = np.fromiter(map(crc32, spaced[n - 1 :], sums[: len(words) - n + 1].tolist()), np.int64)
            own = doc[: len(sums)] == doc[n - 1 :]
            own[: max(old - n + 1, 0)] = False
            docs.append(doc[: len(sums)][own])
            hashes.append(sums[own])
        yield np.concatenate(docs), np.concatenate(hashes) % buckets, len(words) - old
        carried = list(zip(words, starts, strict=True))[len(words) - max_words + 1 :] if max_words > 1 else []


def bucket_counts(df: DataFrame, text_col: str = "text", max_words: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text", JOINED):
                for _, bucket, _ in features([*texts_of(part.column("text"))], max_words, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = df.select(as_binary(text_col).alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of smoothed target to source shares, in floored thousandths."""
    buckets, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (all_source + buckets) / ((s + 1.0) * (all_target + buckets))))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise in floored thousandths, from the first 32 bits of the id's digest."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def weighted(df: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", max_words: int = 1) -> DataFrame:
    """The id, ``n_words``, ``n_features`` and ``weight``, the floored mean gain of a document's features."""
    # At most one number per bucket: the size is a parameter.
    shared = df.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text", JOINED):
                n = part.num_rows
                words, counts, sums = (np.zeros(n, np.int64) for _ in range(3))
                for doc, bucket, single in features([*texts_of(part.column("text"))], max_words, len(own)):
                    words += np.bincount(doc[:single], minlength=n)
                    counts += np.bincount(doc, minlength=n)
                    # Sums of whole numbers far below 2^53: exact in doubles.
                    sums += np.bincount(doc, weights=own[bucket], minlength=n).astype(np.int64)
                weight = np.where(counts > 0, sums // np.maximum(counts, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(words), pa.array(counts), pa.array(weight)], names=["id", "n_words", "n_features", "weight"]
                )

    rows = df.select(F.col(id_col).alias("id"), as_binary(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def resampled(
    df: DataFrame,
    target: DataFrame,
    share: tuple[int, int] = (10, 100),
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    max_words: int = 1,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Every row's id, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` among the drawn (null: not drawn).

    Drawn is the given share, rounded down, of the documents with at least ``min_words`` words.
    """
    gains = bucket_gains(bucket_counts(df, text_col, max_words, buckets), bucket_counts(target, target_col, max_words, buckets))
    scored = weighted(df, gains, id_col, text_col, max_words).withColumn("score", F.col("weight") + noise("id", seed))
    scored = stage(scored, "resample-scored")
    eligible = scored.where(F.col("n_words") >= min_words)
    drawn, least = _least_drawn(eligible, share)
    likely = F.coalesce((F.col("n_words") >= min_words) & (F.col("score") >= F.lit(least)), F.lit(False))
    ranked = _ranked(scored.where(likely)).withColumn("rank", F.when(F.col("rank") <= F.lit(drawn), F.col("rank")))
    out = ranked.unionByName(scored.where(~likely).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def _least_drawn(eligible: DataFrame, share: tuple[int, int]) -> tuple[int, int]:
    """How many are drawn, and the lowest score among them.

    Scores are whole numbers in the range of gains and noise, which bounds the table of their counts, not the corpus.
    """
    by_score = sorted(((r["score"], r["count"]) for r in eligible.groupBy("score").count().collect()), reverse=True)
    drawn = share[0] * sum(n for _, n in by_score) // share[1]
    left, least = drawn, 1 << 62
    for score, n in by_score:
        if left <= 0:
            break
        left, least = left - n, score
    return drawn, least


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank``: their place by falling score, then by id.

    Rows are range partitioned, a tie among equal ids broken by the row's place in its table, so that no
    score or id is one task's; a row's rank is its place in its partition and the rows of those before.
    """
    keys = [F.desc("score"), F.asc("id"), F.asc("__tie")]
    sorted_rows = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Range bounds are sampled anew each time a plan runs: the places are written once.
    placed = stage(sorted_rows.drop("__tie").withColumn("__place", F.monotonically_increasing_id()), "resample-ranked")
    part = F.shiftright("__place", 33)
    # One row per partition.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("__part")).count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    in_part = F.col("__place").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("__part", part).join(starts, "__part").withColumn("rank", F.col("__start") + in_part + 1).drop("__part", "__place", "__start")


__all__ = ["bucket_counts", "bucket_gains", "features", "noise", "resampled", "weighted"]

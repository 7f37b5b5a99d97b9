"""Packing token sequences by best-fit decreasing.

Piece lengths are whole numbers up to the capacity, so the pieces are known by how many there are of
each length: a table of at most ``capacity`` rows, whatever the corpus. Best-fit decreasing runs on
it: lengths descend, and a segment tree over the remaining capacities finds the tightest open bin in
logarithmic time. Bins with equal room and pieces of equal length are alike, so a step places a run of
pieces into a run of bins, as one document after another would have been. The steps are as many at
most as pairs of a length and a room. Pieces then look up their place by their length and their rank
in it.

Ranks are exact without a window over a whole length: pieces of a length are dealt over salts, as many
as the square root of the most frequent length's count, ranked within a salt and shifted by the salts
before.

A null text is an empty document: one end token. Rows alike in everything are packed each. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.bpe import Encoder, encode_many, vocabulary
from wardline.llm.common import as_binary, slices, texts_of
from wardline.session import stage

CAPACITY = 2048
#: The id that ends a document.
END = 0


def token_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` of each row's ids, cut at the capacity; with ``keep_ids`` also the ``ids``.

    The first piece takes what is left over, so that all others are full.
    """

    def cut(ids: bytes) -> Iterator[tuple]:
        n = len(ids) // 4
        first = n % capacity or capacity
        for piece, (a, b) in enumerate(zip([0, *range(first, n, capacity)], range(first, n + 1, capacity), strict=True)):
            part = ids[4 * a : 4 * b]
            yield piece, a, b - a, zlib.crc32(part), *([part] if keep_ids else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(vocabulary(path)), END.to_bytes(4, "little")
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), *((pa.binary(),) if keep_ids else ()))
        for batch in batches:
            for part in slices(batch, "text"):
                docs, rows = [], []
                for i, ids in enumerate(encode_many(encoder, [t.decode() for t in texts_of(part.column("text"))])):
                    new = list(cut(ids + end))
                    docs.extend([i] * len(new))
                    rows.extend(new)
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(docs, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                    names=["id", "piece", "start", "length", "ids_crc32", "ids"][: 1 + len(types)],
                )

    rows = df.select(F.col(id_col).cast("long").alias("id"), as_binary(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else ""))


class RoomTree:
    """A segment tree over the rooms 0 to ``capacity``: whether bins with that room are open."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.width)

    def mark(self, room: int, is_open: bool) -> None:
        at = room + self.width
        self.any[at] = is_open
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` that an open bin has."""
        at = length + self.width
        if self.any[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Steps ``(length, first rank, pieces, first bin, bins' offset)``; each bin of a step gets one piece.

    ``counts``: pieces by length. Ranks of a length start at 0.
    """
    tree, open_bins, steps, bins = RoomTree(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                # New bins. Further pieces of this length would fill the first before they open the second.
                per_bin = capacity // length
                new = -(-left // per_bin)
                full, rest = divmod(left, per_bin)
                for k in range(per_bin):
                    n = full + (k < rest)
                    if n:
                        steps.append((length, rank, n, bins, k * length))
                        rank += n
                for first, n, used in ((bins, full, per_bin), (bins + full, new - full, rest)):
                    if n and (free := capacity - used * length):
                        open_bins.setdefault(free, deque()).append((first, n))
                        tree.mark(free, True)
                bins += new
                break
            runs = open_bins[room]
            first, n = runs.popleft()
            take = min(n, left)
            if take < n:
                runs.appendleft((first + take, n - take))
            if not runs:
                tree.mark(room, False)
            steps.append((length, rank, take, first, capacity - room))
            if free := room - length:
                open_bins.setdefault(free, deque()).append((first, take))
                tree.mark(free, True)
            rank, left = rank + take, left - take
    return steps


def _ranked(pieces: DataFrame, most: int) -> DataFrame:
    """``pieces`` (with a distinct ``row``) with ``rank``, from 0 within each length."""
    salts = max(1, math.isqrt(most))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = salted.groupBy("length", "salt").count().withColumn("shift", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("length", "salt").orderBy("row")
    return salted.withColumn("rank", F.row_number().over(within) - 1).join(shifts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("salt", "shift")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length``, 1 to the capacity) with ``sequence_id`` and ``offset``."""
    fixed = stage(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    # At most one row per length.
    counts = {r["length"]: r["count"] for r in fixed.groupBy("length").count().toLocalIterator()}
    plan: dict[int, tuple[list[int], list[tuple[int, int]]]] = {}
    for length, rank, _, first, offset in best_fit_plan(counts, capacity):
        ranks, places = plan.setdefault(length, ([], []))
        ranks.append(rank)
        places.append((first, offset))
    shared = fixed.sparkSession.sparkContext.broadcast(plan)
    columns = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_pylist(), batch.column("rank").to_pylist()
            bins, offsets = [], []
            for n, r in zip(length, rank, strict=True):
                ranks, places = steps[n]
                k = bisect_right(ranks, r) - 1
                bins.append(places[k][0] + r - ranks[k])
                offsets.append(places[k][1])
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())], names=[*columns, "sequence_id", "offset"])

    ranked = _ranked(fixed, max(counts.values(), default=0))
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def packed(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Each piece of each row with its place. Without ``keep_ids`` the ids are given by their CRC-32."""
    return pack(token_pieces(df, path, id_col, text_col, capacity, keep_ids), capacity).withColumnRenamed("id", id_col)


__all__ = ["RoomTree", "best_fit_plan", "pack", "packed", "token_pieces"]

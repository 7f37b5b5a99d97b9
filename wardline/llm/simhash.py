"""SimHash near-duplicates through anchor points of a covering code.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most one bit of one of their 32-bit
halves. The anchors of a half are the words of the perfect Hamming code on 31 of its bits: every half
lies within covering radius 1 of one anchor, its home. A fingerprint is replicated to every anchor
within covering radius plus threshold (1 + 1) of each half, at most 16, and compared per anchor with
the fingerprints at home there. So each near pair meets at an anchor, at about 2**26 anchors a half.

Equal fingerprints are one node, so that copies are never paired. At an anchor, linked fingerprints
leave as stars, not as pairs. An anchor that is home to many fingerprints is dealt out over blocks of
them. Links become components by star contraction.

Null texts are empty; texts without words have fingerprint zero. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import ROW_HASH, as_binary, row_hash, texts_of
from wardline.llm.components import components
from wardline.llm.exactdedup import drop_rows
from wardline.session import stage

SEED = 42
THRESHOLD = 3
#: Fingerprints at home at one anchor that one task compares with its visitors.
HOME_BLOCK = 1024
_HASH_BLOCK = 1 << 15
_MASK31 = np.uint64((1 << 31) - 1)


def simhash(text: bytes, width: int) -> int:
    """The fingerprint of a text, unsigned; its words are folded in blocks of bounded size."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    if not ends:
        return digest(line, SEED)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(ends), _HASH_BLOCK):
        stop = ends[at : at + _HASH_BLOCK]
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at:], stop, strict=False)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(ends)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id``, the row's hash and ``bits`` (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([simhash(t, width) for t in texts_of(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column(ROW_HASH), pa.array(bits)], names=["id", ROW_HASH, "bits"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), row_hash(df).alias(ROW_HASH), as_binary(text_col).alias("text"))
    return rows.mapInArrow(run, f"id long, {ROW_HASH} long, bits long")


def _syndromes(half: np.ndarray) -> np.ndarray:
    """The exclusive or of the places (1 to 31) of the bits that are set: 0 for words of the code."""
    out = np.zeros(len(half), np.uint64)
    for place in range(1, 32):
        out ^= ((half >> np.uint64(place - 1)) & np.uint64(1)) * np.uint64(place)
    return out


#: For each syndrome but 0, the 15 pairs of places that lead to a word of the code, as bit masks.
_TWO_FLIPS = np.array([[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < (i ^ s)] for s in range(1, 32)], np.uint64)


def anchored(prints: DataFrame) -> DataFrame:
    """``anchor, home, bits``: each fingerprint at its home anchors and at all others in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column("bits").to_numpy()
            words = signed.view(np.uint64)
            for side in (0, 1):
                half = (words >> np.uint64(32 * side)) & _MASK31
                syndrome = _syndromes(half)
                flip = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1)), np.uint64(0))
                homes = half ^ flip
                off = np.flatnonzero(syndrome)
                others = half[off, None] ^ _TWO_FLIPS[syndrome[off].astype(np.int64) - 1]
                anchors = np.concatenate([homes, others.ravel()]).astype(np.int64) * 2 + side
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors), pa.array(np.arange(len(anchors)) < len(homes)), pa.array(np.concatenate([signed, np.repeat(signed[off], 15)]))],
                    names=["anchor", "home", "bits"],
                )

    return prints.mapInArrow(run, "anchor long, home boolean, bits long")


def _stars(homes: np.ndarray, visitors: np.ndarray) -> list[tuple[int, int]]:
    """A star for each group of linked fingerprints in a block of homes and a block of visitors."""
    near = np.bitwise_count(homes[:, None] ^ visitors[None, :]) <= THRESHOLD
    rows, cols = near.any(axis=1), near.any(axis=0)
    near, homes, visitors = near[rows][:, cols], homes[rows].view(np.int64), visitors[cols].view(np.int64)
    if not near.size or (len(homes) == 1 and len(visitors) == 1 and homes[0] == visitors[0]):
        return []
    top = np.iinfo(np.int64).max
    left = homes.copy()
    while True:
        right = np.where(near, left[:, None], top).min(axis=0)
        again = np.minimum(left, np.where(near, right[None, :], top).min(axis=1))
        if (again == left).all():
            break
        left = again
    labels = np.concatenate([left, right])
    nodes = np.concatenate([homes, visitors])
    return [(a, b) for a, b in set(zip(labels.tolist(), nodes.tolist(), strict=True)) if a != b]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and block, homes first; an anchor may go on over many batches."""
    homes, current = np.zeros(0, np.uint64), (None, None)
    for batch in batches:
        anchor, block, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "block", "home"))
        bits = batch.column("bits").to_numpy().view(np.uint64)
        change = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(block) != 0)) + 1
        starts = np.concatenate([[0], change]) if len(anchor) else np.zeros(0, np.int64)
        stops = np.concatenate([change, [len(anchor)]]) if len(anchor) else starts
        count = np.add.reduceat(home, starts, dtype=np.int64) if len(anchor) else starts
        last = len(starts) - 1
        edges: list[tuple[int, int]] = []
        for k in np.flatnonzero(((stops - starts > 1) & (count > 0)) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == last)).tolist():
            a, b, n = int(starts[k]), int(stops[k]), int(count[k])
            key = (anchor[a], block[a])
            own = bits[a : a + n]
            homes = np.concatenate([homes, own]) if key == current else own
            current = key
            for x in range(0, len(homes), HOME_BLOCK):
                for y in range(a, b, 4096):
                    edges.extend(_stars(homes[x : x + HOME_BLOCK], bits[y : min(b, y + 4096)]))
        a, b = zip(*set(edges), strict=True) if edges else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect all fingerprints (distinct ``bits``) within 3 bits of each other.

    The homes of an anchor that has many are dealt out over blocks, and its visitors go to each block.
    """
    placed = anchored(prints)
    crowded = stage(
        placed.where("home").groupBy("anchor").count().where(F.col("count") > HOME_BLOCK).select("anchor", F.ceil(F.col("count") / HOME_BLOCK).cast("int").alias("blocks")),
        "crowded-anchors",
    )
    if crowded.isEmpty():
        dealt = placed.withColumn("block", F.lit(0))
    else:
        own = F.pmod(F.xxhash64("bits"), F.col("blocks")).cast("int")
        n = F.coalesce("blocks", F.lit(1))
        dealt = (
            placed.join(crowded, "anchor", "left")
            .withColumn("blocks", n)
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("home", F.col("home") & (own == F.col("block")))
            .drop("blocks")
        )
    return dealt.repartition("anchor", "block").sortWithinPartitions("anchor", "block", F.desc("home")).mapInArrow(_compare, "a long, b long").distinct()


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per row of ``df``: its id, row hash, fingerprint in hex and ``component_id``.

    The component is the least id that links of at most 3 differing bits reach, its own included.
    """
    prints = stage(fingerprints(df, id_col, text_col, width), "simhash")
    distinct = stage(prints.groupBy("bits").agg(F.min("id").alias("least")), "simhash-distinct")
    labels = stage(components(links(distinct.select("bits"))), "simhash-labels")
    of_bits = distinct.join(labels.withColumnRenamed("node", "bits"), "bits", "left").withColumn("label", F.coalesce("label", "bits"))
    least = of_bits.groupBy("label").agg(F.min("least").alias("component_id"))
    joined = stage(of_bits.join(least, "label").select("bits", "component_id"), "simhash-components")
    return prints.join(joined, "bits").select(F.col("id").alias(id_col), ROW_HASH, F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``df`` with one row, that of the least id, of each component.

    Rows without an id take no part in the choice where the component has one with an id; of several
    rows with the least id, the one with the least row hash stays.
    """
    grouped = stage(near_groups(df, id_col, text_col, width), "simhash-groups")
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(ROW_HASH).alias("hash")))
    # The component of rows whose ids are all null is named by no id; the fingerprint stands in.
    key = F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint"))
    keyed = grouped.withColumn("key", key)
    stays = stage(keyed.groupBy("key").agg(first.alias("stays")), "simhash-stays")
    verdicts = keyed.join(stays, "key").withColumn("kept", F.col("stays.id").eqNullSafe(F.col(id_col)) & (F.col("stays.hash") == F.col(ROW_HASH)))
    # Copies of the row that stays are told apart when it is read: one is kept.
    once = verdicts.groupBy(id_col, ROW_HASH).agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    split = once.select(id_col, ROW_HASH, "kept").unionByName(once.where("kept AND n > 1").select(id_col, ROW_HASH, F.lit(False).alias("kept")))
    return drop_rows(df, split, id_col)

"""Quality by nearest neighbours among labelled documents.

A bounded sample of labelled documents fits a latent-semantic space: hashed words, character-shape
trigrams and steps of repetition, weighted by inverse document frequency, reduced by a truncated singular value decomposition.
The labelled vectors and the projection (at most ``MAX_LABELLED`` x ``RANK`` and ``TERMS`` x ``RANK``
numbers) are broadcast. Every document's cosine to every labelled vector is computed exactly, in
blocks, and the labels of its nearest neighbours vote, weighted by similarity.

Null and empty texts have no words: their score is 0. Labels without a document, or null, are not
used; repeated ones count once each. Without labelled documents of either kind all scores are 0.
Columns named like a result are replaced by it; all others come back as they are, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import as_binary, fresh, slices, texts_of, without

#: Bound on the labelled documents that the space and the votes come from, the least hashes of their ids.
MAX_LABELLED = 3000
WORD_TERMS = 2048
#: Character classes: lower, upper, digit, blank, newline, stop, comma, bar, other marks (4 kinds), non-ASCII.
_CLASSES = 13
SHAPE_TERMS = _CLASSES**3
#: Eleven steps each of the share of words that repeat the one before, of distinct words, of distinct lines.
REPEAT_TERMS = 33
TERMS = WORD_TERMS + SHAPE_TERMS + REPEAT_TERMS
RANK = 48
NEIGHBOURS = 15
THRESHOLD = 0.7
_BLOCK = 512


def _class_table() -> np.ndarray:
    out = np.full(256, 11, np.uint8)
    for kind, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"|", b"!?", b"*#", b"$%&")):
        out[list(chars)] = kind
    out[128:] = 12
    return out


_TABLE = _class_table()


def term_counts(text: bytes) -> np.ndarray:
    """Counts of hashed words and of character-shape trigrams over the whole text, dampened."""
    counts = np.zeros(TERMS, np.float32)
    words = text.lower().split()
    if not words:
        return counts
    crc = zlib.crc32
    counts[:WORD_TERMS] = np.bincount(np.array([crc(w) for w in words], np.uint32) % WORD_TERMS, minlength=WORD_TERMS)
    kinds = _TABLE[np.frombuffer(text, np.uint8)].astype(np.int32)
    if len(kinds) >= 3:
        counts[WORD_TERMS : WORD_TERMS + SHAPE_TERMS] = np.bincount((kinds[:-2] * _CLASSES + kinds[1:-1]) * _CLASSES + kinds[2:], minlength=SHAPE_TERMS)
    lines = text.split(b"\n")
    again = sum(map(bytes.__eq__, words, words[1:])) / len(words)
    for k, share in enumerate((again, len(set(words)) / len(words), len(set(lines)) / len(lines))):
        counts[WORD_TERMS + SHAPE_TERMS + 11 * k + int(10 * share)] = 1
    # The three kinds of terms weigh alike, whatever the length.
    for part in np.split(counts, (WORD_TERMS, WORD_TERMS + SHAPE_TERMS)):
        np.sqrt(part, out=part)
        norm = np.linalg.norm(part)
        if norm:
            part /= norm
    return counts


@dataclass(frozen=True)
class Model:
    """Weights and projection of the terms; unit vectors and labels of the labelled documents."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, counts: np.ndarray) -> np.ndarray:
        out = counts @ self.projection
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The share of label 1 in the similarity of the nearest neighbours."""
        if not len(self.labels):
            return np.zeros(len(counts))
        out = np.zeros(len(counts))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(counts), _BLOCK):
            near = self.embed(counts[at : at + _BLOCK]) @ self.vectors.T
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** 8
            total = weight.sum(axis=1)
            out[at : at + _BLOCK] = np.where(total > 0, (weight * self.labels[best]).sum(axis=1) / np.where(total > 0, total, 1), 0)
        return out


def fit(counts: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Latent-semantic space of the labelled documents by randomised subspace iteration."""
    if not len(labels):
        return Model(np.zeros((TERMS, RANK), np.float32), np.zeros((0, RANK), np.float32), labels)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    weighted = counts * idf
    rng = np.random.default_rng(seed)
    basis = weighted @ rng.standard_normal((TERMS, RANK + 8), dtype=np.float32)
    for _ in range(3):
        basis, _ = np.linalg.qr(weighted @ (weighted.T @ basis))
    _, _, right = np.linalg.svd(basis.T @ weighted, full_matrices=False)
    projection = np.zeros((TERMS, RANK), np.float32)
    projection[:, : min(RANK, len(right))] = (idf[:, None] * right[:RANK].T).astype(np.float32)
    model = Model(projection, np.zeros((0, RANK), np.float32), labels)
    return Model(projection, model.embed(counts).astype(np.float32), labels.astype(np.float64))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_from(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model from at most ``MAX_LABELLED`` labelled rows outside the held-out quarter."""
    # The sample is chosen by id alone, and only its texts are read out.
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("__id"), "__id", "label")
        .limit(MAX_LABELLED)
    )
    rows = df.select(F.col(id_col).alias("__id"), as_binary(text_col).alias("text")).join(F.broadcast(chosen), "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", 1 << 20)):
            counts = [term_counts(t).astype(np.float16).tobytes() for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("label"), pa.array(counts, pa.binary())], names=["__id", "label", "counts"])

    id_type = dict(rows.dtypes)["__id"]
    # A document table with repeated ids could be larger than the labels: the bound holds here too.
    got = rows.select("__id", "label", "text").mapInArrow(run, f"__id {id_type}, label int, counts binary").orderBy(F.xxhash64("__id"), "__id", "counts").limit(MAX_LABELLED).toArrow()
    data = np.frombuffer(b"".join(x.as_py() for x in got.column("counts")), np.float16).reshape(-1, TERMS).astype(np.float32)
    return fit(data, got.column("label").to_numpy())


def scored(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``df`` with the score (0 to 1) and the prediction; columns of these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = without(df, score_col, predicted_col)
    read = fresh(df, "__text")
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = []
            block: list[np.ndarray] = []
            for text in texts_of(batch.columns[-1]):
                block.append(term_counts(text))
                if len(block) == _BLOCK:
                    scores.append(own.scores(np.stack(block)))
                    block = []
            if block:
                scores.append(own.scores(np.stack(block)))
            new = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], new], names=schema.names)

    rows = df.select(*[F.col(f"`{c}`") for c in kept], as_binary(text_col).alias(read))
    return rows.mapInArrow(run, schema).withColumn(predicted_col, F.when(F.col(f"`{score_col}`") >= THRESHOLD, 1).otherwise(0))

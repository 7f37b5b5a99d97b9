"""Approximate nearest neighbours: trained cells, product-quantised residuals, exact comparison of the best.

The index is a table of blocks, stored by cell. A block has at most ``BLOCK`` vectors of one cell, their
codes (one byte per group of dimensions: the residual from the cell's centre in a trained codebook)
and the vectors themselves. A search sends each query to its nearest cells, scores all codes there by
table lookup, and compares exactly only the best share of each block.

Cells, codebooks, and how many cells and which share a search takes, are fitted on a sample of at most
``SAMPLE`` vectors, those of the least id hashes. All vectors are indexed, whatever was fitted on.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.retrieval import TOP_K, best_rows, rank_found

#: Bound on the vectors that cells, codebooks and search settings are fitted on.
SAMPLE = 20_000
BLOCK = 4_096
#: Dimensions that share a codebook; its words, and sample vectors per word and per cell at least.
GROUP, WORDS, PER_WORD, PER_CELL = 4, 256, 8, 40
#: Shares of a sample query's true neighbours that its cells, and the compared part of a block, must hold.
IN_CELLS, IN_SHARE = 0.98, 0.99
ROUNDS = 12


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and which of the given rows have a direction."""
    length = np.linalg.norm(rows, axis=1)
    some = np.isfinite(length) & (length > 0)
    return (rows[some] / length[some, None]).astype(np.float32), some


def _centres(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """The centres of ``k`` clusters by Lloyd's rounds; an empty cluster takes a row far from its centre."""
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(ROUNDS):
        gap = (centres**2).sum(axis=1) - 2 * rows @ centres.T
        of = gap.argmin(axis=1)
        counts = np.bincount(of, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, rows)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres).astype(np.float32)
        if (empty := np.flatnonzero(counts == 0)).size:
            far = np.argsort(-(gap.min(axis=1) + (rows**2).sum(axis=1)), kind="stable")[: len(empty)]
            centres[empty] = rows[far]
    return centres


@dataclass(frozen=True)
class Cells:
    """A fitted index: centres, a codebook per group of dimensions, and the settings of a search."""

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int
    share: float

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def groups(self, rows: np.ndarray) -> list[np.ndarray]:
        return np.array_split(rows, len(self.books), axis=1)

    def cells_of(self, rows: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(axis=1) - 2 * rows @ self.centres.T).argmin(axis=1)

    def probed(self, rows: np.ndarray) -> np.ndarray:
        """The nearest cells of each query, as many as a search takes."""
        gap = (self.centres**2).sum(axis=1) - 2 * rows @ self.centres.T
        return np.argsort(gap, axis=1, kind="stable")[:, : self.probes]

    def codes(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        out = []
        for part, book in zip(self.groups(rows - self.centres[cells]), self.books, strict=True):
            out.append(((book**2).sum(axis=1) - 2 * part @ book.T).argmin(axis=1).astype(np.uint8))
        return np.stack(out, axis=1)

    def scores(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Similarities estimated from codes: one table of products per query and group."""
        total = np.repeat((queries @ self.centres[cell])[:, None], len(codes), axis=1)
        for part, book, column in zip(self.groups(queries), self.books, codes.T, strict=True):
            total += (part @ book.T)[:, column]
        return total

    def to_bytes(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, centres=self.centres, settings=np.array([self.probes, self.share]), **{f"book{i}": b for i, b in enumerate(self.books)})
        return file.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Cells:
        with np.load(io.BytesIO(data)) as got:
            books = [got[f"book{i}"] for i in range(len(got.files) - 2)]
            probes, share = got["settings"]
            return Cells(got["centres"], books, int(probes), float(share))


def fit_rows(rows: np.ndarray, total: int, k: int = TOP_K, seed: int = 42) -> Cells:
    """Cells for a corpus of ``total`` vectors, from a sample of unit ``rows``."""
    rng = np.random.default_rng(seed)
    n, dim = rows.shape
    cells = int(np.clip(round(total**0.5 / 2), 1, max(1, n // PER_CELL)))
    centres = _centres(rows, cells, rng)
    of = ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
    words = int(np.clip(n // PER_WORD, 1, WORDS))
    books = [_centres(np.ascontiguousarray(part), words, rng) for part in np.array_split(rows - centres[of], -(-dim // GROUP), axis=1)]
    draft = Cells(centres, books, cells, 1.0)
    # Sample vectors as queries, against the others: in which of its cells a true neighbour is.
    asked = rows[rng.choice(n, min(n, 400), replace=False)]
    near = asked @ rows.T
    true = np.argpartition(-near, min(k, n - 1), axis=1)[:, : min(k + 1, n)]
    order = np.argsort(draft.probed(asked), axis=1)
    rank = np.take_along_axis(order, of[true], axis=1)
    codes = draft.codes(rows, of)
    estimate = asked @ centres[of].T
    for part, book, column in zip(draft.groups(asked), books, codes.T, strict=True):
        estimate += (part @ book.T)[:, column]
    # How far down its cell's estimates a true neighbour is, as a share of the cell.
    sizes = np.bincount(of, minlength=cells)
    better = [((e[None, :] > e[t][:, None]) & (of[None, :] == of[t][:, None])).sum(axis=1) for e, t in zip(estimate, true, strict=True)]
    depth = (np.stack(better) + 1) / sizes[of[true]]
    return Cells(centres, books, int(np.quantile(rank, IN_CELLS)) + 1, float(min(1.0, 2 * np.quantile(depth, IN_SHARE))))


def fit_cells(corpus: DataFrame, k: int = TOP_K, seed: int = 42) -> Cells:
    """Cells of a corpus ``item_id, vector``, for searches of about ``k`` neighbours.

    Null and zero vectors have no direction. Vectors of the most frequent length in the sample set the dimension.
    """
    some = corpus.where("vector IS NOT NULL AND size(vector) > 0")
    sample = some.orderBy(F.xxhash64("item_id"), "item_id").limit(SAMPLE).select("vector").toPandas()["vector"]
    if not len(sample):
        return Cells(np.zeros((1, 1), np.float32), [np.zeros((1, 1), np.float32)], 1, 1.0)
    dim = pd.Series([len(v) for v in sample]).mode()[0]
    rows, _ = _unit(np.stack([np.asarray(v, np.float64) for v in sample if len(v) == dim]))
    if not len(rows):
        return Cells(np.zeros((1, dim), np.float32), [np.zeros((1, min(dim, GROUP)), np.float32)] * -(-dim // GROUP), 1, 1.0)
    return fit_rows(rows, some.count(), k, seed)


def _matrix(vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the vectors that have a direction and the dimension, and their places."""
    right = np.flatnonzero([v is not None and len(v) == dim for v in vectors])
    if not len(right):
        return np.zeros((0, dim), np.float32), right
    rows, some = _unit(np.stack([np.asarray(vectors.iloc[i], np.float64) for i in right]))
    return rows, right[some]


def index_blocks(cells: Cells, corpus: DataFrame) -> DataFrame:
    """``cell, item_ids, codes, vectors``: the corpus in blocks. Each vector of the cells' dimension is in one."""
    shared = corpus.sparkSession.sparkContext.broadcast(cells)
    item = corpus.schema["item_id"].dataType.simpleString()

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            rows, at = _matrix(batch["vector"], own.dim)
            of = own.cells_of(rows) if len(rows) else np.zeros(0, int)
            codes = own.codes(rows, of) if len(rows) else np.zeros((0, len(own.books)), np.uint8)
            yield pd.DataFrame({"cell": of.astype("int32"), "item_id": batch["item_id"].iloc[at].to_numpy(), "code": [c.tobytes() for c in codes], "unit": [r.tobytes() for r in rows]})

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows arrive sorted by cell; a block ends with its cell or when it is full.
        held: dict[int, pd.DataFrame] = {}

        def block(cell: int, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"cell": [cell], "item_ids": [rows["item_id"].to_numpy()], "codes": [b"".join(rows["code"])], "vectors": [b"".join(rows["unit"])]})

        for batch in batches:
            for cell, rows in batch.groupby("cell", sort=True):
                for other in [c for c in held if c != cell]:
                    yield block(other, held.pop(other))
                rows = pd.concat([held.pop(cell), rows]) if cell in held else rows
                while len(rows) >= BLOCK:
                    yield block(cell, rows.iloc[:BLOCK])
                    rows = rows.iloc[BLOCK:]
                if len(rows):
                    held[cell] = rows
        for cell, rows in held.items():
            yield block(cell, rows)

    rows = corpus.select("item_id", "vector").mapInPandas(placed, f"cell int, item_id {item}, code binary, unit binary")
    # By range of cell and id, so that a crowded cell spreads over tasks.
    dealt = rows.repartitionByRange("cell", F.xxhash64("item_id")).sortWithinPartitions("cell")
    return dealt.mapInPandas(blocks, f"cell int, item_ids array<{item}>, codes binary, vectors binary")


def write_index(cells: Cells, corpus: DataFrame, path: str) -> None:
    """Store the blocks of a corpus, a folder per cell, and the cells beside them."""
    index_blocks(cells, corpus).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/blocks")
    corpus.sparkSession.createDataFrame([(bytearray(cells.to_bytes()),)], "cells binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def read_index(spark: SparkSession, path: str, item_type: str = "bigint") -> tuple[Cells, DataFrame]:
    """The cells and the blocks that ``write_index`` has stored."""
    cells = Cells.from_bytes(bytes(spark.read.schema("cells binary").parquet(f"{path}/cells").first()[0]))
    return cells, spark.read.schema(f"item_ids array<{item_type}>, codes binary, vectors binary, cell int").parquet(f"{path}/blocks")


def asked_cells(cells: Cells, queries: DataFrame) -> DataFrame:
    """``cell, query_ids, matrix``: queries in blocks, each at every cell that it probes."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            rows, at = _matrix(batch["vector"], own.dim)
            if not len(rows):
                continue
            ids, probed = batch["query_id"].iloc[at].to_numpy(), own.probed(rows)
            out = []
            for cell in np.unique(probed):
                mine = np.flatnonzero((probed == cell).any(axis=1))
                out += [(cell, ids[part], rows[part].tobytes()) for part in np.array_split(mine, -(-len(mine) // 256))]
            yield pd.DataFrame(out, columns=["cell", "query_ids", "matrix"]).astype({"cell": "int32"})

    query = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "vector").mapInPandas(run, f"cell int, query_ids array<{query}>, matrix binary")


def search_blocks(cells: Cells, blocks: DataFrame, queries: DataFrame, k: int = TOP_K, digits: int = 6) -> DataFrame:
    """``query_id, item_id, similarity, compared``: each block's best for each query that probes its cell.

    ``compared`` is how many of the block's vectors were compared exactly.
    """
    # The filter, which all blocks pass, lets Spark prune the folders by the cells of a broadcast.
    asked = asked_cells(cells, queries).where(F.size("query_ids") > 0)
    pairs = blocks.join(asked, "cell")
    shared = queries.sparkSession.sparkContext.broadcast(cells)
    item = blocks.schema["item_ids"].dataType.elementType.simpleString()
    query = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            for cell, ids, codes, vectors, asked_ids, matrix in zip(*(batch[c] for c in ("cell", "item_ids", "codes", "vectors", "query_ids", "matrix")), strict=True):
                ids, left = np.asarray(ids), np.frombuffer(matrix, np.float32).reshape(-1, own.dim)
                right = np.frombuffer(vectors, np.float32).reshape(-1, own.dim)
                n = min(len(ids), max(k, int(np.ceil(own.share * len(ids)))))
                estimate = own.scores(left, cell, np.frombuffer(codes, np.uint8).reshape(len(ids), -1))
                best = np.argpartition(-estimate, n - 1, axis=1)[:, :n]
                exact = np.einsum("qd,qnd->qn", left.astype(np.float64), right[best].astype(np.float64))
                found = best_rows(np.asarray(asked_ids), ids[best], exact, k, digits)
                found["compared"] = n
                yield found

    return pairs.mapInPandas(run, f"query_id {query}, item_id {item}, similarity double, compared int")


def ann_topk(cells: Cells, blocks: DataFrame, queries: DataFrame, k: int = TOP_K, digits: int = 6) -> DataFrame:
    """Approximate ``k`` nearest of every query, ranked; ties go to the lower id.

    Queries and blocks meet by cell: by broadcast where Spark finds the queries small, else by a shuffle whose
    crowded cells adaptive execution splits. Similarities are exact, from unit vectors in single precision.
    """
    return rank_found(search_blocks(cells, blocks, queries, k, digits).drop("compared"), k)

"""Nearest passages by cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.text import stripped

TOP_K = 2
# Vectors in one block of queries and in one block of the corpus: what one product holds in memory.
QUERY_BLOCK, CORPUS_BLOCK = 256, 4_096
# Keys over which blocks of the corpus are dealt out where they are shuffled; adaptive execution splits
# what is still large. Each block of queries goes to all of them.
SLOTS = 16

# The format of an answer.
NOTHING_FOUND = "No relevant regulatory guidance found in the index."
PASSAGE_BREAK = "\n\n---\n\n"


def _blocks(vectors: DataFrame, key: str, size: int, slot: str) -> DataFrame:
    """``slot``, the ids ``<key>s`` and the ``matrix`` (unit rows) of blocks of at most ``size`` vectors.

    Blocks are cut where the vectors lie, without a shuffle. Null and zero vectors have no direction
    and are left out. ``slot`` is a column expression over the block's ``number``.
    """
    schema = f"number int, {key}s array<{vectors.schema[key].dataType.simpleString()}>, dim int, matrix binary"

    def packed(ids: list, rows: list[np.ndarray], number: int) -> Iterator[pd.DataFrame]:
        # Vectors of different lengths never meet.
        lengths = np.array([len(r) for r in rows])
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            matrix = np.stack([rows[i] for i in at])
            length = np.linalg.norm(matrix, axis=1)
            at, matrix = at[length > 0], matrix[length > 0] / length[length > 0][:, None]
            if len(at):
                yield pd.DataFrame({"number": [number], f"{key}s": [[ids[i] for i in at]], "dim": [dim], "matrix": [matrix.tobytes()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows, number = [], [], 0
        for batch in batches:
            for i, v in zip(batch[key].tolist(), batch["vector"], strict=True):
                ids.append(i)
                rows.append(np.asarray(v, np.float64))
                if len(ids) == size:
                    yield from packed(ids, rows, number)
                    ids, rows, number = [], [], number + 1
        if ids:
            yield from packed(ids, rows, number)

    some = vectors.filter("vector IS NOT NULL").select(key, "vector")
    return some.mapInPandas(run, schema).withColumn("slot", F.expr(slot)).drop("number")


def best_rows(queries: np.ndarray, items: np.ndarray, near: np.ndarray, k: int, digits: int) -> pd.DataFrame:
    """Of each query's ``items`` and their similarities exactly the ``k`` nearest; of equal ones the lower ids."""
    scale = 10.0**digits
    # Columns stand in the order of their ids, so that of equal similarities the first one wins.
    order = np.argsort(items, axis=1, kind="stable")
    items, near = np.take_along_axis(items, order, axis=1), np.take_along_axis(near, order, axis=1) * scale
    rounded = (np.sign(near) * np.floor(np.abs(near) + 0.5)).astype(np.int64)
    keys = rounded * items.shape[1] - np.arange(items.shape[1])
    n = min(k, items.shape[1])
    best = np.argpartition(-keys, n - 1, axis=1)[:, :n]
    return pd.DataFrame(
        {
            "query_id": np.repeat(queries, n),
            "item_id": np.take_along_axis(items, best, axis=1).ravel(),
            "similarity": np.take_along_axis(rounded, best, axis=1).ravel() / scale,
        }
    )


def _best_of_blocks(k: int, digits: int):
    """A function that keeps exactly the ``k`` nearest of a block for each query, in the final order."""
    scale = 10.0**digits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for queries, items, dim, q, c in zip(batch["query_ids"], batch["item_ids"], batch["dim"], batch["q"], batch["c"], strict=True):
                left, right = (np.frombuffer(m, np.float64).reshape(-1, dim) for m in (q, c))
                items = np.asarray(items)
                # Columns stand in the order of their ids, so that of equal similarities the first one wins.
                order = np.argsort(items, kind="stable")
                near = (left @ right.T)[:, order] * scale
                rounded = (np.sign(near) * np.floor(np.abs(near) + 0.5)).astype(np.int64)
                keys = rounded * len(items) - np.arange(len(items))
                n = min(k, len(items))
                best = np.argpartition(-keys, n - 1, axis=1)[:, :n]
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat(np.asarray(queries), n),
                        "item_id": items[order[best]].ravel(),
                        "similarity": np.take_along_axis(rounded, best, axis=1).ravel() / scale,
                    }
                )

    return run


def rank_found(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, digits: int = 6) -> DataFrame:
    """The exact ``k`` nearest corpus vectors of every query, ranked; ties go to the lower id.

    ``queries`` has ``query_id, vector``, ``corpus`` has ``item_id, vector``; null and zero
    vectors have no direction and take no part. Both are cut into blocks; every block of queries
    goes to every slot of corpus blocks, by broadcast where Spark finds the queries small, so that the
    corpus stays where it is, else by a shuffle on the slot. A pair of blocks leaves at most ``k`` rows
    per query, and ranking cuts them again before it shuffles. Similarities are rounded before they
    are ranked, as sums of products differ in the last bits between engines.
    """
    item_type = corpus.schema["item_id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    left = _blocks(queries, "query_id", QUERY_BLOCK, f"explode(sequence(0, {SLOTS - 1}))").withColumnRenamed("matrix", "q")
    right = _blocks(corpus, "item_id", CORPUS_BLOCK, f"pmod(xxhash64(item_ids), {SLOTS})").withColumnRenamed("matrix", "c")
    pairs = right.join(left, ["slot", "dim"]).select("query_ids", "item_ids", "dim", "q", "c")
    return rank_found(pairs.mapInPandas(_best_of_blocks(k, digits), f"query_id {query_type}, item_id {item_type}, similarity double"), k)


def mean_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """The mean vector per key, dimension by dimension; combines before the shuffle."""
    long = vectors.select(key, F.posexplode(vector).alias("dim", "x"))
    means = long.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"])
    return means.groupBy(key).agg(in_order.alias("vector"))


def fit_tfidf(corpus: DataFrame, text: str = "text", features: int = 1024):
    """A lexical embedding fitted on the corpus: hashed term counts, inverse document frequency, unit length."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    stages = [
        RegexTokenizer(inputCol=text, outputCol="__tokens", pattern=r"[\p{L}\p{Nd}]+", gaps=False),
        HashingTF(inputCol="__tokens", outputCol="__counts", numFeatures=features),
        IDF(inputCol="__counts", outputCol="__weights"),
        Normalizer(inputCol="__weights", outputCol="__unit"),
    ]
    return Pipeline(stages=stages).fit(corpus.select(text))


def embed(model, texts: DataFrame, as_array: bool = True) -> DataFrame:
    """Texts with their ``vector`` under a fitted embedding."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(texts)
    vector = vector_to_array("__unit", dtype="float32") if as_array else F.col("__unit")
    return out.withColumn("vector", vector).drop("__tokens", "__counts", "__weights", "__unit")


def passages(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """The text of the passages found, by ``item_id = doc_id``."""
    return found.join(corpus.withColumnRenamed("doc_id", "item_id"), "item_id")


def format_passages(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """One answer per query: labelled passages in rank order, or a fixed sentence if there are none.

    ``ranked`` has ``query_id, rank, doc_id`` (text) and ``text``, at most ``k`` rows per query.
    """
    label = F.upper(F.replace("doc_id", F.lit("_"), F.lit(" ")))
    part = F.concat(F.lit("**["), label, F.lit("]**\n"), stripped(F.col("text")))
    answers = (
        ranked.select("query_id", F.struct("rank", part.alias("part")).alias("p"))
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list("p")).alias("parts"))
        .select("query_id", F.array_join(F.transform("parts", lambda p: p["part"]), PASSAGE_BREAK).alias("answer"))
    )
    return queries.select("query_id").join(answers, "query_id", "left").withColumn(
        "answer", F.coalesce("answer", F.lit(NOTHING_FOUND))
    )

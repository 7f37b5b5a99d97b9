"""Nearest passages against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from comparing import SF
from wardline.catalog import queries, views
from wardline.operators import ann as A
from wardline.operators import retrieval as R
from wardline.session import work_folder


def brute(questions, items, k):
    out = {}
    for qid, q in questions:
        scored = []
        for iid, v in items:
            norm = np.linalg.norm(q) * np.linalg.norm(v)
            if norm > 0:
                scored.append((-round(float(np.dot(q, v) / norm), 6), iid))
        out[qid] = [iid for _, iid in sorted(scored)[:k]]
    return out


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(300)]
    # Copies and scaled copies tie exactly; some vectors have no direction.
    rows += [(1000 + i, [x * 2 for x in rows[i][1]]) for i in range(20)] + [(2000, [0.0] * 8)]
    return rows


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["item_id"])
    return out


@pytest.mark.parametrize("partitions", [1, 4, 17])
@pytest.mark.parametrize("k", [1, 5, 500])
def test_exact(spark, items, partitions, k):
    corpus = spark.createDataFrame([*items, (3000, None)], "item_id long, vector array<double>").repartition(partitions)
    questions = [(i, items[i][1]) for i in range(0, 40, 3)]
    got = ranked(R.cosine_topk(spark.createDataFrame([*questions, (99, None)], "query_id long, vector array<double>"), corpus, k))
    assert got == brute(questions, items, k)


def test_many_questions_meet_the_corpus_in_blocks(spark, items, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 4)
    monkeypatch.setattr(R, "CORPUS_BLOCK", 50)
    corpus = spark.createDataFrame(items, "item_id long, vector array<double>")
    questions = items[:45]
    asked = spark.createDataFrame(questions, "query_id long, vector array<double>")
    assert ranked(R.cosine_topk(asked, corpus, 3)) == brute(questions, items, 3)
    # Also where neither side is broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert ranked(R.cosine_topk(asked, corpus, 3)) == brute(questions, items, 3)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ties_leave_each_block_cut_to_k(spark):
    same = [(i, [1.0, 2.0]) for i in range(5_000)]
    corpus = spark.createDataFrame(same, "item_id long, vector array<double>").repartition(3)
    question = spark.createDataFrame([(1, [2.0, 4.0])], "query_id long, vector array<double>")
    assert ranked(R.cosine_topk(question, corpus, 2)) == {1: [0, 1]}
    found = [b for part in R._best_of_blocks(2, 6)(iter([_pair(question, same)])) for b in part["item_id"]]
    assert sorted(found) == [0, 1]


def _pair(question, items):
    import pandas as pd

    unit = lambda rows: (m := np.array(rows)) / np.linalg.norm(m, axis=1, keepdims=True)
    return pd.DataFrame(
        {
            "query_ids": [[1]],
            "item_ids": [[i for i, _ in items]],
            "dim": [2],
            "q": [unit([[2.0, 4.0]]).tobytes()],
            "c": [unit([v for _, v in items]).tobytes()],
        }
    )


def test_no_questions(spark, items):
    corpus = spark.createDataFrame(items, "item_id long, vector array<double>")
    assert R.cosine_topk(spark.createDataFrame([], "query_id long, vector array<double>"), corpus).count() == 0


def _asked(spark, sf, name):
    rows = queries.vectors(spark, sf).where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    return {"labels": queries.label_queries(spark, sf), "rows": rows}[name]


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
@pytest.mark.parametrize("name", ["labels", "rows"])
def test_cells_find_most_neighbours_and_compare_few(spark, sf, name):
    cells, blocks = queries.stored_index(spark, sf)
    questions, n = _asked(spark, sf, name), queries.vectors(spark, sf).count()
    exact = R.cosine_topk(questions, queries.vectors(spark, sf), 10)
    near = A.ann_topk(cells, blocks, questions, 10)
    both = near.alias("n").join(exact.alias("e"), ["query_id", "item_id"])
    assert both.count() >= 0.9 * exact.count()
    assert both.where("abs(n.similarity - e.similarity) > 2e-6").isEmpty()
    # Of a block, what was compared is told in each of its rows.
    per_block = A.asked_cells(cells, questions).select("cell", F.explode("query_ids").alias("query_id")).join(blocks, "cell")
    share = F.greatest(F.lit(10), F.ceil(F.lit(cells.share) * F.size("item_ids")))
    most = per_block.groupBy("query_id").agg(F.sum(F.least(share, F.size("item_ids"))).alias("c")).agg(F.max("c")).first()[0]
    assert most <= 0.2 * n or n < 1000


def test_every_vector_is_indexed_once_in_its_cell(spark, items):
    odd = [(3000, None), (3001, [1.0, 2.0]), (3002, [float("nan")] * 8), (3003, [])]
    corpus = spark.createDataFrame([*items, *odd, items[5]], "item_id long, vector array<double>")
    cells = A.fit_cells(corpus, 3)
    blocks = A.index_blocks(cells, corpus).collect()
    directed = [i for i, v in [*items, items[5]] if np.linalg.norm(v) > 0]
    assert sorted(i for b in blocks for i in b["item_ids"]) == sorted(directed)
    for b in blocks:
        rows = np.frombuffer(b["vectors"], np.float32).reshape(-1, 8)
        assert len(rows) == len(b["item_ids"]) and set(cells.cells_of(rows)) == {b["cell"]}
        assert len(b["codes"]) == len(cells.books) * len(rows)


def test_all_cells_and_all_compared_is_exact(spark, items):
    corpus = spark.createDataFrame([*items, (3000, None)], "item_id long, vector array<double>")
    fitted = A.fit_cells(corpus, 3)
    cells = A.Cells(fitted.centres, fitted.books, len(fitted.centres), 1.0)
    questions = [(i, items[i][1]) for i in range(0, 45, 4)]
    asked = spark.createDataFrame([*questions, (98, None), (99, [0.0] * 8), (97, [1.0])], "query_id long, vector array<double>")
    assert ranked(A.ann_topk(cells, A.index_blocks(cells, corpus), asked, 3)) == brute(questions, items, 3)


def test_clustered_vectors_need_few_cells(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(40, 16))
    rows = [(i, (middles[i % 40] + 0.1 * rng.normal(size=16)).tolist()) for i in range(4000)]
    corpus = spark.createDataFrame(rows, "item_id long, vector array<double>")
    cells = A.fit_cells(corpus, 5)
    assert cells.probes <= 4 < len(cells.centres)
    path = work_folder(spark, "test-cells")
    A.write_index(cells, corpus, path)
    again, blocks = A.read_index(spark, path)
    assert again.to_bytes() == cells.to_bytes()
    asked = spark.createDataFrame([(i, v) for i, v in rows[::100]], "query_id long, vector array<double>")
    near, exact = A.ann_topk(again, blocks, asked, 5), R.cosine_topk(asked, corpus, 5)
    assert near.join(exact, ["query_id", "item_id"]).count() >= 0.9 * exact.count()
    # One query reads the folders of its cells alone.
    one = A.ann_topk(again, blocks, asked.limit(1), 5)
    one.collect()
    assert "dynamicpruning" in one._jdf.queryExecution().executedPlan().toString()


def test_cells_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, vector array<double>")
    cells = A.fit_cells(none)
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")
    assert A.ann_topk(cells, A.index_blocks(cells, none), asked).count() == 0


def test_embedding_has_unit_length_and_finds_its_own_text(spark):
    docs = views.table(spark, SF, "documents").select("doc_id", "text").dropDuplicates(["text"])
    model = R.fit_tfidf(docs)
    items = R.embed(model, docs).select(F.col("doc_id").alias("item_id"), "vector")
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    assert items.filter(F.abs(length - 1) > 1e-3).count() <= items.filter(length == 0).count()
    some = items.filter(length > 0).withColumnRenamed("item_id", "query_id")
    best = R.cosine_topk(some, items, 1)
    assert best.filter("similarity < 0.9999").count() == 0


def test_answers(spark):
    questions = spark.createDataFrame([(1,), (2,)], "query_id long")
    found = spark.createDataFrame(
        [(1, 2, "iso_42001", " second "), (1, 1, "eu_ai_act", "\nfirst\nline\n")], "query_id long, rank int, doc_id string, text string"
    )
    got = {r["query_id"]: r["answer"] for r in R.format_passages(questions, found).collect()}
    assert got[1] == "**[EU AI ACT]**\nfirst\nline\n\n---\n\n**[ISO 42001]**\nsecond"
    assert got[2] == "No relevant regulatory guidance found in the index."


def test_embedding_agrees_with_plain_tfidf(spark):
    import math
    import re
    from collections import Counter

    from wardline.sources.corpus import load_corpus

    corpus = load_corpus(spark)
    texts = {r["doc_id"]: Counter(re.findall(r"[^\W_]+", r["text"].lower())) for r in corpus.collect()}
    df = Counter(token for counts in texts.values() for token in counts)
    weights = {
        d: {t: n * math.log((len(texts) + 1) / (df[t] + 1)) for t, n in counts.items()} for d, counts in texts.items()
    }
    length = {d: math.sqrt(sum(w * w for w in ws.values())) for d, ws in weights.items()}
    # So many features that no two words of this corpus share one.
    embedded = {r["doc_id"]: np.array(r["vector"]) for r in R.embed(R.fit_tfidf(corpus, features=1 << 18), corpus).collect()}
    for a in texts:
        for b in texts:
            expected = sum(w * weights[b].get(t, 0.0) for t, w in weights[a].items()) / length[a] / length[b]
            assert abs(float(embedded[a] @ embedded[b]) - expected) < 1e-4


def test_question_finds_its_passage(spark):
    from wardline.sources.corpus import load_corpus

    corpus = load_corpus(spark)
    model = R.fit_tfidf(corpus)
    questions = spark.createDataFrame(
        [(1, "What does Article 12 say about automatic event logs?"), (2, "lawful basis and data minimisation")], "query_id long, text string"
    )
    items = R.embed(model, corpus).withColumnRenamed("doc_id", "item_id")
    found = R.cosine_topk(R.embed(model, questions), items)
    ranked = R.passages(found, corpus).withColumn("doc_id", F.col("item_id"))
    answers = {r["query_id"]: r["answer"] for r in R.format_passages(questions, ranked).collect()}
    assert answers[1].startswith("**[EU AI ACT OBLIGATIONS]**\n")
    assert answers[2].startswith("**[GDPR AI INTERSECTION]**\n")
    assert all(a.count("\n\n---\n\n") == 1 for a in answers.values())

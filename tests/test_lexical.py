"""Sparse lexical vectors and the early-stopping search against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardline.operators import lexical as L

CORPUS = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_vectors(corpus, texts):
    df = Counter(w for t in corpus for w in set(words(t)))
    rarity = {w: math.log((len(corpus) + 1) / (n + 1)) for w, n in df.items() if n < len(corpus)}
    out = []
    for t in texts:
        raw = {w: n * rarity[w] for w, n in Counter(words(t)).items() if w in rarity}
        length = math.sqrt(sum(x * x for x in raw.values()))
        out.append({w: x / length for w, x in raw.items()})
    return out


def plain_nearest(corpus, asked, k):
    items, found = plain_vectors(corpus, corpus), {}
    for q, vector in enumerate(plain_vectors(corpus, asked)):
        near = [(round(sum(x * item.get(w, 0.0) for w, x in vector.items()), 6), i) for i, item in enumerate(items) if vector.keys() & item.keys()]
        found[q] = sorted(near, key=lambda p: (-p[0], p[1]))[:k]
    return found


def embedded(spark, corpus, asked):
    def frame(texts, key):
        return spark.createDataFrame(list(enumerate(texts)), f"{key} long, text string")

    counted = L.count_terms(frame(corpus, "item_id"), "item_id")
    rarity = L.fit_rarity(counted)
    return L.embed_terms(L.count_terms(frame(asked, "query_id"), "query_id"), rarity, "query_id"), L.embed_terms(counted, rarity, "item_id")


def nearest(questions, items, k):
    found = {}
    for r in sorted(L.lexical_topk(questions, items, k).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["similarity"], r["item_id"]))
    return found


def test_counts(spark):
    texts = ["", None, "b a B", "one", "Émile émile x_y 10", "。。。"]
    df = spark.createDataFrame(list(enumerate(texts)), CORPUS)
    got = {r[0]: r[1] for r in df.select("doc_id", L.term_counts(F.col("text"))).collect()}
    for i, t in enumerate(texts):
        assert {c["term"]: c["n"] for c in got[i] or []} == dict(Counter(words(t)))
        assert [c["term"] for c in got[i] or []] == sorted({c["term"] for c in got[i] or []})


def test_a_long_text_is_counted(spark):
    many = " ".join(f"w{k % 50_000}" for k in range(200_000))
    row = spark.createDataFrame([(1, many)], CORPUS).select(L.term_counts(F.col("text")).alias("c")).select(F.size("c"), F.aggregate("c", F.lit(0), lambda a, c: a + c["n"])).first()
    assert tuple(row) == (50_000, 200_000)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("k", [1, 3, 500])
def test_nearest_as_by_hand(spark, seed, k):
    rng = random.Random(seed)
    # Frequent words and rare ones; repeated texts make ties; a third of all texts are alike.
    def text():
        return " ".join(f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randrange(0, 40)))

    corpus = ["the same w1 w2 w7 text" if rng.random() < 0.33 else text() for _ in range(300)] + ["", None, "lone"]
    asked = [text() for _ in range(25)] + ["the same text", "lone", "unknown words", "", None]
    questions, items = embedded(spark, corpus, asked)
    expected = {q: found for q, found in plain_nearest(corpus, asked, k).items() if found}
    got = nearest(questions, items, k)
    assert got.keys() == expected.keys()
    for q, found in expected.items():
        assert [i for _, i in got[q]] == [i for _, i in found]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in found], abs=1.5e-6)


def test_few_texts_are_compared_in_full(spark, monkeypatch):
    rng = random.Random(3)
    corpus = [" ".join([f"w{int(rng.paretovariate(0.5)) % 200}" for _ in range(60)] + [f"topic{i % 100}"] * 8) for i in range(1000)]
    asked = [f"w0 w1 w2 w3 topic{i} topic{i}" for i in range(10)]
    questions, items = embedded(spark, corpus, asked)
    staged = {}
    real = L.stage

    def kept(df, purpose):
        staged[purpose] = real(df, purpose)
        return staged[purpose]

    monkeypatch.setattr(L, "stage", kept)
    assert {q: [i for _, i in f] for q, f in nearest(questions, items, 2).items()} == {q: [i for _, i in f] for q, f in plain_nearest(corpus, asked, 2).items()}
    assert staged["compared"].count() < 0.2 * len(corpus) * len(asked)


def test_only_postings_of_the_questions_are_kept(spark, monkeypatch):
    corpus = [f"w{i % 7} w{i % 11} lone{i}" for i in range(200)]
    questions, items = embedded(spark, corpus, ["w1 w2 lone5", "w3"])
    staged, real = {}, L.stage

    def kept(df, purpose):
        staged[purpose] = real(df, purpose)
        return staged[purpose]

    monkeypatch.setattr(L, "stage", kept)
    assert nearest(questions, items, 2).keys() == {0, 1}
    assert "items" not in staged
    assert {r["term"] for r in staged["postings"].collect()} == {"w1", "w2", "w3", "lone5"}


def test_empty_tables(spark):
    questions, items = embedded(spark, ["a b", "c"], ["a"])
    assert L.lexical_topk(questions.limit(0), items).count() == 0
    assert L.lexical_topk(questions, items.limit(0)).count() == 0
    none = L.count_terms(spark.createDataFrame([], CORPUS), "doc_id")
    assert L.embed_terms(none, L.fit_rarity(none), "doc_id").count() == 0

"""Exact copies, repeated lines and SimHash groups against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from wardline.llm import components, exactdedup, linededup, simhash


def ascii_lower(text):
    return (text or "").encode().lower()


def test_exact_groups_against_a_dictionary(documents, texts):
    got = {r["doc_id"]: r for r in exactdedup.exact_groups(documents).collect()}
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[ascii_lower(t)].append(i)
    assert len(got) == len(texts)
    for low, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(low).hexdigest())


def test_exact_groups_of_odd_rows(odd, none):
    rows = exactdedup.exact_groups(odd).collect()
    assert len(rows) == 12
    cats = [r for r in rows if r["doc_id"] in (1, 2)]
    assert all(r["keep_id"] == 2 and r["group_size"] == 3 for r in cats) and sum(r["kept"] for r in cats) == 1
    empty = [r for r in rows if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"]) for r in empty) == [(False, 3, 4), (False, 4, 4), (True, 0, 4)]
    assert exactdedup.exact_groups(none).count() == 0


def test_dedup_keeps_one_row_of_each_text(odd, none):
    left = exactdedup.dedup(odd)
    assert left.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 2, 4, 5, 7, 8, 9, 10]
    twice = odd.where("doc_id = 1")
    assert exactdedup.dedup(twice).count() == 1
    assert exactdedup.dedup(none).count() == 0


def test_fingerprints_compose(spark, monkeypatch):
    data = bytes(range(256)) * 3000
    poly = exactdedup.Polynomial()
    whole = poly.of(data)
    for cut in (1, 65536, 100001):
        parts = [data[i : i + cut] for i in range(0, len(data), cut)][:3] if cut == 1 else [data[i : i + cut] for i in range(0, len(data), cut)]
        if cut > 1:
            behind, total = len(data), [0, 0]
            for p in parts:
                behind -= len(p)
                total = [(x + y) % q for x, y, q in zip(total, poly.shifted(p, behind), exactdedup.PRIMES, strict=True)]
            assert tuple(total) == whole
    long = "Ab" * (exactdedup.SEGMENT // 2 + 5)
    df = spark.createDataFrame([(1, long), (2, long.lower()), (3, long + "c")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in exactdedup.exact_groups(df).collect()}
    assert [rows[i]["kept"] for i in (1, 2, 3)] == [False, True, True]
    assert rows[1]["text_sha256"] == hashlib.sha256(long.lower().encode()).hexdigest()


def test_texts_that_share_a_fingerprint_are_told_apart(spark, monkeypatch):
    df = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "abc")], "doc_id long, text string")
    prints = exactdedup.fingerprints

    def colliding(*args):
        return prints(*args).withColumns({"fp_a": F.lit(1), "fp_b": F.lit(1)})

    monkeypatch.setattr(exactdedup, "fingerprints", colliding)
    monkeypatch.setattr(exactdedup, "unlike_texts", lambda d, repeated, text_col="text": repeated)
    rows = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exactdedup.exact_groups(df).collect()}
    assert rows == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_unlike_texts_compares_every_chunk(spark):
    df = spark.createDataFrame([(1, "a" * 70000 + "b"), (2, "a" * 70000 + "b"), (3, "q")], "doc_id long, text string")
    repeated = exactdedup.fingerprints(df).groupBy("fp_a", "fp_b", "n_bytes").count().where("count > 1").drop("count")
    assert repeated.count() == 1
    assert exactdedup.unlike_texts(df, repeated).count() == 0


def plain_lines(texts, min_docs):
    docs = Counter()
    for t in texts:
        docs.update({x.strip(b" \t\n\x0b\x0c\r").lower() for x in (t or "").encode().split(b"\n")})
    out = []
    for t in texts:
        lines = (t or "").encode().split(b"\n")
        keys = [x.strip(b" \t\n\x0b\x0c\r").lower() for x in lines]
        kept = [x for x, k in zip(lines, keys, strict=True) if not k or docs[k] < min_docs]
        out.append((len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
    return out


@pytest.mark.parametrize("min_docs", [2, 10])
def test_lines_against_a_counter(documents, texts, min_docs):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in linededup.dedup_lines(documents, min_docs=min_docs).collect()}
    ids = sorted(texts)
    assert [got[i] for i in ids] == plain_lines([texts[i] for i in ids], min_docs)


def test_lines_of_odd_rows(odd, none):
    rows = linededup.dedup_lines(odd, min_docs=2).collect()
    assert len(rows) == 12 and rows[0].asDict().keys() >= {"row", "kept_text"}
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["n_lines"], r["n_dropped"], r["kept_text"]))
    assert by[1] == [(1, 1, "")] * 2 and by[3] == [(1, 0, "")] and by[5] == [(3, 0, "   \n\t\n")]
    assert linededup.dedup_lines(none).count() == 0


@pytest.mark.parametrize("hot", [1, 3, 40])
@pytest.mark.parametrize("min_docs", [2, 10])
def test_lines_that_are_not_sent_are_found_by_the_join(documents, texts, min_docs, hot, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", hot)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in linededup.dedup_lines(documents, min_docs=min_docs).collect()}
    ids = sorted(texts)
    assert [got[i] for i in ids] == plain_lines([texts[i] for i in ids], min_docs)


@pytest.mark.parametrize("hot", [1, 2, 100])
def test_first_occurrences_stay_either_way(spark, hot, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", hot)
    rng = random.Random(5)
    texts = {i: "\n".join(f"{'Line' if rng.random() < 0.5 else 'line'} {rng.randrange(12)}" for _ in range(rng.randrange(6))) for i in range(60)}
    seen, expected = Counter(), {}
    for text in texts.values():
        seen.update({line.lower() for line in text.split("\n") if line})
    kept_before = set()
    for i, text in sorted(texts.items()):
        kept = []
        for line in text.split("\n"):
            key = line.lower()
            if not key or seen[key] < 2 or key not in kept_before:
                kept.append(line)
            kept_before.add(key)
        expected[i] = "\n".join(kept)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["kept_text"] for r in linededup.dedup_lines(df, min_docs=2, keep_first=True).collect()}
    assert got == expected


def test_first_occurrence_stays(spark):
    df = spark.createDataFrame([(3, "A\nq"), (1, "z\na\nA"), (2, "a ")], "doc_id long, text string")
    rows = {r["doc_id"]: r["kept_text"] for r in linededup.dedup_lines(df, min_docs=2, keep_first=True).collect()}
    assert rows == {1: "z\na", 2: "", 3: "q"}


def plain_simhash(text, width):
    words = ascii_lower(text).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_simhash_groups_against_all_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    prints = {i: plain_simhash(t, 3) for i, t in sorted(texts.items())}
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_groups(rows).collect()}
    wanted = plain_components(prints)
    assert got == {i: (prints[i], wanted[i]) for i in prints}


def test_every_near_pair_meets_at_an_anchor(spark, monkeypatch):
    import random

    random.seed(3)
    monkeypatch.setattr(simhash, "HOME_BLOCK", 8)
    base = [random.getrandbits(64) for _ in range(40)]
    words = {0, *base}
    for b in base[:20]:
        for _ in range(12):
            x = b
            for _ in range(random.randint(1, 3)):
                x ^= 1 << random.randrange(64)
            words.add(x)
    df = spark.createDataFrame([(w - (1 << 64) if w >> 63 else w,) for w in words], "bits long")
    labels = {r["node"]: r["label"] for r in components.components(simhash.links(df)).collect()}
    wanted = plain_components({w: w for w in sorted(words)})
    groups, found = defaultdict(set), defaultdict(set)
    for w in words:
        groups[wanted[w]].add(w)
        signed = w - (1 << 64) if w >> 63 else w
        found[labels.get(signed, signed)].add(w)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_simhash_of_odd_rows(odd, none):
    rows = simhash.near_groups(odd).collect()
    assert len(rows) == 12
    empty = {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16}
    assert empty == {3}
    assert simhash.near_groups(none).count() == 0
    left = simhash.dedup(odd)
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 3, 7, 8, 9, 10]
    assert simhash.dedup(none).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)], "a long, b long")
    labels = {r["node"]: r["label"] for r in components.components(edges).collect()}
    assert labels == {i: 0 for i in range(61)} | {100: 100, 200: 100, 150: 100}


def test_lines_with_columns_of_any_name(spark):
    rows = [(i, "all have this\nown " + str(i), "a", 5, "b", "c", "d") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, KEPT_TEXT string, n_lines int, __row string, __gone string, id string")
    got = linededup.dedup_lines(df).orderBy("doc_id").collect()
    assert got[0].__fields__ == ["doc_id", "text", "__row", "__gone", "id", "kept_text", "n_lines", "n_dropped"]
    assert [tuple(r)[2:] for r in got] == [("b", "c", "d", f"own {i}", 2, 1) for i in range(10)]

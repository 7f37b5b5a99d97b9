"""Resampling, divergence and pieces against plain Python and the sentencepiece library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import divergence, pieces, resample
from wardline.llm.queries import op11_importance_resample, op12_source_divergence, op13_piece_round_trip, pieces_path

SF = "/root/testdata/sf0.001"
UPPER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


# Resampling


def plain_features(text, max_words):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return words, [" ".join(words[i : i + n]) for n in range(1, max_words + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, share, max_words, buckets, min_words, seed):
    """``(id, features, weight, score, rank)`` of each row, in order of falling score."""

    def buckets_of(text):
        return [zlib.crc32(f.encode()) % buckets for f in plain_features(text, max_words)[1]]

    source, wanted = Counter(), Counter()
    for _, text in docs:
        source.update(buckets_of(text))
    for text in target:
        wanted.update(buckets_of(text))
    all_s, all_t = float(source.total()), float(wanted.total())
    rows = []
    for key, text in docs:
        gains = [math.floor(1000 * math.log((wanted[b] + 1.0) * (all_s + buckets) / ((source[b] + 1.0) * (all_t + buckets)))) for b in buckets_of(text)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((key, len(plain_features(text, 1)[0]), len(gains), weight, score))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = share[0] * len(able) // share[1]
    out = [(*r[:1], *r[2:], k + 1 if k < drawn else None) for k, r in enumerate(able)]
    return out + [(*r[:1], *r[2:], None) for r in rows if r[1] < min_words]


def order(rows):
    return sorted(rows, key=repr)


def resampled_rows(df, target, **kw):
    return order((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in resample.resampled(df, target, **kw).collect())


@pytest.mark.parametrize("max_words", [1, 2, 3])
def test_resampled_documents(spark, documents, texts, max_words):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    wanted = plain_resample(list(texts.items()), [r["text"] for r in target.collect()], (30, 100), max_words, 997, 20, 5)
    assert resampled_rows(documents, target, share=(30, 100), max_words=max_words, buckets=997, seed=5) == order(wanted)


def test_op11_takes_the_contract_parameters(spark, texts):
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = op11_importance_resample(spark, SF)
    assert rows.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert order(map(tuple, rows.collect())) == order(plain_resample(list(texts.items()), target, (10, 100), 1, 10_000, 20, 2024))


def test_n_grams_stay_in_their_document():
    texts = [b"a b", b"", b"c", b"Caf\xc3\xa9 x9 " * 30_000, b"d e f"]
    for max_words in (1, 2, 3):
        counts = [Counter() for _ in texts]
        for doc, bucket, _ in resample.features(texts, max_words, 1 << 30):
            for d, b in zip(doc.tolist(), bucket.tolist(), strict=True):
                counts[d][b] += 1
        for text, got in zip(texts, counts, strict=True):
            assert got == Counter(zlib.crc32(f.encode()) % (1 << 30) for f in plain_features(text.decode(), max_words)[1])


def test_resampling_odd_rows(spark, odd, none):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    clashing = odd.withColumnsRenamed({"row": "score"}).withColumns({"rank": F.lit("x"), "id": F.lit(1), "n_words": F.lit(None), "bucket": F.lit(2)})
    target = spark.createDataFrame([("the mat",), (None,), ("",)], "text string")
    wanted = plain_resample(docs, ["the mat"], (50, 100), 2, 64, 1, 1)
    assert resampled_rows(clashing, target, share=(50, 100), max_words=2, buckets=64, min_words=1, seed=1) == order(wanted)
    assert resample.resampled(none, target).count() == 0
    alone = resampled_rows(odd, none, share=(100, 100), min_words=0)
    assert sorted(r[-1] for r in alone) == list(range(1, 13))


def test_one_id_and_score_for_most_rows(spark):
    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    rows = resampled_rows(same.unionByName(spark.createDataFrame([(1, "a b d")], same.schema)), same.limit(1), share=(50, 100), min_words=1)
    assert sorted(r[-1] for r in rows if r[-1]) == list(range(1, 1501)) and {r[-1] for r in rows if r[0] == 1} <= {1, None}


# Divergence


def plain_audit(docs, min_docs=3, top=200):
    """Rows of the report, term by term in whole numbers, for ``(lang, source, text)`` rows."""
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    in_docs, counts = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for lang, source, text in ((x or "", y or "", z or "") for x, y, z in docs):
        terms = [w.translate(UPPER) for w in word.findall(text)]
        in_docs[lang].update(set(terms))
        counts[lang][source].update(terms)
    out = []
    for lang, by_source in counts.items():
        kept = sorted(t for t, n in in_docs[lang].items() if n >= min_docs)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        whole = Counter()
        for c in by_source.values():
            whole.update(c)
        q_lang, p_of = shares(whole), {s: shares(c) for s, c in by_source.items()}
        for source, p in p_of.items():
            pairs = [(other, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)) for other, q in p_of.items() if other != source]
            terms = [(t, (p[t] - q_lang[t]) ** 2 // q_lang[t]) for t in kept if by_source[source][t] and p[t] > q_lang[t]]
            for part, rows in (("pair", pairs), ("term", terms)):
                ranked = sorted(rows, key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def audit_rows(df, **kw):
    return sorted(map(tuple, divergence.audit(df, **kw).collect()))


def test_audit_of_documents(spark, documents):
    docs = [(r["lang"], r["source"], r["text"]) for r in documents.collect()]
    rows = op12_source_divergence(spark, SF)
    assert dict(rows.dtypes)["value"] == "bigint" and dict(rows.dtypes)["rank"] == "int"
    assert sorted(map(tuple, rows.collect())) == plain_audit(docs)


@pytest.mark.parametrize("rows, groups", [(5, 1), (64, 2), (1 << 18, 8)])
def test_shards_and_blocks_change_nothing(documents, monkeypatch, rows, groups):
    few = documents.where("source IN ('src0', 'src1', 'src2', 'src3', 'src4')")
    docs = [(r["lang"], r["source"], r["text"][:300]) for r in few.collect()]
    monkeypatch.setattr(divergence, "SHARD_ROWS", rows * 50)
    monkeypatch.setattr(divergence, "BLOCK_GROUPS", groups)
    monkeypatch.setattr(divergence, "HELD", 20)
    assert audit_rows(few.withColumn("text", F.substring("text", 1, 300)), top_terms=4) == plain_audit(docs, top=4)


def test_audit_of_odd_rows(spark):
    docs = [
        ("en", "a", "The cat the cat"),
        ("en", "a", "The cat the cat"),
        ("en", None, "THE dog é É ÿ"),
        ("en", "", "the dog é"),
        ("en", "b", None),
        ("en", "c", "zebra 12 34"),
        (None, "a", "solo"),
        ("", "b", ""),
        ("fr", "a", "le chat " * 200_000),
        ("fr", "b", "le"),
        ("fr", "c", "le chat"),
        ("fr", "c", "x" * 300_000),
        (None, None, None),
    ]
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    clashing = df.withColumns({"term": F.lit(1), "n": F.lit("x"), "shard": F.lit(0), "item": F.lit("i"), "value": F.lit(0), "all": F.lit(2), "docs": F.lit(3)})
    assert audit_rows(clashing) == plain_audit(docs)
    assert audit_rows(clashing, min_docs=1) == plain_audit(docs, min_docs=1)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_are_exact():
    random.seed(3)
    for total in (1, 7, 10**9 + 7, 8 * 10**15):
        counts = [0, *(random.randrange(total) for _ in range(200))]
        assert divergence.shares(np.array(counts), total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]


def test_pair_costs_are_those_of_all_terms():
    random.seed(4)
    for _ in range(200):
        terms = random.randint(1, 40)
        a, b = ({t: random.randint(1, 50) for t in random.sample(range(terms), random.randint(0, terms))} for _ in range(2))
        sizes = [sum(x.values()) + terms for x in (a, b)]
        p, q = ([1 + 10**9 * (x.get(t, 0) + 1) // n for t in range(terms)] for x, n in zip((a, b), sizes, strict=True))
        groups = []
        for x, n in zip((a, b), sizes, strict=True):
            ids = np.array(sorted(x), np.int64)
            groups.append((ids, divergence.shares(np.array([x[t] for t in ids.tolist()], np.int64), n), 1 + 10**9 // n))
        wanted = tuple(sum((x - y) ** 2 // y for x, y in zip(s, t, strict=True)) for s, t in ((p, q), (q, p)))
        assert divergence.pair_costs(*groups, terms) == wanted


# Pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces_path())


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(pieces_path())


PARTS = [*"abcdefgh ABC   \n\t'sdre1234²½é漢字!?.<|>_-\x00▁\x1c", "the", "for", "and", "ation", "er", " in", "    ", "\U0001f600", "<s>", "</s>", "<unk>", "<0x0A>", "ати", "的", "http://"]
#: Parts whose merges can make room for better ones.
DELICATE = ["for", "or", "fo", "f", "o", "r", "an", "and", "d", "ati", "ation", "on", "the", "th", "he", " ", "  "]


def odd_texts():
    random.seed(1)
    fixed = ["", " ", "  ", "a", "a" * 5000, "for" * 3000, "and" * 500 + "for" * 500, " " * 3000, "▁" * 50 + "the", "x  " * 300, "\n hi", "ha" * 4000, " the" * 10]
    fixed += ["".join(random.choices(PARTS, k=random.randint(1, 80))) for _ in range(1500)]
    fixed += ["".join(random.choices("etaoinshrdlu", k=random.randint(1, 200))) for _ in range(500)]
    fixed += ["".join(random.choices(DELICATE, k=random.randint(1, 60))) for _ in range(1500)]
    return [*fixed, "".join(random.choices(PARTS, k=300_000)), "".join(random.choices("etaoinshrdlu", k=100_000))]


def test_rounds_equal_the_library(library, vocab):
    texts = odd_texts()
    for text, ids in zip(texts, pieces.Encoder(vocab).encode_many(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_eos=True), text[:80]
        assert pieces.decode(vocab, ids) == library.decode(ids.tolist())


def test_any_ids_decode_as_in_the_library(library, vocab):
    random.seed(2)
    blank = library.piece_to_id("▁")
    for _ in range(2000):
        ids = [random.choice([random.randrange(32000), random.randrange(3, 259), random.randrange(3), blank]) for _ in range(random.randint(0, 8))]
        assert pieces.decode(vocab, np.array(ids, np.int64)) == library.decode(ids), ids


def test_words_are_remembered_within_bounds(vocab, library, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE", 10)
    monkeypatch.setattr(pieces, "BLOCK", 7)
    encoder = pieces.Encoder(vocab)
    texts = ["one two three four five", "six seven", "eight nine ten eleven", "one " + "q" * 200] * 3
    assert [x.tolist() for x in encoder.encode_many(texts)] == library.encode(texts, add_eos=True)
    assert len(encoder.table) < 40 and max(map(len, encoder.table)) <= pieces.LONGEST_KEPT


def test_long_unbroken_texts_take_seconds(vocab):
    import time

    random.seed(9)
    encoder = pieces.Encoder(vocab)
    for text in ("x" * 1_000_000, " " * 1_000_000, "for" * 300_000, "".join(random.choices("etaoinshrdlu", k=1_000_000))):
        start = time.monotonic()
        ids = encoder.encode_many([text])[0]
        assert pieces.decode(vocab, ids) == text and time.monotonic() - start < 60


def test_op13_digests(spark, texts, library):
    for r in op13_piece_round_trip(spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_of_odd_rows(odd, none, library):
    clashing = odd.withColumns({"ids": F.lit("x"), "__text": F.lit(1), "decoded": F.lit(None), "a b": F.lit("kept")})
    out = pieces.encoded(clashing, pieces_path())
    assert out.columns == ["doc_id", "row", "__text", "a b", "n_tokens", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == 12 and {r["a b"] for r in rows} == {"kept"}
    wanted = sorted(((r["doc_id"] or -1, library.encode(r["text"] or "", add_eos=True)) for r in odd.collect()))
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in rows) == wanted
    assert pieces.encoded(none, pieces_path()).count() == 0


def test_other_models_are_refused(tmp_path):
    with open(pieces_path(), "rb") as file:
        data = file.read()
    other = tmp_path / "unigram.model"
    other.write_bytes(data.replace(b"\x12\x06tok_v0\x18\x02", b"\x12\x06tok_v0\x18\x01"))
    with pytest.raises(ValueError, match="not a BPE model"):
        pieces.vocabulary(str(other))

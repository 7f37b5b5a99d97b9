"""BPE and packing against the tokenizers library and a plain best-fit."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import bpe, packing
from wardline.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(tokenizer_path())


PARTS = [*"abc ABC  \n\t'sdre1234²½é漢字!?.<|>_- \x1c\x00", "<|endoftext|>", "'ll", " '", "hello", "\U0001f600", "͸", " <|endo"]


def odd_texts():
    random.seed(5)
    fixed = ["", "a", "  ", "<|endoftext|>", " a<|endoftext|>  b", "a" * 9000, "  " * 5000 + "x", " " * 9000, "1" * 10000 + " a", "!" * 9000 + "<|endoftext|>"]
    fixed += ["ab" * 40000, "\n" * 70000 + "a", "é" * 40000, "a " * 3 + " " * 70000, "x" * 65530 + "<|endoftext|>y", "abcdefghij" * 7000 + " 12" + "\t" * 6000 + "q", "²" * 9000]
    return fixed + ["".join(random.choices(PARTS, k=random.randint(0, 60))) for _ in range(800)] + ["".join(random.choices(PARTS, k=150000))]


def test_stream_and_batches_equal_the_library(library, vocab):
    texts = odd_texts()
    encoder = bpe.Encoder(vocab)
    for text, many in zip(texts, bpe.encode_many(bpe.Encoder(vocab), texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids
        assert np.frombuffer(many, "<u4").tolist() == ids
        assert bpe.decode(vocab, many) == library.decode(ids, skip_special_tokens=False)
    assert encoder.held_most <= 2 * bpe.LONG_PIECE + vocab.lookahead


def test_any_feeding_gives_the_same_tokens(library, vocab):
    random.seed(6)
    for text in [t for t in odd_texts() if "<" not in t and len(t) < 20000][:200]:
        encoder, at, out = bpe.Encoder(vocab), 0, b""
        while at < len(text):
            n = random.choice((1, 3, 50, 5000))
            out += encoder.feed(text[at : at + n])
            at += n
        assert np.frombuffer(out + encoder.finish(), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_lookahead_bounds_what_unseen_text_changes(vocab):
    random.seed(7)
    letters = "etaoinshrdlu"
    for _ in range(300):
        text = "".join(random.choices(letters, k=600)).encode()
        cut = 450
        whole, part = bpe._merge_long(vocab, text), bpe._merge_long(vocab, text[:cut])
        at = 0
        for a, b in zip(whole, part, strict=False):
            at += len(b)
            if at > cut - vocab.lookahead:
                break
            assert a == b


def test_decoder_replaces_what_is_no_character(vocab, library):
    ids = [vocab.ids[b"\xe6"], vocab.ids[b"a"], vocab.ids[b"\xf0"]]
    assert bpe.decode(vocab, struct.pack("<3I", *ids)) == library.decode(ids, skip_special_tokens=False)


def test_encoded_rows(odd, none, library):
    rows = bpe.encoded(odd, tokenizer_path()).collect()
    assert len(rows) == 12
    assert sorted(r["n_tokens"] for r in rows if not r["decoded"]) == [0, 0, 0]
    assert bpe.encoded(none, tokenizer_path()).count() == 0


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = min((b for b in bins if b[0] >= n), default=None, key=lambda b: b[0])
        if fit is None:
            fit = [capacity]
            bins.append(fit)
        fit[0] -= n
    return sorted(b[0] for b in bins)


def test_plan_is_best_fit_decreasing():
    random.seed(8)
    for capacity in (7, 64, 500):
        for n in (1, 30, 700):
            lengths = [random.randint(1, capacity) for _ in range(n)]
            counts = {k: lengths.count(k) for k in set(lengths)}
            room, seen = {}, {}
            for length, rank, count, first, offset in packing.best_fit_plan(counts, capacity):
                assert rank == seen.get(length, 0)
                seen[length] = rank + count
                for b in range(first, first + count):
                    assert room.get(b, capacity) == capacity - offset
                    room[b] = capacity - offset - length
            assert seen == counts
            assert sorted(room.values()) == plain_best_fit(lengths, capacity)


def test_tightest_room():
    tree = packing.RoomTree(2048)
    assert tree.tightest(1) is None
    for room in (5, 90, 2048):
        tree.mark(room, True)
    assert [tree.tightest(n) for n in (1, 5, 6, 90, 91, 2048)] == [5, 5, 90, 90, 2048, 2048]
    tree.mark(90, False)
    assert tree.tightest(6) == 2048


def check_packing(rows, texts, library, capacity):
    """Pieces cover the ids, sequences have no gap, the number of sequences is that of best-fit decreasing."""
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc.keys() == ids.keys()
    for i, pieces in by_doc.items():
        at = 0
        for k, p in enumerate(sorted(pieces, key=lambda p: p["piece"])):
            part = ids[i][at : at + p["length"]]
            assert (p["piece"], p["start"], p["ids_crc32"]) == (k, at, zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            assert p["length"] == capacity or k == 0
            at += p["length"]
        assert at == len(ids[i])
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by_sequence) == len(plain_best_fit([r["length"] for r in rows], capacity))


def test_packed_documents(documents, texts, library):
    check_packing(packing.packed(documents, tokenizer_path()).collect(), texts, library, packing.CAPACITY)


def test_packed_odd_rows(odd, none, library):
    rows = packing.packed(odd, tokenizer_path(), capacity=100).collect()
    assert sum(r["doc_id"] == 1 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 2
    known = odd.where("doc_id > 1")
    texts = {r["doc_id"]: r["text"] for r in known.collect()}
    check_packing(packing.packed(known, tokenizer_path(), capacity=100).collect(), texts, library, 100)
    assert packing.packed(none, tokenizer_path()).count() == 0


def test_ranks_are_dense(spark):
    pieces = spark.range(1000).select(F.when(F.col("id") < 900, 5).otherwise(F.col("id") % 7 + 1).cast("long").alias("length"), F.col("id").alias("row"))
    rows = packing._ranked(pieces, 900).collect()
    by = {}
    for r in rows:
        by.setdefault(r["length"], []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())

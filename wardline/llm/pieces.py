"""SentencePiece BPE by vectorised merge rounds, and its inverse.

A batch's words lie in flat numpy arrays: one symbol per character, its place, its word. A round looks
up the rank of every pair of neighbours, takes the least rank of each word by a segmented minimum,
merges all its occurrences from the left, and compacts the arrays; words without a pair left leave. A
word ends before a blank, and wherever two characters meet that no piece of the vocabulary has side by
side: no merge crosses such a place.

Merging all occurrences at once equals merging one after another unless a merge makes room for a better
one (a piece learned before a part of it) that reaches the next occurrence. Ranks for which that can
happen, and shared ranks, are known from the vocabulary; a word in which two such occurrences lie within
the longest piece's reach is merged one pair at a time, by an agenda, from the same pair table.

Words are remembered in a table of bounded size; a block of words, a batch's slice and the ids of one
document are what a task holds. Decoding joins the pieces' bytes; bytes that are no character become one
replacement character each.

Models of kind BPE with byte fallback and identity normalisation are read; others are refused. A null
text counts as empty: only the end id. Rows are treated one by one: repeated rows and ties do not
matter, an empty table gives an empty result. Columns named like a result (``n_tokens``, ``ids``,
``decoded``) are replaced; all others stay, whatever their names.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wardline.llm.common import as_binary, slices, texts_of

SPACE = "▁"
#: A blank run belongs to the word after it.
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_WORD_START = re.compile(f"[^{SPACE}]{SPACE}")
#: Characters of a text, or words, that one step handles; words that are remembered, and the longest of those.
BLOCK = 1 << 17
TABLE = 200_000
LONGEST_KEPT = 64
_NEVER = np.int64(1 << 62)
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _one_each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("wardline_one_each", _one_each)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a serialized message: numbers, or the bytes of strings, messages and floats."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        n = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + n]
        at += n


@dataclass(frozen=True)
class Vocabulary:
    """A model's pieces and what follows from them.

    ``pairs`` are sorted keys of two symbols, with the ``merged`` symbol and the ``rank`` of each; ``touching``
    are sorted keys of two characters that some piece has side by side. ``delicate`` ranks need their
    occurrences merged in order when these are within ``reach`` characters.
    """

    size: int
    surfaces: list[bytes]
    starts_blank: np.ndarray
    silent: np.ndarray
    symbol_of: np.ndarray
    pairs: np.ndarray
    merged: np.ndarray
    rank: np.ndarray
    touching: np.ndarray
    delicate: np.ndarray
    reach: int
    byte_ids: np.ndarray
    end: int
    dummy_prefix: bool


def _delicate_ranks(rank: dict[str, int], symbols: set[str]) -> set[int]:
    """Ranks whose merges can make room for a pair of the same or a lower rank, and ranks that pieces share.

    A piece ``s`` merged from ``b`` and ``c`` beside a symbol ``o`` is harmless if ``o`` and its neighbour in ``s``
    make a pair of lower rank than ``s``: they would have been merged before.
    """
    seen: set[int] = set()
    found = {r for r in rank.values() if r in seen or seen.add(r)}
    for piece, own in rank.items():
        for k in range(1, len(piece)):
            for part, other, left in ((piece[k:], piece[:k], True), (piece[:k], piece[k:], False)):
                of_part = rank.get(part)
                if of_part is None or len(part) < 2 or own > of_part or other not in symbols:
                    continue
                for j in range(1, len(part)):
                    b, c = part[:j], part[j:]
                    if b in symbols and c in symbols and rank.get(other + b if left else c + other, of_part) >= of_part:
                        found.add(of_part)
                        break
    return found


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file."""
    with open(path, "rb") as file:
        data = file.read()
    names, scores, kinds = [], [], []
    trainer: dict[int, int | bytes] = {}
    normalizer: dict[int, int | bytes] = {}
    for field, value in _fields(data):
        if field == 1:
            piece = dict(_fields(value))
            names.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
            kinds.append(piece.get(3, _NORMAL))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normalizer = dict(_fields(value))
    plain = not normalizer.get(2) and not normalizer.get(4, 1) and normalizer.get(5, 1) and not trainer.get(24, 0)
    if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or not plain or set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
        raise ValueError(f"{path}: not a BPE model with byte fallback, identity normalisation and plain pieces")

    # Ranks are dense: 0 for the highest score.
    order = {s: r for r, s in enumerate(sorted({s for s, k in zip(scores, kinds, strict=True) if k == _NORMAL}, reverse=True))}
    ids = {n: i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == _NORMAL}
    rank = {n: order[scores[i]] for n, i in ids.items()}
    # Characters that are no piece of their own can still be a part of one.
    symbols = dict(ids)
    for name in ids:
        for char in name:
            symbols.setdefault(char, len(names) + len(symbols))
    pairs = {}
    touching = set()
    width = len(names) + len(symbols) + 1
    for name, i in ids.items():
        for k in range(1, len(name)):
            touching.add(ord(name[k - 1]) << 21 | ord(name[k]))
            if (left := symbols.get(name[:k])) is not None and (right := symbols.get(name[k:])) is not None:
                pairs[left * width + right] = (i, rank[name])
    keys = np.array(sorted(pairs), np.int64)
    symbol_of = np.full(0x110000, -1, np.int64)
    for name, symbol in symbols.items():
        if len(name) == 1:
            symbol_of[ord(name)] = symbol
    unknown_surface = trainer.get(44, " ⁇ ".encode())

    def surface(i: int) -> bytes:
        if kinds[i] == _BYTE:
            return bytes([int(names[i][3:5], 16)])
        return b"" if kinds[i] == _CONTROL else unknown_surface if kinds[i] == _UNKNOWN else names[i].replace(SPACE, " ").encode()

    byte_ids = np.zeros(256, np.int64)
    for i, kind in enumerate(kinds):
        if kind == _BYTE:
            byte_ids[int(names[i][3:5], 16)] = i
    return Vocabulary(
        size=width,
        surfaces=[surface(i) for i in range(len(names))],
        starts_blank=np.array([k == _NORMAL and n.startswith(SPACE) for n, k in zip(names, kinds, strict=True)]),
        silent=np.array([k == _CONTROL for k in kinds]),
        symbol_of=symbol_of,
        pairs=keys,
        merged=np.array([pairs[k][0] for k in keys.tolist()], np.int64),
        rank=np.array([pairs[k][1] for k in keys.tolist()], np.int64),
        touching=np.array(sorted(touching), np.int64),
        delicate=np.isin(np.arange(len(order) + 1), list(_delicate_ranks(rank, set(symbols)))),
        reach=max(map(len, ids), default=1),
        byte_ids=byte_ids,
        end=names.index((trainer.get(47) or b"</s>").decode()),
        dummy_prefix=bool(normalizer.get(3, 1)),
    )


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted keys are in the sorted ones, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _pair_ranks(vocab: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    at, there = _found(vocab.pairs, left * vocab.size + right)
    return np.where(there & (left >= 0) & (right >= 0), vocab.rank[at] if len(vocab.rank) else 0, _NEVER)


def _merged_one_by_one(vocab: Vocabulary, symbols: list[int], places: list[int]) -> tuple[list[int], list[int]]:
    """The symbols of one word after all merges, the best pair first, of equal ones the leftmost."""
    pairs, after = _pair_table(vocab), list(range(1, len(symbols) + 1))
    before, agenda = list(range(-1, len(symbols) - 1)), []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < len(symbols) and (hit := pairs.get((symbols[i], symbols[j]))):
            heapq.heappush(agenda, (hit[0], i, j, symbols[i], symbols[j], hit[1]))

    for i in range(len(symbols) - 1):
        offer(i, i + 1)
    while agenda:
        _, i, j, left, right, new = heapq.heappop(agenda)
        if symbols[i] != left or symbols[j] != right or after[i] != j:
            continue
        symbols[i], symbols[j], after[i] = new, -2, after[j]
        if after[j] < len(symbols):
            before[after[j]] = i
        offer(before[i], i)
        offer(i, after[i])
    kept = [k for k, s in enumerate(symbols) if s != -2]
    return [symbols[k] for k in kept], [places[k] for k in kept]


@lru_cache(maxsize=2)
def _pairs_of(pairs: bytes, rank: bytes, merged: bytes, size: int) -> dict[tuple[int, int], tuple[int, int]]:
    columns = (np.frombuffer(x, np.int64).tolist() for x in (pairs, rank, merged))
    return {divmod(k, size): (r, m) for k, r, m in zip(*columns, strict=True)}


def _pair_table(vocab: Vocabulary) -> dict[tuple[int, int], tuple[int, int]]:
    return _pairs_of(vocab.pairs.tobytes(), vocab.rank.tobytes(), vocab.merged.tobytes(), vocab.size)


def merge_rounds(vocab: Vocabulary, chars: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and first characters' places of the words that begin at ``starts`` in the code points ``chars``."""
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbol, place = vocab.symbol_of[chars], np.arange(n)
    first = np.zeros(n, bool)
    first[starts] = True
    first[1:] |= ~_found(vocab.touching, chars[:-1].astype(np.int64) << 21 | chars[1:])[1]
    word = np.cumsum(first) - 1
    rank = np.full(n, _NEVER)
    if n > 1:
        rank[:-1] = np.where(first[1:], _NEVER, _pair_ranks(vocab, symbol[:-1], symbol[1:]))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbol):
        edges = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        least = np.minimum.reduceat(rank, edges)
        sizes = np.diff(np.append(edges, len(symbol)))
        per_symbol = np.repeat(least, sizes)
        over = per_symbol == _NEVER
        hit = np.flatnonzero((rank == per_symbol) & ~over)
        # Occurrences of one rank that matter to each other: their words go through the agenda.
        close = (word[hit[1:]] == word[hit[:-1]]) & (place[hit[1:]] - place[hit[:-1]] <= vocab.reach) & vocab.delicate[rank[hit[1:]]]
        if close.any():
            slow = np.unique(word[hit[1:][close]])
            mine = np.isin(word, slow)
            at = np.flatnonzero(mine)
            for part in np.split(at, np.flatnonzero(np.diff(word[at])) + 1):
                done.append(tuple(np.array(x, np.int64) for x in _merged_one_by_one(vocab, symbol[part].tolist(), place[part].tolist())))
            over |= mine
        if over.any():
            ready = over & (per_symbol == _NEVER)
            done.append((symbol[ready], place[ready]))
            symbol, place, word, rank = symbol[~over], place[~over], word[~over], rank[~over]
            hit = np.flatnonzero(rank == per_symbol[~over])
        if not len(hit):
            continue
        # Of a run of overlapping occurrences every second one is merged, from the left.
        run_start = np.concatenate(([True], hit[1:] != hit[:-1] + 1))
        index = np.arange(len(hit))
        hit = hit[(index - np.maximum.accumulate(np.where(run_start, index, 0))) % 2 == 0]
        symbol[hit] = vocab.merged[_found(vocab.pairs, symbol[hit] * vocab.size + symbol[hit + 1])[0]]
        stays = np.ones(len(symbol), bool)
        stays[hit + 1] = False
        moved = hit - np.arange(len(hit))
        symbol, place, word, rank = symbol[stays], place[stays], word[stays], rank[stays]
        # Only the pairs before and after a merged symbol are new.
        for at in (moved, np.maximum(moved - 1, 0)):
            inside = at + 1 < len(symbol)
            rank[at[~inside]] = _NEVER
            at = at[inside]
            rank[at] = np.where(word[at] == word[at + 1], _pair_ranks(vocab, symbol[at], symbol[at + 1]), _NEVER)
    symbols, places = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(places, kind="stable")
    return symbols[order], places[order]


def _blocks(text: str) -> Iterator[list[str]]:
    """The words of a text in blocks of about ``BLOCK`` characters, cut before a word."""
    at = 0
    while at < len(text):
        cut = _WORD_START.search(text, at + BLOCK)
        end = cut.start() + 1 if cut else len(text)
        yield _WORD.findall(text, at, end)
        at = end


class Encoder:
    """Words to ids, with a table of those seen before."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.table: dict[str, tuple[int, ...]] = {}

    def _new(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        text = "".join(words)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum([0, *map(len, words)])
        symbols, places = merge_rounds(self.vocab, chars, starts[:-1])
        ids, cuts = symbols.tolist(), np.searchsorted(places, starts)
        out = {w: tuple(ids[a:b]) for w, a, b in zip(words, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}
        # What is no piece is spelled in bytes.
        odd = np.flatnonzero((symbols < 0) | (symbols >= len(self.vocab.surfaces)))
        for k in odd.tolist():
            ids[k] = self.vocab.byte_ids[list(text[places[k]].encode("utf-8", "surrogatepass"))].tolist()
        for i in np.unique(np.searchsorted(cuts, odd, "right") - 1).tolist():
            out[words[i]] = tuple(chain.from_iterable(x if isinstance(x, list) else (x,) for x in ids[cuts[i] : cuts[i + 1]]))
        return out

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        if len(self.table) > TABLE:
            self.table.clear()
        missing = [w for w in set(words) if w not in self.table]
        if not missing:
            return [*map(self.table.__getitem__, words)]
        new = self._new(missing)
        found = [*map((self.table | new).__getitem__, words)] if len(new) > 1000 else [new[w] if w in new else self.table[w] for w in words]
        self.table.update((w, ids) for w, ids in new.items() if len(w) <= LONGEST_KEPT)
        return found

    def encode_many(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Each text's ids and the end id; words of neighbouring texts share their rounds."""
        texts = list(texts)
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        block: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            ids, at = self.encode_words(block), 0
            for doc, n in owners:
                parts[doc].append(np.fromiter(chain.from_iterable(ids[at : at + n]), np.int32))
                at += n
            block.clear()
            owners.clear()

        for doc, text in enumerate(texts):
            # A text's words come block by block, however long it is.
            for words in _blocks(self.normalized(text)):
                block.extend(words)
                owners.append((doc, len(words)))
                if len(block) >= BLOCK:
                    flush()
        flush()
        end = np.array([self.vocab.end], np.int32)
        return [np.concatenate([*p, end]) for p in parts]

    def normalized(self, text: str) -> str:
        prefix = SPACE if self.vocab.dummy_prefix and text else ""
        return prefix + text.replace(" ", SPACE)


def decode(vocab: Vocabulary, ids: np.ndarray) -> str:
    """The text of the ids; the blank before the first word goes if the model has put it there."""
    said = np.flatnonzero(~vocab.silent[ids])
    # A control id ends a run of bytes; most texts have only the last one.
    runs = np.split(ids[said], np.flatnonzero(np.diff(said) > 1) + 1)
    texts = [b"".join(map(vocab.surfaces.__getitem__, run.tolist())) for run in runs]
    if vocab.dummy_prefix and len(said) and vocab.starts_blank[ids[said[0]]]:
        texts[0] = texts[0][1:]
    return "".join(t.decode("utf-8", "wardline_one_each") for t in texts)


def encoded(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with ``n_tokens`` (the end id counts), ``ids`` and the ``decoded`` text."""
    results = ("n_tokens", "ids", "decoded")
    kept = [c for c in df.columns if c != text_col and c not in results]
    # The text's own name is free now, so that no column of the caller is in the way.
    rows = df.select(*[df[f"`{c}`"] for c in kept], as_binary(f"`{text_col}`").alias(text_col))
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path))
        for batch in batches:
            for part in slices(batch, text_col):
                ids = encoder.encode_many(t.decode("utf-8", "wardline_one_each") for t in texts_of(part.column(text_col)))
                lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                texts = [decode(encoder.vocab, x) for x in ids]
                columns = [*part.columns[:-1], pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], *results])

    return rows.mapInArrow(run, f"{schema}{', ' if schema else ''}n_tokens long, ids array<int>, decoded string")


__all__ = ["Encoder", "decode", "encoded", "merge_rounds", "vocabulary"]

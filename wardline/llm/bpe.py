"""Byte-level BPE as a streaming transducer, and its inverse.

How far can text that has not been read yet change the tokens before it? A merge that takes place only
with the unseen text takes a token from its left neighbour; the neighbour's later merge then does or
does not take place; and so on to the left. Along such a chain the merges come in the order of the
list, each taking a token that the one before it had as its first part. The heaviest chain, found in
one walk over the list, bounds the bytes that the unseen text can reach: the sufficient lookahead.

The encoder reads a text block by block. Pieces of the pre-tokenizer are final once the next piece has
begun. A piece that outgrows its buffer is merged as far as it has come, and the tokens that end more
than the lookahead before the buffer's end are final and leave. Memory is constant: one block, one
buffer, and a table of pieces of bounded size.

The decoder is a state machine over UTF-8: it keeps the bytes of an unfinished character.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import as_binary, slices, texts_of

BLOCK = 1 << 16
#: Bytes from which a piece is merged before its end is known.
LONG_PIECE = 1 << 12
#: Pieces whose tokens are remembered; the table is emptied when it is full.
TABLE = 200_000


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """The most bytes before the end of what has been read whose tokens unseen text can change.

    Walks from the last merge to the first. ``reach[t]``: the heaviest chain among later merges that
    begins by taking a token which starts with ``t``. A merge of ``x`` and ``y`` takes ``x`` away, or
    gives a token that starts with ``x``, and then reaches what a later merge loses with it.
    """
    made = {x + y: x for x, y in merges}
    reach: dict[bytes, int] = {}
    most = 0
    for x, y in reversed(merges):
        far = len(x) + reach.get(x, 0)
        most = max(most, far)
        token: bytes | None = y
        while token is not None:
            if reach.get(token, 0) < far:
                reach[token] = far
            token = made.get(token)
    return most


class Vocabulary:
    """Merges, ids and the pre-tokenizer of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        self.path = path
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.ids = {bytes(map(alphabet.__getitem__, token)): i for token, i in spec["model"]["vocab"].items()}
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        self.merges = [tuple(bytes(map(alphabet.__getitem__, part)) for part in pair) for pair in pairs]
        self.rank = {pair: k for k, pair in enumerate(self.merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: token for token, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.lookahead = sufficient_lookahead(self.merges)

        # Whole pieces at a time: the pre-tokenizer has cut them already. Ranks are places in the merge list.
        self.singles = {t: k for k, t in enumerate(sorted(t for t in self.ids if len(t) == 1))}
        self.ranks = self.singles | {x + y: len(self.singles) + k for k, (x, y) in enumerate(self.merges)}
        self.of_rank = [self.ids[t] for t in self.ranks]
        self.several = tiktoken.Encoding("several", pat_str=r"[^\x00]+|\x00", mergeable_ranks=self.ranks, special_tokens={})

    def ids_of(self, piece: str) -> bytes:
        """The ids of a piece: always the earliest merge of the list, leftmost first."""
        if "\0" in piece:
            ids = [self.ids[t] for t in _merge_long(self, piece.encode())]
        else:
            ids = [self.of_rank[r] for r in self.several.encode_ordinary(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids_of_each(self, pieces: list[str]) -> list[bytes]:
        """The same for many pieces without a zero character, in one call."""
        ranks = self.several.encode_to_numpy("\0".join(pieces), disallowed_special=())
        ids = np.array(self.of_rank, "<u4")[ranks].tobytes()
        cuts = (4 * np.flatnonzero(ranks == self.ranks[b"\0"])).tolist()
        return [ids[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(ids)], strict=True)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Read once per process. The path is a parameter; the file has to be where the executors run."""
    return Vocabulary(path)


#: The pre-tokenizer's pattern in terms of Python's classes, which hold where ``_agreed``.
_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


_AGREED: set[str] = set()


def _agreed(text: str) -> bool:
    """Whether Python's classes hold for all characters: not for other numbers, unassigned ones, 1C-1F."""
    new = set(text) - _AGREED
    if not new:
        return True
    odd = {c for c in new if "\x1c" <= c <= "\x1f" or unicodedata.category(c) in ("No", "Nl", "Cn")}
    _AGREED.update(new - odd)
    return not odd


class _Table(dict):
    """Token ids of pieces, as little-endian 32-bit integers; of bounded size."""

    def __init__(self, vocab: Vocabulary) -> None:
        super().__init__()
        self.vocab = vocab
        self[""] = b""

    def learn(self, pieces: list[str]) -> None:
        """Make sure that all of these pieces are in the table."""
        new = [p for p in pieces if p not in self and "\0" not in p]
        if len(self) + len(new) > TABLE:
            self.clear()
            self[""] = b""
            new = [p for p in pieces if p and "\0" not in p]
        if new:
            self.update(zip(new, self.vocab.ids_of_each(new), strict=True))

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= TABLE:
            self.clear()
            self[""] = b""
        out = self.vocab.ids_of(piece)
        if len(piece) <= 64:
            self[piece] = out
        return out


class Encoder:
    """Feed text, get ids (as little-endian 32-bit integers) as soon as they are final."""

    def __init__(self, vocab: Vocabulary, table: dict | None = None) -> None:
        self.vocab = vocab
        self.table = _Table(vocab) if table is None else table
        self.rest = ""
        #: Bytes of a long piece that are read but not final, and what its characters are.
        self.long = b""
        self.kind = ""
        self.held_most = 0
        self.marks = re.compile("|".join(map(re.escape, vocab.special))) if vocab.special else None
        self.widest = max(map(len, vocab.special), default=0)

    def _pieces(self, text: str) -> list[str]:
        if _agreed(text):
            return _PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.vocab.split(text)]

    def _kind(self, char: str) -> str:
        """By what the pre-tokenizer joins it with."""
        if char.isspace() and not "\x1c" <= char <= "\x1f":
            return "space"
        for kind, probe in (("letter", "a"), ("number", "1"), ("other", "!")):
            if len(self._pieces(probe + char)) == 1:
                return kind
        return "space"

    def _stable(self, final: bool) -> bytes:
        """The tokens of the long piece that nothing can change any more."""
        ids, out, at = self.vocab.ids, [], 0
        limit = len(self.long) if final else len(self.long) - self.vocab.lookahead
        for token in _merge_long(self.vocab, self.long):
            if at + len(token) > limit:
                break
            out.append(ids[token])
            at += len(token)
        self.long = self.long[at:]
        return np.array(out, "<u4").tobytes()

    def _grow(self, text: str, out: list[bytes]) -> str:
        """Add to the long piece the characters that belong to it; the rest of the text."""
        n = 0
        while n < len(text) and self._same(text[n]):
            n += 1
        if self.kind == "space":
            # The last white space before something else is not of the run.
            n -= n == len(text)
            if n < len(text) and n and not self._same(text[n]):
                n -= 1
        part = text[:n].encode()
        for at in range(0, len(part), LONG_PIECE):
            self.long += part[at : at + LONG_PIECE]
            self.held_most = max(self.held_most, len(self.long))
            out.append(self._stable(False))
        return text[n:]

    @lru_cache(maxsize=4096)  # noqa: B019 - of one document's characters
    def _same(self, char: str) -> bool:
        return self._kind(char) == self.kind

    def _plain(self, text: str, final: bool) -> bytes:
        """Text without special tokens; what follows is unknown unless ``final``."""
        out: list[bytes] = []
        self.rest += text
        if self.kind:
            self.rest = self._grow(self.rest, out)
            ended = bool(self.rest) and not (self.kind == "space" and not final and len(self.rest) == 1)
            if ended and self.kind == "space" and not final and self.rest.isspace():
                ended = False
            if ended or final:
                if final and self.kind == "space" and self.rest.isspace():
                    self.long += self.rest.encode()
                    self.rest = ""
                out.append(self._stable(True))
                self.kind = ""
                self._same.cache_clear()
        if not self.kind:
            pieces = self._pieces(self.rest)
            if not final and pieces:
                # The last piece may go on, and so may white space before it.
                keep = 2 if len(pieces) > 1 and (pieces[-2].isspace() or pieces[-2].startswith("'")) else 1
                kept, pieces = "".join(pieces[-keep:]), pieces[:-keep]
                self.rest = kept
            else:
                self.rest = ""
            out.append(b"".join(map(self.table.__getitem__, pieces)))
            if len(self.rest) > LONG_PIECE and not final:
                last = self._pieces(self.rest)
                if len(last) > 1:
                    out.append(b"".join(map(self.table.__getitem__, last[:-1])))
                    self.rest = last[-1]
                body = self.rest[1:] if self.rest[0] == " " else self.rest
                self.kind = self._kind(body[0]) if body else "space"
                if self.kind == "space":
                    self.rest = self._grow(self.rest, out)
                else:
                    lead = len(self.rest) - len(body)
                    self.long = self.rest[:lead].encode()
                    self.rest = self._grow(body, out)
        return b"".join(out)

    def feed(self, text: str) -> bytes:
        """The ids that have become final with this text."""
        return self._feed(text, False)

    def finish(self) -> bytes:
        """The remaining ids; the encoder is then ready for another text."""
        return self._feed("", True)

    def _feed(self, text: str, final: bool) -> bytes:
        if self.marks is None:
            return self._plain(text, final)
        whole = self.rest + text if not self.kind else text
        if "<" not in whole and all("<" in t for t in self.vocab.special):
            return self._plain(text, final)
        return self._with_marks(text, final)

    def _with_marks(self, text: str, final: bool) -> bytes:
        """Special tokens end the text before them and stand for themselves."""
        out: list[bytes] = []
        self.tail = getattr(self, "tail", "")
        if not self.kind:
            text, self.rest = self.rest + text, ""
        elif self.rest:
            text, self.rest = self.rest + text, ""
        at = 0
        for mark in self.marks.finditer(text):
            out.append(self._plain(text[at : mark.start()], True))
            out.append(np.array([self.vocab.special[mark[0]]], "<u4").tobytes())
            at = mark.end()
        out.append(self._plain(text[at:], final))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """All ids of one text, read in blocks."""
        if len(text) <= BLOCK:
            return self._feed(text, True)
        parts, at = [], 0
        while len(text) - at > BLOCK:
            stop = at + BLOCK
            # A special token is never cut: at most its length is left to the next block.
            cut = text.rfind("<", stop - self.widest, stop) if self.widest else -1
            stop = cut if cut > at else stop
            parts.append(self._feed(text[at:stop], False))
            at = stop
        parts.append(self._feed(text[at:], True))
        return b"".join(parts)


def _merge_long(vocab: Vocabulary, data: bytes) -> list[bytes]:
    """The tokens of a buffer: merges by rank from a heap over a linked list."""
    n = len(data)
    parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(vocab.rank[p], i) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in vocab.rank]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        x, y = vocab.merges[r]
        if parts[i] != x or (j := after[i]) >= n or parts[j] != y:
            continue
        parts[i], parts[j] = x + y, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (k := vocab.rank.get((parts[i], parts[after[i]]))) is not None:
                heapq.heappush(heap, (k, i))
        if before[i] >= 0 and (k := vocab.rank.get((parts[before[i]], parts[i]))) is not None:
            heapq.heappush(heap, (k, before[i]))
    return [p for p in parts if p is not None]


class Decoder:
    """Feed ids, get the text that their bytes have completed."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.bytes_of = vocab.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out


def decode(vocab: Vocabulary, ids: bytes) -> str:
    """The text of ids (little-endian 32-bit integers), block by block."""
    decoder, values = Decoder(vocab), np.frombuffer(ids, "<u4")
    parts = [decoder.feed(values[at : at + BLOCK].tolist()) for at in range(0, len(values), BLOCK)]
    return "".join([*parts, decoder.finish()])


#: Characters that are pre-tokenized together; bounds the memory of ``encode_many``.
GROUP = 1 << 19
_LETTER, _NUMBER, _OTHER, _SPACE, _END = range(5)
_STEP = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point where ``_agreed`` holds; code point 0x110000 ends a text."""
    out = np.full(0x110001, _OTHER, np.uint8)
    for c in range(0x110000):
        if unicodedata.category(char := chr(c)).startswith("L"):
            out[c] = _LETTER
        elif char.isdecimal():
            out[c] = _NUMBER
        elif char.isspace() and not 0x1C <= c <= 0x1F:
            out[c] = _SPACE
    out[0x110000] = _END
    return out


def _starts(codes: np.ndarray) -> np.ndarray:
    """Where pieces begin, as flags: the pre-tokenizer's rules on whole arrays of code points."""
    kind = _classes()[codes]
    change = kind[1:] != kind[:-1]
    into_word = (kind[:-1] == _SPACE) & (kind[1:] < _SPACE)
    starts = np.ones(len(codes), bool)
    # The last white space before a word begins a piece, and the word joins it if it is a blank.
    starts[1:] = change & ~(into_word & (codes[:-1] == 0x20))
    starts[:-1] |= into_word
    marks = np.flatnonzero((codes == 0x27) & starts)
    marks = marks[marks < len(codes) - 2]
    one, two = codes[marks + 1], codes[marks + 2]
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    starts[marks[single | double] + 1] = False
    starts[marks[single] + 2] = True
    long = marks[double & ~single] + 3
    starts[long[long < len(codes)]] = True
    return starts


def _encode_group(table: dict, texts: list[str]) -> list[bytes] | None:
    """The ids of texts on which Python's classes hold; None if two pieces had one hash."""
    codes = np.concatenate([x for t in texts for x in (np.frombuffer(t.encode("utf-32-le"), "<u4"), _END_CODE)])
    at = np.flatnonzero(_starts(codes))
    sizes = np.diff(at, append=len(codes))
    place = np.arange(len(codes)) - np.repeat(at, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _STEP, np.uint64))
    hashes = np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * powers[place], at)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    # Pieces with the same hash have to be the same piece.
    like = first[which]
    if (sizes[like] != sizes).any() or (codes[np.repeat(at[like], sizes) + place] != codes).any():
        return None
    whole = "\0".join(texts) + "\0"
    begin, length = at[first], sizes[first]
    pieces = [whole[a:b] for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
    for i in np.flatnonzero(codes[begin] == _END_CODE[0]).tolist():
        pieces[i] = ""
    table.learn(pieces)
    found = list(map(table.__getitem__, pieces))
    counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat, offset = np.frombuffer(b"".join(found), "<u4"), np.cumsum(counts) - counts
    n = counts[which]
    total = np.cumsum(n)
    ids = flat[np.repeat(offset[which] - (total - n), n) + np.arange(total[-1])].tobytes()
    closing = 4 * total[codes[at] == _END_CODE[0]]
    return [ids[a:b] for a, b in zip([0, *closing.tolist()], closing.tolist(), strict=False)]


_END_CODE = np.array([0x110000], "<u4")


def encode_many(encoder: Encoder, texts: list[str]) -> list[bytes]:
    """The ids of each text. Short texts are pre-tokenized together, long ones go through the stream."""
    out: list[bytes] = [b""] * len(texts)
    marks = encoder.vocab.special
    group: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if group:
            some = [texts[i] for i in group]
            done = _encode_group(encoder.table, some)
            for i, ids in zip(group, done if done is not None else map(encoder.encode, some), strict=True):
                out[i] = ids
        group, held = [], 0

    for i, text in enumerate(texts):
        if len(text) > BLOCK or not _agreed(text) or any(m in text for m in marks):
            out[i] = encoder.encode(text)
        elif text:
            group.append(i)
            held += len(text)
            if held > GROUP:
                flush()
    flush()
    return out


def encoded(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids`` (little-endian 32-bit integers) and the ``decoded`` text of each row; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        encoder = Encoder(vocab)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            ids = encode_many(encoder, [text.decode() for text in texts_of(batch.column("text"))])
            texts = [decode(vocab, x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())],
                names=["id", "n_tokens", "ids", "decoded"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("id"), as_binary(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_col)

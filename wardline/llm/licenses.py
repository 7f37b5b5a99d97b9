"""Licence notices in documents by conditional compression.

A block (a line, or of a long line the surroundings of each mention) that mentions a licence at all is
compressed with each template as a raw zstandard dictionary. What a template saves against compression without one says how much of the block it
explains; templates are ranked by that. The best ones are confirmed by the words in which block and
template really differ: a block is that licence when at most ``MAX_DIFFERENCE`` of the template's words
are missing or changed, and all of its telling words (name and version) are there.

Null and empty texts have no blocks. Repeated rows have their findings each. A line has one finding per
licence, its first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import as_binary, texts_of

#: Short notices of common licences, as they are written in files.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0.",
    "ISC": "Released under the ISC License.",
    "Unlicense": "Released into the public domain under the Unlicense.",
    "CC0-1.0": "Released under CC0 1.0 Universal.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
}
#: Words that any of these notices shares with others; the rest of a template are its telling words.
_COMMON = frozenset("licensed released under the this work is license licence version into public domain general by".split())
_CUE = re.compile(rb"(?i)licen[cs]e|unlicense|public domain|\bcc0\b")
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
MAX_DIFFERENCE = 0.35
#: Templates that are compared word by word, by rank.
FINALISTS = 4
_LEVEL = 19


def blocks_of(line: bytes, reach: int) -> Iterator[bytes]:
    """The line without outer white space, or of a long line the ``reach`` bytes around its mentions.

    Mentions within ``reach`` of the first one share a block. A block is cut at blanks and has at most five
    times ``reach`` bytes and those of a mention.
    """
    if len(line) <= 4 * reach:
        if _CUE.search(line):
            yield line.strip()
        return
    first = last = None
    for cue in [*_CUE.finditer(line), None]:
        if first is not None and (cue is None or cue.end() > first + reach):
            # The blanks are sought within another ``reach``; a character at a cut is left out.
            least, most = max(first - 2 * reach, 0), min(last + 2 * reach, len(line))
            begin = max(line.rfind(b" ", least, max(first - reach, 0)), least)
            end = line.find(b" ", last + reach, most)
            end = most if end < 0 else end
            yield line[begin:end].decode(errors="ignore").strip().encode()
            first = None
        if cue is not None:
            first, last = cue.start() if first is None else first, cue.end()


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Matcher:
    """Compressors for the templates; one per process."""

    def __init__(self, templates: dict[str, str] | None = None) -> None:
        self.templates = templates or TEMPLATES
        self.words = {name: words_of(text) for name, text in self.templates.items()}
        self.telling = {name: [w for w in words if w not in _COMMON] for name, words in self.words.items()}
        self.reach = 2 * max(len(text.encode()) for text in self.templates.values())
        self.plain = zstandard.ZstdCompressor(level=_LEVEL, write_content_size=False)
        self.with_template = {
            name: zstandard.ZstdCompressor(level=_LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for name, text in self.templates.items()
        }

    def savings(self, block: str) -> list[tuple[float, str]]:
        """The share of a block's compressed size that each template saves, greatest first."""
        data = block.lower().encode()
        alone = len(self.plain.compress(data))
        return sorted(((alone - len(c.compress(data))) / alone, name) for name, c in self.with_template.items())[::-1]

    def differences(self, block: str, name: str) -> tuple[int, list[str]]:
        """How many of the template's words the block lacks, and the words that differ, ``-`` or ``+``.

        The block's words are compared from its first to its last word in common with the template, so
        that a notice inside a longer line counts as it stands.
        """
        template, words = self.words[name], words_of(block)
        runs = [m for m in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if m.size]
        if not runs:
            return len(template), [f"-{w}" for w in template]
        a = [w for k, w in enumerate(template) if not any(m.a <= k < m.a + m.size for m in runs)]
        b = [words[k] for k in range(runs[0].b, runs[-1].b + runs[-1].size) if not any(m.b <= k < m.b + m.size for m in runs)]
        return len(a), [*(f"-{w}" for w in a), *(f"+{w}" for w in b)]

    def find(self, block: str) -> tuple[str, float, list[str]] | None:
        """The licence of a block, the share that its template saves, and the words that differ."""
        best = None
        present = set(words_of(block))
        ranked = self.savings(block)
        for rank, (saved, name) in enumerate(ranked):
            # Short templates that differ in one word save alike: those level with the last finalist count too.
            if rank >= FINALISTS and saved < ranked[FINALISTS - 1][0] or saved <= 0:
                break
            if any(w not in present for w in self.telling[name]):
                continue
            missing, words = self.differences(block, name)
            if missing <= MAX_DIFFERENCE * len(self.words[name]) and (best is None or len(words) < len(best[2])):
                best = (name, saved, words)
        return best


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per notice: ``id, line, license, saved, n_differences, differences, block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates)
        # Notices are the same few lines everywhere; the table of answers is of bounded size.
        known: dict[bytes, tuple | None] = {}
        for batch in batches:
            docs, rows = [], []
            for i, text in enumerate(texts_of(batch.column("text"))):
                if not _CUE.search(text):
                    continue
                for n, line in enumerate(text.split(b"\n")):
                    reported = set()
                    for block in blocks_of(line, matcher.reach):
                        if block not in known:
                            if len(known) >= 10_000:
                                known.clear()
                            known[block] = matcher.find(block.decode())
                        found = known[block]
                        if found and found[0] not in reported:
                            reported.add(found[0])
                            docs.append(i)
                            rows.append((n, found[0], round(found[1], 6), len(found[2]), " ".join(found[2]), block.decode()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(docs, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=["id", "line", "license", "saved", "n_differences", "differences", "block"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("id"), as_binary(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, line int, license string, saved double, n_differences int, differences string, block string").withColumnRenamed("id", id_col)

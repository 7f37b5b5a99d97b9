"""How the sources of a language differ in their words.

Words are counted per language, source and task before they are shuffled. A language keeps the terms
that enough of its documents have; they are dealt over shards of bounded size by hash, and numbered in
a shard. A group (a language's source) is then one pair of sorted arrays, term ids and counts, per shard.

Every unordered pair of a language's groups meets in each shard: blocks of groups are co-grouped, and
within a block pair two arrays at a time are merged. A galloping intersection finds the terms that both
have; these, the terms of one side only, and the terms that neither has (all alike, so counted, not
listed) are priced in both directions. A task holds two blocks of groups' arrays of one shard, whatever
the corpus; the sums of the shards add up.

Prices are whole numbers: a term's share is ``p = 1 + floor(10^9 * (count + 1) / (N + V))``, with V the
kept terms of the language and N their occurrences in the group, and a term costs ``floor((p - q)^2 / q)``
against share q. They are exact while N + V is below 9 * 10^15.

Null text, language and source count as empty. Every row is a document, also repeated ones; a group
without any word still takes part. Ties in a ranking go to the lesser item by its UTF-8 bytes. An empty
table gives an empty result. Columns beside the three are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import slices, texts_of
from wardline.session import stage

UNIT = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
#: Letters and all bytes of other characters; upper case is lowered before.
_WORD = re.compile(rb"[a-z\x80-\xff]+")
#: Rows (a kept term in a group) of a shard, on average; groups of a block.
SHARD_ROWS = 1 << 18
BLOCK_GROUPS = 8
#: Different terms that a task counts before it hands them on.
HELD = 300_000


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def term_counts(df: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` of the rows ``lang, source, text``: occurrences and documents, per task.

    Each group also has one row with a null term, so that groups without words are known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = [None, *n]
                size = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * size),
                        pa.array([source] * size),
                        pa.array(terms, pa.binary()).cast(pa.string()),
                        pa.array([0, *n.values()], pa.int64()),
                        pa.array([0, *map(docs.__getitem__, n)], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                langs, sources = part.column("lang").to_pylist(), part.column("source").to_pylist()
                for lang, source, text in zip(langs, sources, texts_of(part.column("text")), strict=True):
                    n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                    # A long text is read block by block.
                    own: set[bytes] = set()
                    for words in _words(text):
                        n.update(words)
                        own.update(words)
                    docs.update(own)
                if sum(len(n) for n, _ in held.values()) > HELD:
                    yield from out()
        yield from out()

    rows = df.select(_text("lang").alias("lang"), _text("source").alias("source"), _text("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _words(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """A text's words in blocks of about ``size`` bytes, cut after the end of a word."""
    text = text.lower()
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + size)
        end = cut.end() if cut else len(text)
        yield _WORD.findall(text, at, end)
        at = end


_CUT = re.compile(rb"[^a-z\x80-\xff]")


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """``1 + floor(UNIT * (count + 1) / total)``, by long division in three steps of three digits."""
    rest = counts.astype(np.int64) + 1
    out = np.zeros(len(rest), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def costs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def shared_places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two sorted arrays have the same ids: the shorter one's ids gallop through the longer one."""
    if len(a) > len(b):
        at_b, at_a = shared_places(b, a)
        return at_a, at_b
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(b, a)
    hit = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a)
    return hit, at[hit]


Group = tuple[np.ndarray, np.ndarray, int]


def pair_costs(a: Group, b: Group, terms: int) -> tuple[int, int]:
    """What a costs against b, and b against a, over the ``terms`` terms of a shard.

    A group is its sorted term ids, their shares, and the share of a term that it does not have.
    """
    (a_ids, a_p, a_none), (b_ids, b_p, b_none) = a, b
    in_a, in_b = shared_places(a_ids, b_ids)
    both_a, both_b = a_p[in_a], b_p[in_b]
    only_a, only_b = np.delete(a_p, in_a), np.delete(b_p, in_b)
    neither = terms - len(a_ids) - len(b_ids) + len(in_a)
    none_a, none_b = np.array([a_none]), np.array([b_none])
    there = costs(both_a, both_b).sum() + costs(only_a, none_b).sum() + costs(none_a, only_b).sum() + neither * costs(none_a, none_b)[0]
    back = costs(both_b, both_a).sum() + costs(none_b, only_a).sum() + costs(only_b, none_a).sum() + neither * costs(none_b, none_a)[0]
    return int(there), int(back)


def _groups_of(table: pa.Table) -> list[tuple[str, Group]]:
    out = []
    for source, ids, counts, total in zip(*(table.column(c).to_pylist() for c in ("source", "ids", "counts", "total")), strict=True):
        at, n = np.array(ids, np.int64), np.array(counts, np.int64)
        order = np.argsort(at)
        none = int(shares(np.zeros(1, np.int64), total)[0]) if total else 1
        out.append((source, (at[order], shares(n[order], total) if total else n, none)))
    return out


def _price(left: pa.Table, right: pa.Table) -> pa.Table:
    """The costs of all pairs of a block pair in one shard, both ways."""
    rows: list[tuple] = []
    if left.num_rows and right.num_rows:
        lang, terms = left.column("lang")[0].as_py(), left.column("terms")[0].as_py()
        same = left.column("block")[0] == right.column("block")[0]
        seconds = _groups_of(right)
        for a, one in _groups_of(left):
            for b, other in seconds:
                if a < b or not same:
                    there, back = pair_costs(one, other, terms)
                    rows += [(lang, a, b, there), (lang, b, a, back)]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("lang", "source", "item", "value"), columns, (*[pa.string()] * 3, pa.int64()), strict=True)})


class Audit:
    """The counts behind the two reports, each stage written once."""

    def __init__(self, df: DataFrame, min_docs: int = MIN_DOCS) -> None:
        # One shuffle on the term serves the sums by group and those of the language.
        of_term = Window.partitionBy("lang", "term")
        counts = (
            term_counts(df)
            .repartition("lang", "term")
            .groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            .withColumns(
                {
                    "all": F.sum("n").over(of_term),
                    "in_docs": F.sum("docs").over(of_term),
                    "first": F.row_number().over(of_term.orderBy("source")) == 1,
                }
            )
            .where(F.col("term").isNull() | (F.col("in_docs") >= min_docs))
            .select("lang", "source", "term", "n", "all", "first")
        )
        written = stage(counts, "divergence-counts")
        #: Occurrences of kept terms by group, those of the language beside them; ``first`` marks one row of a term.
        self.counts = written.where("term IS NOT NULL")
        of_lang = self.counts.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("lang_rows"))
        of_group = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
        groups = written.where("term IS NULL").select("lang", "source").join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
        #: Every group: its occurrences of kept terms; the kept terms, their occurrences and rows in its language.
        self.groups = stage(groups.fillna(0), "divergence-groups")

    def pairs(self) -> DataFrame:
        """``lang, source, item, value``: each group against each other source of its language."""
        # Every group has a row in shard 0, with or without terms, so that all pairs meet there.
        sizes = self.groups.select("lang", F.greatest(F.lit(1), F.ceil(F.col("lang_rows") / SHARD_ROWS)).cast("int").alias("shards")).distinct()
        # A term's id is its place in its shard. The shuffle on the shard serves ids, arrays and counts.
        in_shard = Window.partitionBy("lang", "shard").orderBy("term")
        arrays = (
            self.counts.join(sizes, "lang")
            .withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))
            .withColumn("id", F.dense_rank().over(in_shard))
            .groupBy("lang", "shard", "source")
            .agg(F.collect_list(F.struct("id", "n")).alias("found"), F.max("id").alias("last"))
            .withColumn("in_shard", F.max("last").over(Window.partitionBy("lang", "shard")))
            .select("lang", "shard", "source", F.col("found.id").alias("ids"), F.col("found.n").alias("counts"), "in_shard")
        )
        arrays = stage(arrays, "divergence-arrays")
        # Blocks of groups by place in the order of sources: at most BLOCK_GROUPS groups each.
        place = Window.partitionBy("lang").orderBy("source")
        blocked = self.groups.withColumn("block", F.floor((F.row_number().over(place) - 1) / BLOCK_GROUPS).cast("int"))
        blocks = blocked.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
        placed = (
            blocked.join(blocks, "lang")
            .join(sizes, "lang")
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
            .join(arrays.select("lang", "shard", "in_shard").distinct(), ["lang", "shard"], "left")
            .join(arrays.drop("in_shard"), ["lang", "shard", "source"], "left")
            .select(
                "lang",
                "shard",
                "block",
                "blocks",
                "source",
                F.coalesce("ids", F.array().cast("array<int>")).alias("ids"),
                F.coalesce("counts", F.array().cast("array<bigint>")).alias("counts"),
                (F.col("source_n") + F.col("terms")).alias("total"),
                F.coalesce("in_shard", F.lit(0)).cast("long").alias("terms"),
            )
        )
        placed = stage(placed, "divergence-placed")
        key = ["lang", "shard", "first", "second"]
        firsts = placed.withColumn("first", F.col("block")).withColumn("second", F.explode(F.sequence("block", F.col("blocks") - 1)))
        seconds = placed.withColumn("second", F.col("block")).withColumn("first", F.explode(F.sequence(F.lit(0), "block")))
        # The same table on both sides: its columns need names of their own.
        seconds = seconds.toDF(*seconds.columns)
        priced = firsts.groupBy(*key).cogroup(seconds.groupBy(*key)).applyInArrow(_price, "lang string, source string, item string, value long")
        return priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def terms(self) -> DataFrame:
        """``lang, source, item, value``: the terms that a group has more of than its language."""

        def share(count: str, total: str) -> Column:
            # Decimals hold the product exactly, whatever the counts.
            return F.expr(f"1 + cast({UNIT} AS decimal(10, 0)) * cast({count} + 1 AS decimal(19, 0)) div cast({total} + terms AS decimal(19, 0))")

        rows = self.counts.join(self.groups, ["lang", "source"]).withColumns({"p": share("n", "source_n"), "q": share("`all`", "lang_n")})
        return rows.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))


def audit(df: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: all other sources (``pair``) and the telling terms (``term``) of each group."""
    work = Audit(df, min_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = work.pairs().withColumn("rank", F.row_number().over(order))
    terms = work.terms().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    parts = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, rows in (("pair", pairs), ("term", terms))]
    return parts[0].unionByName(parts[1])


__all__ = ["Audit", "audit", "costs", "pair_costs", "shared_places", "shares", "term_counts"]

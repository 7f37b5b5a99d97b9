"""The hash-chained ledger: numbering, sealing, verifying, reviewing.

A chain is a recurrence, so it is sequential within itself; the ledger is many chains, one per
``(tenant_id, segment, block)``, which are sealed in parallel. A block has at most
``block_rows`` rows, so no tenant or day, however large, ends up in one task. One tenant, one
segment and ``block_rows=None`` give a single chain over the whole ledger.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.hashing import GENESIS, entry_payload, recomputed_hash
from wardline.plans.ranking import number_rows
from wardline.schemas import LEDGER
from wardline.session import stage

CHAIN = ["tenant_id", "segment", "block"]
BLOCK_ROWS = 100_000


def day_segment() -> Column:
    return F.date_format("ts", "yyyy-MM-dd")


def assign_seq(
    entries: DataFrame,
    segment: Column | None = None,
    block_rows: int | None = BLOCK_ROWS,
    heads: DataFrame | None = None,
    last_id: int = 0,
) -> DataFrame:
    """Number the entries in append order: ``id`` over all, ``seq`` and ``block`` within a segment.

    Append order is ``(ts, request_id, is_output)``. With the ``heads`` of stored chains and their ``last_id``,
    numbers go on from them. Entries are read twice: stage them if they are dear.
    """
    rows = entries.withColumn("segment", day_segment() if segment is None else segment)
    order, group = ["ts", "request_id", "is_output"], ["tenant_id", "segment"]
    ends = None if heads is None else heads.groupBy(*group).agg(F.max("last_seq").alias("end"))
    rows = number_rows(rows, order, group, "id", "seq", ends).withColumn("id", F.col("id") + last_id)
    return rows.withColumn("block", F.lit(0).cast("long") if block_rows is None else F.expr(f"(seq - 1) div {block_rows}"))


def chain_heads(ledger: DataFrame, keys: list[str] = CHAIN) -> DataFrame:
    """Last hash and row count of every chain; no sort."""
    return ledger.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.max("seq").alias("last_seq"),
        F.coalesce(F.max_by("current_hash", "seq"), F.lit(GENESIS)).alias("head"),
    )


def _link(batches):
    """Carry the hash of the previous row along a partition sorted by chain and position.

    State is one hash, whatever the length of a chain. A row with ``__head`` set is the end of
    a chain already in the ledger: it starts the carry and is not put out.
    """
    chain, carried = None, GENESIS
    for batch in batches:
        keys = zip(*(batch.column(name).to_pylist() for name in CHAIN))
        payloads = batch.column("__payload").to_pylist()
        heads = batch.column("__head").to_pylist()
        previous, current = [], []
        for key, payload, head in zip(keys, payloads, heads):
            if key != chain:
                chain, carried = key, GENESIS
            previous.append(carried)
            carried = head if head is not None else hashlib.sha256((payload + carried).encode()).hexdigest()
            current.append(carried)
        kept = pa.array([head is None for head in heads])
        columns = [batch.column(f.name) for f in LEDGER[:-2]] + [pa.array(previous, pa.string()), pa.array(current, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=LEDGER.names).filter(kept)


def chain_rows(numbered: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Give numbered entries their hashes, going on from the ``heads`` of stored chains if given.

    ``heads`` may be cut down to the segments that the entries fall into.
    """
    fields = LEDGER.names[:-2]
    rows = numbered.select(*fields, entry_payload().alias("__payload"), F.lit(None).cast("string").alias("__head"))
    if heads is not None:
        carry = heads.select(*CHAIN, F.col("last_seq").alias("seq"), F.lit("").alias("__payload"), F.col("head").alias("__head"))
        rows = rows.unionByName(carry, allowMissingColumns=True)
    return rows.repartition(*CHAIN).sortWithinPartitions(*CHAIN, "seq").mapInArrow(_link, LEDGER)


def seal_staged(
    entries: DataFrame,
    segment: Column | None = None,
    block_rows: int | None = BLOCK_ROWS,
    heads: DataFrame | None = None,
    last_id: int = 0,
) -> DataFrame:
    """Number and chain entries that are cheap to read twice, such as a stored table."""
    return chain_rows(assign_seq(entries, segment, block_rows, heads, last_id), heads)


def seal(
    entries: DataFrame,
    segment: Column | None = None,
    block_rows: int | None = BLOCK_ROWS,
    ledger: DataFrame | None = None,
) -> DataFrame:
    """Number and chain the entries; rows already in ``ledger`` are never touched.

    The entries are staged, so that the decisions behind them are made once: numbering samples
    its input before it reads it.
    """
    if ledger is None:
        return seal_staged(stage(entries, "entries"), segment, block_rows)
    last_id = ledger.agg(F.max("id")).first()[0] or 0
    return seal_staged(stage(entries, "entries"), segment, block_rows, chain_heads(ledger), last_id)


def seal_segments(ledger: DataFrame) -> DataFrame:
    """Chain the heads of a tenant's chains, so that a lost tail or a lost chain shows.

    One row per chain of up to ``BLOCK_ROWS`` ledger rows, itself sealed by the same job.
    """
    heads = chain_heads(ledger)
    order = Window.partitionBy("tenant_id").orderBy("segment", "block")
    numbered = heads.select(
        F.concat_ws("/", "segment", "block").alias("request_id"),
        "tenant_id",
        F.lit("heads").alias("segment"),
        F.lit(0).cast("long").alias("block"),
        F.row_number().over(order).cast("long").alias("seq"),
        F.col("n_rows").cast("string").alias("action_taken"),
        F.col("head").alias("rule_violated"),
        F.lit("CLOSED").alias("review_status"),
    ).withColumn("id", F.col("seq"))
    return chain_rows(numbered).select(
        "tenant_id",
        F.col("seq").alias("head_no"),
        F.col("request_id").alias("chain"),
        F.col("action_taken").cast("long").alias("n_rows"),
        F.col("rule_violated").alias("head"),
        F.col("previous_hash").alias("previous_seal"),
        F.col("current_hash").alias("seal"),
    )


def bad_rows(ledger: DataFrame) -> DataFrame:
    """Rows whose stored hash is not that of their stored fields."""
    return ledger.filter(~recomputed_hash().eqNullSafe(F.col("current_hash")))


def verify_chain(ledger: DataFrame) -> DataFrame:
    """One row ``(intact, broken_at)``: the position of the first bad row in id order, or -1.

    Every row is checked on its own; then one minimum and one count, without a sort.
    """
    first_bad = bad_rows(ledger).agg(F.min("id")).scalar()
    position = ledger.filter(F.col("id") <= first_bad).agg(F.count("*").alias("n"))
    return position.select(
        (F.col("n") == 0).alias("intact"), F.when(F.col("n") == 0, -1).otherwise(F.col("n")).alias("broken_at")
    )


def chain_links(ledger: DataFrame) -> DataFrame:
    """Rows whose link to the rest of their chain is wrong, each with its id, its seq and the fault.

    ``orphan``: no row has the previous hash; ``order``: that row does not come just before;
    ``fork``: several rows follow the same row or several start the chain, and each is named. Rows
    are counted by the hash they follow and joined to their parent on it: both by the same keys,
    which spread evenly.
    """
    keys = [*CHAIN, "previous_hash"]
    follows = ledger.select(*keys, "id", "seq").withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    parents = ledger.groupBy(*CHAIN, F.col("current_hash").alias("previous_hash")).agg(F.min("seq").alias("parent_seq"))
    starts = F.col("previous_hash") == GENESIS
    fault = (
        F.when(~starts & F.col("parent_seq").isNull(), "orphan")
        .when(F.col("n") > 1, "fork")
        .when(~starts & (F.col("parent_seq") + 1 != F.col("seq")), "order")
    )
    linked = follows.join(parents, keys, "left")
    return linked.select(*CHAIN, "id", "seq", fault.alias("fault")).filter("fault IS NOT NULL")


def duplicate_requests(batch: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Request ids that may not be appended: repeated in the batch or already in the ledger.

    Null ids may repeat. Counts combine before the shuffle, so one id may hold any share.
    """
    counts = batch.filter("request_id IS NOT NULL").groupBy("request_id").agg(F.count("*").alias("n_in_batch"))
    if ledger is None:
        return counts.withColumn("in_ledger", F.lit(False)).filter("n_in_batch > 1")
    # The batch is the small side: it is broadcast or filters the ledger before the shuffle.
    stored = ledger.select("request_id").join(counts.select("request_id"), "request_id", "left_semi").distinct()
    return (
        counts.join(stored.withColumn("__stored", F.lit(True)), "request_id", "left")
        .select("request_id", "n_in_batch", F.coalesce("__stored", F.lit(False)).alias("in_ledger"))
        .filter("n_in_batch > 1 OR in_ledger")
    )


def drop_duplicates(batch: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The first entry of every new request id, and all entries without an id."""
    columns = batch.columns
    first = (
        batch.filter("request_id IS NOT NULL")
        .groupBy("request_id")
        .agg(F.min_by(F.struct("*"), F.struct("ts", "is_output")).alias("row"))
        .select("row.*")
    )
    if ledger is not None:
        stored = ledger.select("request_id").join(first.select("request_id"), "request_id", "left_semi")
        first = first.join(stored, "request_id", "left_anti")
    return first.select(*columns).unionByName(batch.filter("request_id IS NULL"))


def apply_reviews(ledger: DataFrame, reviews: DataFrame) -> DataFrame:
    """The ledger with the reviewers' latest status per request; the stored rows stay as they are.

    Unknown ids change nothing. Rows without an id get a key of their own, which matches
    nothing and keeps them from meeting in one task.
    """
    latest = (
        reviews.filter("request_id IS NOT NULL")
        .groupBy("request_id")
        .agg(F.max_by("new_status", F.struct("decided_at", "new_status")).alias("__status"))
        .withColumnRenamed("request_id", "__key")
    )
    key = F.coalesce("request_id", F.concat(F.lit("\u0000row "), "id"))
    return (
        ledger.withColumn("__key", key)
        .join(latest, "__key", "left")
        .withColumn("review_status", F.coalesce("__status", "review_status"))
        .select(*ledger.columns)
    )

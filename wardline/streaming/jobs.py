"""The same work on arriving requests.

Deciding is stateless and runs as it stands on a stream. Sealing takes each micro-batch as a
segment of its own, so a replayed batch overwrites its own segment and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.pii import PII_PATTERNS
from wardline.operators.decide import decide, ledger_entries
from wardline.operators.ledger import BLOCK_ROWS, drop_duplicates, duplicate_requests, seal_staged
from wardline.session import stage
from wardline.sources.control import control_state
from wardline.sources.ledger_table import DuplicateRequestError, ledger_scan

SEGMENT = "b%d"
# Ids of a batch start here times the batch number: they grow over batches and never meet.
BATCH_ID_SPAN = 10**11
# Rows of a batch wait for one another in a task up to this size, or up to that of the first rows found so far.
FIRST_BYTES = 1 << 25


def stream_dedup(requests: DataFrame, delay: str = "1 hour", key: str = "request_id") -> DataFrame:
    """The first of every request id, with ``late``: whether it is older than ``delay`` as it comes in.

    An id is remembered for ``delay`` after it came in, by the batches' own clock, which a replay repeats. No row is
    dropped for being late: one whose id is remembered is a repeat, any other is put out. An id can be forgotten when
    a repeat of it comes in only if that is late, so the ledger's sink looks up the ids of late rows alone. Rows
    without an id are nobody's duplicates: they pass beside the state. Of rows with one id in a batch the earliest
    is the first, one without a time the last and never late.

    No id has a call of its own: a task finds the first rows of its ids at once, and Spark's own deduplication
    remembers the ids.
    """
    # A watermark on the event time would make Spark drop what is behind it: time is that of arrival here.
    late = F.coalesce(F.col("ts") < F.current_timestamp() - F.expr(f"INTERVAL {delay}"), F.lit(False))
    rows = requests.withColumn("late", late)
    hold = requests.sparkSession.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {delay})").first()[0]
    named = rows.where(F.col(key).isNotNull()).repartition(key)
    first = named.mapInArrow(_first_of_ids(key), named.schema).withColumn("__arrived", F.current_timestamp())
    # Spark forgets an id once the watermark, which stays behind by this time, is ahead of its arrival by it again.
    kept = first.withWatermark("__arrived", f"{max(hold + 1, 0) // 2} milliseconds").dropDuplicatesWithinWatermark([key])
    return kept.drop("__arrived").unionByName(rows.where(F.col(key).isNull()))


def _first_of_ids(key: str):
    """The function of a task that has all rows of its ids in a batch: the earliest row of each id."""

    def first(rows: pa.Table) -> pa.Table:
        # Rows are picked by their places, so that only ids and times are sorted, never texts.
        order = pc.sort_indices(rows.select([key, "ts"]), sort_keys=[(key, "ascending"), ("ts", "ascending")], null_placement="at_end")
        ids = rows.column(key).take(order)
        begins = np.ones(len(ids), bool)
        begins[1:] = pc.not_equal(ids[1:], ids[:-1]).to_numpy()
        kept = np.zeros(len(ids), bool)
        kept[order.to_numpy()[begins]] = True
        return rows.filter(pa.array(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = None, [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size >= max(FIRST_BYTES, 0 if held is None else held.nbytes):
                held, waiting, size = first(_joined(held, waiting)), [], 0
        if held is not None or waiting:
            yield from first(_joined(held, waiting)).to_batches(max_chunksize=10_000)

    return run


def _joined(held: pa.Table | None, waiting: list[pa.RecordBatch]) -> pa.Table:
    """What was there before stands first: of rows alike in id and time the first one wins."""
    return pa.Table.from_batches(([] if held is None else held.to_batches()) + waiting)


def stream_decide(requests: DataFrame, policies: DataFrame, lexicon: DataFrame, patterns=PII_PATTERNS, default_tenant=None) -> DataFrame:
    """Decisions on a stream of requests, by the plan that serves tables."""
    return decide(requests, policies, lexicon, patterns, default_tenant)


def stream_health(decisions: DataFrame, width: str = "5 seconds", delay: str = "1 minute") -> DataFrame:
    """Counts per time window and tenant, by the ledger's rules, put out once a window can no longer change.

    The last windows of a stream that ends stay open: see ``with_end``.
    """
    action = F.col("action")
    rule = F.when(F.col("allowed"), F.col("review_reason")).otherwise(F.col("reason"))
    flagged = F.coalesce(rule.rlike("(?i)bias|fairness"), F.lit(False))
    return (
        decisions.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "tenant_id")
        .agg(
            F.count("*").alias("total"),
            F.count_if(action != "BLOCKED").alias("approved"),
            F.count_if(action == "BLOCKED").alias("blocked"),
            F.count_if(action == "PENDING_HITL").alias("hitl"),
            F.count_if("requires_review").alias("pending"),
            F.count_if(flagged).alias("fairness_issues"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "tenant_id",
            "total",
            "approved",
            "blocked",
            "hitl",
            "pending",
            "fairness_issues",
        )
    )


def with_end(rows: DataFrame, folder: str) -> DataFrame:
    """The stream ``rows`` with room for a mark of its end in ``folder``, which ``mark_end`` sets.

    The mark is a row far ahead of all others: it closes their windows, and its own is never put out.
    """
    spark = rows.sparkSession
    spark.range(0).select(F.lit(None).cast("timestamp").alias("ts")).write.mode("ignore").parquet(folder)
    return rows.unionByName(spark.readStream.schema("ts timestamp").parquet(folder), allowMissingColumns=True)


def mark_end(spark, folder: str) -> None:
    """Mark the end of a stream that has been worked off; a further run of it closes its windows."""
    spark.range(1).select(F.lit("9999-01-01").cast("timestamp").alias("ts")).write.mode("append").parquet(folder)


def seal_batch(
    entries: DataFrame,
    batch_id: int,
    path: str,
    block_rows: int | None = BLOCK_ROWS,
    check_ids: bool = True,
    on_duplicate: str = "raise",
) -> None:
    """Seal one micro-batch into its own segment; a replay of the batch replaces it.

    ``check_ids`` looks the request ids up in the rest of the ledger (not in the segment itself), which reads
    that column of all of it. Entries of a stream that ``stream_dedup`` has marked are looked up only where
    they are late, and the ledger is not read while none is. A repeated id is an error, or its first entry is
    sealed if the ledger does not have the id yet: with ``on_duplicate`` ``skip`` nothing else is
    kept, with ``quarantine`` all entries of repeated ids are also written, by segment, to
    ``<path>-quarantine``.
    """
    if on_duplicate not in ("raise", "skip", "quarantine"):
        raise ValueError(f"on_duplicate: {on_duplicate}")
    spark = entries.sparkSession
    segment = SEGMENT % batch_id
    entries = stage(entries, "batch")
    others = ledger_scan(spark, path).filter(F.col("segment") != segment) if check_ids else None
    if others is not None and "late" in entries.columns:
        late = entries.where("late").select("request_id")
        others = None if late.isEmpty() else others.join(late, "request_id", "left_semi")
    duplicates = duplicate_requests(entries, others)
    repeated = duplicates.select("request_id").take(5)
    if repeated and on_duplicate == "raise":
        raise DuplicateRequestError(", ".join(row[0] for row in repeated))
    if on_duplicate == "quarantine":
        # Written without repeats as well, so that a replay replaces what it left before.
        held = entries.join(duplicates.select("request_id"), "request_id", "left_semi")
        held.write.mode("overwrite").parquet(f"{path}-quarantine/segment={segment}")
    if repeated:
        entries = stage(drop_duplicates(entries, others), "batch")
    sealed = seal_staged(entries, F.lit(segment), block_rows).withColumn(
        "id", F.col("id") + F.lit(batch_id * BATCH_ID_SPAN)
    )
    (
        sealed.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("segment")
        .parquet(path)
    )


def ledger_sink(path: str, block_rows: int | None = BLOCK_ROWS, check_ids: bool = True, on_duplicate: str = "quarantine"):
    """A ``foreachBatch`` function that seals decisions into the ledger exactly once.

    A repeated id does not stop the stream: see ``seal_batch``.
    """

    def write(decisions: DataFrame, batch_id: int) -> None:
        seal_batch(ledger_entries(decisions), batch_id, path, block_rows, check_ids, on_duplicate)

    return write


def gateway_sink(
    path: str,
    state_path: str,
    policies: DataFrame,
    lexicon: DataFrame,
    block_rows: int | None = BLOCK_ROWS,
    patterns=PII_PATTERNS,
    default_tenant: str | None = None,
    on_duplicate: str = "quarantine",
):
    """A ``foreachBatch`` function for raw requests that reads the kill switch once per batch.

    While the switch is on, the batch leaves no trace in the ledger.
    """

    def write(requests: DataFrame, batch_id: int) -> None:
        if control_state(requests.sparkSession, state_path).first()[0]:
            return
        decided = decide(requests, policies, lexicon, patterns, default_tenant)
        seal_batch(ledger_entries(decided), batch_id, path, block_rows, on_duplicate=on_duplicate)

    return write


def run_available(stream: DataFrame, checkpoint: str, path: str | None = None, batch=None, mode: str = "append") -> None:
    """Work off what has arrived, then stop: into parquet files, or through ``batch``."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(batch).start() if batch else writer.format("parquet").option("path", path).start()
    query.awaitTermination()

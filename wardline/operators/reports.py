"""Reports on the ledger, on load runs and on labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.text import preview

# The sizes of the dashboard's two lists.
RECENT_ROWS = 100
QUEUE_ROWS = 10


def ledger_counts(ledger: DataFrame) -> DataFrame:
    """Total, approved (all that is not blocked), blocked and pending rows, in one scan."""
    blocked = F.count_if(F.col("action_taken") == "BLOCKED")
    return ledger.agg(
        F.count("*").alias("total"),
        (F.count("*") - blocked).alias("approved"),
        blocked.alias("blocked"),
        F.count_if(F.col("review_status") == "PENDING_REVIEW").alias("pending"),
    )


def health_report(ledger: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Blocked, paused and fairness counts and the fairness score, overall or per key."""
    unfair = F.coalesce(F.col("rule_violated").rlike("(?i)bias|fairness"), F.lit(False))
    report = ledger.groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("action_taken") == "BLOCKED").alias("blocked"),
        F.count_if(F.col("action_taken") == "PENDING_HITL").alias("hitl"),
        F.count_if(unfair).alias("fairness_issues"),
    )
    share = (F.col("total") - F.col("fairness_issues")) / F.col("total") * 100.0
    return report.withColumn("fairness_score", F.when(F.col("total") == 0, 100.0).otherwise(F.bround(share, 1)))


def hash_uniqueness(ledger: DataFrame) -> DataFrame:
    """Rows and distinct hashes; equal unless a row was copied.

    Hashes are counted by group first: the shuffle is on the hash itself and spreads evenly.
    """
    hashes = ledger.groupBy("current_hash").count()
    return hashes.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"),
        F.count("current_hash").alias("distinct_hashes"),
    )


def ledger_preview(ledger: DataFrame) -> DataFrame:
    """Ledger rows shortened for reading."""
    return ledger.select(
        "id",
        preview(F.col("request_id"), 18, "...").alias("request_id"),
        "tenant_id",
        "action_taken",
        F.coalesce("rule_violated", F.lit("—")).alias("rule_violated"),
        "review_status",
        preview(F.col("current_hash"), 14, "…").alias("hash_preview"),
    )


def ledger_recent(ledger: DataFrame, n: int = RECENT_ROWS) -> DataFrame:
    """The newest rows; each task keeps at most ``n``."""
    return ledger_preview(ledger.orderBy(F.desc("id")).limit(n))


def review_items(ledger: DataFrame) -> DataFrame:
    """Rows as items of the review queue."""
    is_hitl = F.col("action_taken") == "PENDING_HITL"
    # The labels of the queue.
    return ledger.select(
        "id",
        "request_id",
        preview(F.coalesce("request_id", F.lit("None")), 22, "...").alias("request_preview"),
        F.coalesce("rule_violated", F.lit("None")).alias("rule"),
        is_hitl.alias("is_hitl"),
        F.when(is_hitl, "🛑 HITL PAUSE:").otherwise("⚠ REVIEW:").alias("label"),
    )


def review_queue(ledger: DataFrame, n: int = QUEUE_ROWS) -> DataFrame:
    """The newest rows that wait for a reviewer."""
    waiting = ledger.filter(F.col("review_status") == "PENDING_REVIEW")
    return review_items(waiting.orderBy(F.desc("id")).limit(n))


def pii_histogram(decisions: DataFrame) -> DataFrame:
    """Number of requests per identifier type."""
    return (
        decisions.select(F.explode("pii_detected").alias("pii_type"))
        .groupBy("pii_type")
        .agg(F.count("*").alias("n_requests"))
    )


def red_team_cases(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every labelled case with the status it got; a case without a decision was rejected (422).

    Cases without an id have no decision: they stay out of the join, where they would meet in one task.
    """
    actual = F.when(F.col("allowed").isNull(), 422).when(F.col("allowed"), 200).otherwise(403)
    labelled = cases.select("case_id", "expected_status")
    decided = decisions.select(F.col("request_id").alias("case_id"), "allowed")
    judged = labelled.where("case_id IS NOT NULL").join(decided, "case_id", "left")
    judged = judged.unionByName(labelled.where("case_id IS NULL"), allowMissingColumns=True)
    return judged.select("case_id", "expected_status", actual.alias("actual_status")).withColumn(
        "passed", F.col("expected_status") == F.col("actual_status")
    )


def red_team_battery(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Cases by expected and actual status, with bypasses and false alarms counted."""
    expected, actual = F.col("expected_status"), F.col("actual_status")
    return (
        red_team_cases(cases, decisions)
        .groupBy("expected_status", "actual_status")
        .agg(
            F.count("*").alias("n_cases"),
            F.count_if(F.col("passed")).alias("n_passed"),
            F.count_if((expected == 403) & (actual == 200)).alias("n_bypasses"),
            F.count_if((expected == 200) & (actual == 403)).alias("n_false_positives"),
        )
    )


def _value_bin(value: Column) -> Column:
    """A bin that grows with the value; 256 to the doubling."""
    return F.when(value <= 0, F.lit(-1_000_000)).otherwise(F.floor(F.log2(value) * 256)).cast("long")


def values_at_ranks(samples: DataFrame, run: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """Exact order statistics: ``ranks`` has the run, a ``stat`` name and a 0-based ``rank``.

    Equal values are counted before any shuffle, a histogram tells which bin holds each rank,
    and only the distinct values of those bins are put in order: no task sorts a whole run.
    """
    counted = samples.filter(F.col(value).isNotNull()).groupBy(*run, F.col(value).alias("__value")).agg(
        F.count("*").alias("__n")
    ).withColumn("__bin", _value_bin(F.col("__value")))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        counted.groupBy(*run, "__bin")
        .agg(F.sum("__n").alias("__n"))
        .withColumn("__start", F.coalesce(F.sum("__n").over(before(*run).orderBy("__bin")), F.lit(0)))
    )
    wanted = (
        ranks.join(bins, run)
        .filter((F.col("rank") >= F.col("__start")) & (F.col("rank") < F.col("__start") + F.col("__n")))
        .select(*run, "stat", "__bin", (F.col("rank") - F.col("__start")).alias("__offset"))
    )
    needed = counted.join(wanted.select(*run, "__bin").distinct(), [*run, "__bin"], "left_semi")
    ordered = needed.withColumn(
        "__from", F.coalesce(F.sum("__n").over(before(*run, "__bin").orderBy("__value")), F.lit(0))
    )
    return (
        ordered.join(wanted, [*run, "__bin"])
        .filter((F.col("__offset") >= F.col("__from")) & (F.col("__offset") < F.col("__from") + F.col("__n")))
        .select(*run, "stat", F.col("__value").alias("value"))
    )


def load_report(samples: DataFrame, run: str = "run", seconds: Column | None = None) -> DataFrame:
    """Statuses and latencies per load run.

    ``samples`` has the run, ``status``, ``latency_ms`` and mostly ``ts``. The 95th and 99th percentiles are
    the values at position ``floor(q * n)`` of the sorted list, counted from 0; the median is
    the middle value or the mean of the two. ``seconds`` is the aggregate for a run's duration, by
    default from its first ``ts`` to its last (unknown without that column). Latencies are summed as decimals: the mean does not
    depend on their order.
    """
    status = F.col("status")
    approved, blocked = F.count_if(status == 200), F.count_if(status == 403)
    other = F.count_if(~status.isin(200, 403, 503))
    n = F.count("*")
    if seconds is None:
        seconds = F.expr("timestampdiff(MICROSECOND, min(ts), max(ts)) / 1e6D") if "ts" in samples.columns else F.lit(None).cast("double")
    latency = F.sum(F.col("latency_ms").cast("decimal(18, 6)")).cast("double")
    base = samples.groupBy(run).agg(
        n.alias("n"),
        (n / F.nullif(seconds, F.lit(0.0))).alias("req_per_s"),
        approved.alias("approved"),
        blocked.alias("blocked"),
        other.alias("other"),
        (approved / n * 100).alias("approved_pct"),
        (blocked / n * 100).alias("blocked_pct"),
        (latency / F.count("latency_ms")).alias("mean_ms"),
        F.max("latency_ms").alias("max_ms"),
        F.count("latency_ms").alias("__n"),
    )
    positions = {
        "median_low": F.floor((F.col("__n") - 1) / 2),
        "median_high": F.floor(F.col("__n") / 2),
        "p95_ms": F.floor(F.lit(0.95) * F.col("__n")),
        "p99_ms": F.floor(F.lit(0.99) * F.col("__n")),
    }
    ranks = base.select(
        run,
        F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), v.alias("rank")) for k, v in positions.items()])).alias("p"),
    ).select(run, "p.stat", "p.rank")
    stats = values_at_ranks(samples, [run], "latency_ms", ranks).groupBy(run).pivot("stat", list(positions)).agg(F.max("value"))
    return (
        base.join(stats, run, "left")
        .withColumn("median_ms", (F.col("median_low") + F.col("median_high")) / 2)
        .drop("__n", "median_low", "median_high")
    )

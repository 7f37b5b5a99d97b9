"""The switch's state at each request: both ways against a plain search, long logs, hot instants, odd rows."""

import bisect
import random
import time

import pytest
from pyspark.sql import functions as F

from wardline.sources.control import flag_as_of

REQUESTS = "request_id int, us long, prompt string"


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small inputs would be merged into one partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def held_at(log, us):
    """By hand: of changes at one instant, on counts; the last instant at or before holds."""
    states = {}
    for at, active in log:
        if at is not None and active is not None:
            states[at] = states.get(at, False) or active
    instants = sorted(states)

    def state(x):
        k = bisect.bisect_right(instants, x) - 1 if x is not None else -1
        return states[instants[k]] if k >= 0 else False

    return [state(x) for x in us]


def frames(spark, log, us):
    requests = spark.createDataFrame([(i, x, f"p{i}") for i, x in enumerate(us)], REQUESTS)
    changes = spark.createDataFrame(log, "us long, active boolean")
    at = F.timestamp_micros("us").alias("ts")
    return requests.select("request_id", at, "prompt"), changes.select(at, "active")


def states(df):
    return [r[1] for r in sorted(df.select("request_id", "kill_switch_active").collect())]


@pytest.mark.parametrize("held", [0, 1_000_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_both_ways_equal_a_plain_search(spark, held, seed):
    rng = random.Random(seed)
    # Few instants: many ties among changes, among requests and between both; a third of all requests at one instant.
    log = [(rng.choice([None, *range(300)]), rng.choice([True, False, None])) for _ in range(200)]
    us = [150 if rng.random() < 0.33 else rng.choice([None, *range(-20, 330)]) for _ in range(3000)]
    requests, changes = frames(spark, log, us)
    gated = flag_as_of(requests, changes, held)
    assert gated.columns == ["request_id", "ts", "prompt", "kill_switch_active"]
    assert states(gated) == held_at(log, us)
    assert {r["prompt"] for r in gated.collect()} == {f"p{i}" for i in range(len(us))}


@pytest.mark.parametrize("held", [-1, 1_000_000])
def test_no_changes_and_no_requests(spark, held):
    requests, changes = frames(spark, [(5, True)], [1, 5, 9])
    assert states(flag_as_of(requests, changes.limit(0), held)) == [False] * 3
    assert states(flag_as_of(requests, changes, held)) == [False, True, True]
    assert flag_as_of(requests.limit(0), changes, held).count() == 0


@pytest.mark.parametrize("held", [0, 1_000_000])
def test_a_million_changes_in_ten_years(spark, held):
    ten_years = 10 * 365 * 86_400 * 1_000_000
    n = 1_000_000
    step = ten_years // n
    changes = spark.range(n).select(F.timestamp_micros(F.col("id") * step).alias("ts"), (F.col("id") % 3 == 0).alias("active"))
    at = (F.pmod(F.xxhash64("id"), F.lit(ten_years))).alias("us")
    requests = spark.range(100_000).select(F.col("id").alias("request_id"), at).withColumn("ts", F.timestamp_micros("us"))
    begun = time.monotonic()
    wrong = flag_as_of(requests, changes, held).where(F.col("kill_switch_active") != (F.floor(F.col("us") / step) % 3 == 0))
    assert wrong.count() == 0
    assert time.monotonic() - begun < 120


def test_the_merge_spreads_a_hot_instant(spark):
    requests, changes = frames(spark, [(k, k % 2 == 0) for k in range(50)], [7] * 4000)
    plan = flag_as_of(requests, changes, 0)
    assert states(plan) == [False] * 4000
    parts = [r["__part"] for r in spark.read.parquet(*plan.inputFiles()).where("NOT __end").select("__part").distinct().collect()]
    assert len(parts) > 1

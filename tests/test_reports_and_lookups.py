"""Load statistics, labelled cases, the kill switch and the bounded joins."""

import statistics

import pytest
from pyspark.sql import functions as F

from comparing import SF
from wardline.session import stage
from wardline.catalog import views
from wardline.operators import reports
from wardline.operators.lookups import bind_policy, pair_turns
from wardline.plans.gateway import gate
from wardline.sources import control


@pytest.mark.parametrize("n", [1, 2, 20, 100, 999])
def test_load_report_positions(spark, n):
    values = [((i * 7919) % n) * 0.5 - 1 if i % 3 else 4.0 for i in range(n)]
    statuses = [(200, 403, 503, 500, 422)[i % 5] for i in range(n)]
    samples = spark.createDataFrame(list(zip(["r"] * n, statuses, values)), "run string, status int, latency_ms double")
    row = reports.load_report(samples).first()
    ordered = sorted(values)
    assert row["p95_ms"] == ordered[int(0.95 * n)]
    assert row["p99_ms"] == ordered[int(0.99 * n)]
    assert row["median_ms"] == statistics.median(values)
    assert row["max_ms"] == max(values)
    assert (row["approved"], row["blocked"]) == (statuses.count(200), statuses.count(403))
    assert row["other"] == statuses.count(500) + statuses.count(422)


def test_load_report_with_one_value_in_a_third_of_the_rows(spark):
    samples = spark.range(3000).select(
        F.lit("r").alias("run"), F.lit(200).alias("status"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") / 7).alias("latency_ms")
    )
    values = sorted(r[0] for r in samples.select("latency_ms").collect())
    row = reports.load_report(samples).first()
    assert (row["p95_ms"], row["p99_ms"], row["median_ms"]) == (values[2850], values[2970], statistics.median(values))


def test_battery_counts_bypasses_and_false_alarms(spark):
    cases = spark.createDataFrame([("a", 403), ("b", 200), ("c", 200), ("d", 422)], "case_id string, expected_status int")
    decided = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "request_id string, allowed boolean")
    rows = {(r["expected_status"], r["actual_status"]): r for r in reports.red_team_battery(cases, decided).collect()}
    assert rows[403, 200]["n_bypasses"] == 1 and rows[200, 403]["n_false_positives"] == 1
    assert rows[200, 200]["n_passed"] == 1 and rows[422, 422]["n_passed"] == 1


def test_large_lookup_gives_what_a_broadcast_gives(spark, policies):
    requests = views.prompts(spark, SF)
    columns = ["request_id", "tenant_id", "policy.mask_pii", "policy.longest"]
    small = stage(bind_policy(requests, policies).select(*columns), "small-lookup")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = stage(bind_policy(requests, policies).select(*columns), "shuffled-lookup")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert small.exceptAll(shuffled).count() == 0 and shuffled.count() == requests.count()


def test_two_policies_of_a_tenant_are_an_error(spark, policies):
    with pytest.raises(Exception, match="several policies for tenant tenant_0"):
        bind_policy(views.prompts(spark, SF), policies.unionByName(policies.where("tenant_id = 'tenant_0'"))).select("policy").collect()


def test_switch_history(spark):
    log = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01 10:00:00', true), (timestamp'2024-01-03 09:00:00', false), (timestamp'2024-01-03 09:30:00', true) AS t(ts, active)")
    requests = spark.sql(
        """SELECT concat('r', id) AS request_id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id AS int)) AS ts, 'x' AS prompt
        FROM range(100)"""
    )
    on = {int(r["request_id"][1:]) for r in gate(requests, control_log=log).filter("kill_switch_active").collect()}
    # Hours since the first midnight: on from 10, off from 57 to 57.5, on to the end.
    assert on == set(range(10, 57)) | set(range(58, 100))
    no_log = log.limit(0)
    assert gate(requests, control_log=no_log).filter("kill_switch_active").count() == 0


def test_switch_state(spark, tmp_path):
    on = tmp_path / "on.json"
    on.write_text('{\n "kill_switch_active": true,\n "last_toggled_by": "x"\n}')
    broken = tmp_path / "broken.json"
    broken.write_text("{ not json")
    empty = tmp_path / "other.json"
    empty.write_text('{"something": 1}')
    states = [control.control_state(spark, str(p)).first()[0] for p in (on, broken, empty, tmp_path / "missing.json")]
    assert states == [True, False, False, False]
    requests = views.prompts(spark, SF)
    gated = gate(requests, control.is_active(control.control_state(spark, str(on))))
    assert gated.filter("kill_switch_active").count() == requests.count()


def test_turn_pairs(spark):
    talk = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a@b.com"), (1, 3, "user", "v"), (2, 0, "assistant", "w")],
        "conv_id long, turn long, role string, text string",
    )
    rows = pair_turns(talk).collect()
    assert [(r["turn"], r["response"], r["output_allowed"]) for r in rows] == [(1, "a@b.com", False)]

"""Streams give what the tables give, and a replayed batch changes nothing."""

import json
import time

import pytest

from comparing import SF
from wardline.catalog import queries, views
from wardline.operators import ledger as L
from wardline.operators import reports
from wardline.session import work_folder
from wardline.sources import ledger_table as T
from wardline.sources import requests
from wardline.streaming import jobs


@pytest.fixture(scope="module")
def feed(spark):
    """The prompts in five files, one micro-batch each."""
    path = work_folder(spark, "test-feed")
    views.prompts(spark, SF).repartitionByRange(5, "ts").write.parquet(path)
    return path


def read_feed(spark, feed):
    return spark.readStream.schema(requests.REQUESTS).option("maxFilesPerTrigger", 1).parquet(feed)


def test_decisions_are_those_of_the_table(spark, feed, policies, lexicon):
    out = work_folder(spark, "test-out")
    stream = jobs.stream_decide(read_feed(spark, feed), policies, lexicon)
    jobs.run_available(stream, f"{out}-progress", out)
    streamed = spark.read.parquet(out)
    table = queries.decisions(spark, SF)
    columns = ["request_id", "tenant_id", "action", "reason", "anonymized_prompt", "explanation"]
    assert streamed.count() == table.count()
    assert streamed.select(*columns).exceptAll(table.select(*columns)).count() == 0


def test_batches_seal_into_their_own_segments(spark, feed, policies, lexicon):
    path = work_folder(spark, "test-ledger")
    stream = jobs.stream_decide(read_feed(spark, feed), policies, lexicon)
    jobs.run_available(stream, f"{path}-progress", batch=jobs.ledger_sink(path, block_rows=20))
    sealed = T.ledger_scan(spark, path)
    assert sealed.select("segment").distinct().count() == 5
    assert sealed.count() == queries.entries(spark, SF).count()
    assert sealed.select("id").distinct().count() == sealed.count()
    assert tuple(L.verify_chain(sealed).first()) == (True, -1) and L.chain_links(sealed).count() == 0


def test_replayed_batch_changes_nothing(spark, entries_of):
    path = work_folder(spark, "test-ledger")
    batch = entries_of([("a", "t", "PASSED", None), ("b", "t", "BLOCKED", "x")])
    other = entries_of([("c", "t", "PASSED", None)])
    jobs.seal_batch(batch, 0, path)
    jobs.seal_batch(other, 1, path)
    before = sorted(map(tuple, T.ledger_scan(spark, path).collect()))
    jobs.seal_batch(batch, 0, path)
    assert sorted(map(tuple, T.ledger_scan(spark, path).collect())) == before
    with pytest.raises(T.DuplicateRequestError):
        jobs.seal_batch(batch, 2, path)


def test_repeated_ids_do_not_stop_the_stream(spark, entries_of):
    path = work_folder(spark, "test-ledger")
    jobs.seal_batch(entries_of([("a", "t", "PASSED", None)]), 0, path)
    batch = entries_of([("a", "t", "BLOCKED", "x"), ("b", "t", "PASSED", None), ("b", "t", "BLOCKED", "x"), ("c", "t", "PASSED", None)])
    for _ in range(2):
        jobs.seal_batch(batch, 1, path, on_duplicate="quarantine")
        sealed = T.ledger_scan(spark, path)
        assert sorted(r["request_id"] for r in sealed.collect()) == ["a", "b", "c"]
        assert tuple(L.verify_chain(sealed).first()) == (True, -1)
        assert sorted(r["request_id"] for r in spark.read.parquet(f"{path}-quarantine").collect()) == ["a", "b", "b"]
    with pytest.raises(ValueError):
        jobs.seal_batch(batch, 2, path, on_duplicate="ignore")


def test_end_of_stream_closes_every_window(spark, feed, policies, lexicon):
    """The feed comes in five batches in any order, hence the long delay; counts agree with the whole table."""
    out, end = work_folder(spark, "test-out"), work_folder(spark, "test-end")
    stream = jobs.stream_health(jobs.with_end(jobs.stream_decide(read_feed(spark, feed), policies, lexicon), end), "1 day", "60 days")
    for _ in range(2):
        jobs.run_available(stream, f"{out}-progress", out)
        jobs.mark_end(spark, end)
    got = spark.read.schema(stream.schema).parquet(out).groupBy().sum("total", "approved", "blocked", "pending", "fairness_issues").first()
    whole = reports.ledger_counts(L.seal(queries.entries(spark, SF))).first()
    health = reports.health_report(L.seal(queries.entries(spark, SF))).first()
    assert tuple(got) == (whole["total"], whole["approved"], whole["blocked"], whole["pending"], health["fairness_issues"])


def test_dedup(spark, feed):
    out = work_folder(spark, "test-out")
    twice = read_feed(spark, feed)
    jobs.run_available(jobs.stream_dedup(twice.union(read_feed(spark, feed)), "40 days"), f"{out}-progress", out)
    assert spark.read.parquet(out).count() == views.prompts(spark, SF).count()


def _feed_batch(spark, path, rows):
    df = spark.createDataFrame(rows, "request_id string, n int, s long")
    df.selectExpr("request_id", "n", "timestamp_seconds(s) AS ts").coalesce(1).write.mode("append").parquet(path)


def test_late_rows_are_marked_not_lost(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    now, day = int(time.time()), 86400
    batches = [
        [("a", 1, now), ("a", 2, now + 5), ("b", 3, now)],
        [("c", 4, now + 30 * day), ("a", 5, now), (None, 6, now), (None, 7, now)],
        # Days behind what came before: new ids, and repeats of remembered ones.
        [("z", 8, now - 2 * day), ("z", 9, now - 3 * day), ("a", 10, now - 9 * day), ("y", 11, 0), (None, 12, None), ("e", 13, None)],
        [("z", 14, now), ("f", 15, now)],
    ]
    for rows in batches:
        _feed_batch(spark, source, rows)
        stream = spark.readStream.schema("request_id string, n int, ts timestamp").parquet(source)
        jobs.run_available(jobs.stream_dedup(stream, "1 hour"), progress, out)
    got = {r["n"]: r["late"] for r in spark.read.parquet(out).collect()}
    assert got == {1: False, 3: False, 4: False, 6: False, 7: False, 9: True, 11: True, 12: False, 13: False, 15: False}


def test_a_forgotten_id_comes_back_as_late(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    first = int(time.time())
    for rows in ([("a", 1, first)], [("x", 2, first + 60)], [("a", 3, first)]):
        _feed_batch(spark, source, rows)
        stream = spark.readStream.schema("request_id string, n int, ts timestamp").parquet(source)
        jobs.run_available(jobs.stream_dedup(stream, "2 seconds"), progress, out)
        time.sleep(4)
    got = {r["n"]: r["late"] for r in spark.read.parquet(out).collect()}
    assert {1, 2, 3} == set(got) and got[3]


def test_no_id_has_a_call_of_its_own(spark, feed):
    plan = jobs.stream_dedup(read_feed(spark, feed), "1 hour")._jdf.queryExecution().analyzed().toString()
    assert "WithState" not in plan and "DeduplicateWithinWatermark" in plan


@pytest.mark.parametrize("size", [1, 1 << 25])
def test_the_earliest_row_of_an_id_is_its_first_in_a_batch(spark, tmp_path, monkeypatch, size):
    """Also where a task finds it in parts; an id's last rows have no time, of equal times one passes."""
    monkeypatch.setattr(jobs, "FIRST_BYTES", size)
    rows = [(f"i{i}", i * 100 + n, None if n == 5 else 1_700_000_000 + (n * 7) % 5 - 2 * (n == 3)) for n in range(6) for i in range(3000)]
    _feed_batch(spark, str(tmp_path / "in"), [*rows, ("none", 1, None), ("none", 2, None), ("same", 3, 5), ("same", 4, 5)])
    stream = spark.readStream.schema("request_id string, n int, ts timestamp").parquet(str(tmp_path / "in"))
    jobs.run_available(jobs.stream_dedup(stream, "40 days"), str(tmp_path / "progress"), str(tmp_path / "out"))
    got = {r["request_id"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got.pop("none") in (1, 2) and got.pop("same") in (3, 4)
    assert got == {f"i{i}": i * 100 + 3 for i in range(3000)}


def test_late_rows_reach_the_ledger_or_its_quarantine(spark, entries_of):
    path = work_folder(spark, "test-ledger")
    jobs.seal_batch(entries_of([("a", "t", "PASSED", None)]).selectExpr("*", "false AS late"), 0, path)
    batch = entries_of([("a", "t", "PASSED", None), ("z", "t", "PASSED", None), ("n", "t", "PASSED", None)])
    jobs.seal_batch(batch.selectExpr("*", "request_id <> 'n' AS late"), 1, path, on_duplicate="quarantine")
    assert sorted(r["request_id"] for r in T.ledger_scan(spark, path).collect()) == ["a", "n", "z"]
    assert [r["request_id"] for r in spark.read.parquet(f"{path}-quarantine").collect()] == ["a"]
    assert L.chain_links(T.ledger_scan(spark, path)).count() == 0


def test_ids_of_a_marked_stream_are_not_looked_up_unless_late(spark, entries_of, monkeypatch):
    path = work_folder(spark, "test-ledger")
    jobs.seal_batch(entries_of([("a", "t", "PASSED", None)]).selectExpr("*", "false AS late"), 0, path)
    seen = []
    monkeypatch.setattr(jobs, "duplicate_requests", lambda batch, others: seen.append(others) or L.duplicate_requests(batch, others))
    jobs.seal_batch(entries_of([("b", "t", "PASSED", None)]).selectExpr("*", "false AS late"), 1, path)
    assert seen == [None] and T.ledger_scan(spark, path).count() == 2


def test_rows_without_an_id_all_pass(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES (NULL, timestamp'2024-01-01'), (NULL, timestamp'2024-01-01'), (NULL, timestamp'2024-01-02'), ('a', timestamp'2024-01-01'), ('a', timestamp'2024-01-01') AS t(request_id, ts)").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("request_id string, ts timestamp").parquet(str(tmp_path / "in"))
    jobs.run_available(jobs.stream_dedup(stream, "40 days"), str(tmp_path / "progress"), str(tmp_path / "out"))
    assert sorted(r["request_id"] or "" for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["", "", "", "a"]


def test_switch_is_read_per_batch(spark, feed, policies, lexicon, tmp_path):
    path, state = work_folder(spark, "test-ledger"), tmp_path / "state.json"
    state.write_text(json.dumps({"kill_switch_active": True}))
    sink = jobs.gateway_sink(path, str(state), policies, lexicon)

    def batch(requests, batch_id):
        sink(requests, batch_id)
        state.write_text(json.dumps({"kill_switch_active": batch_id % 2 == 1}))

    jobs.run_available(read_feed(spark, feed), f"{path}-progress", batch=batch)
    # Batch 0 met the switch on, then it went off, off, on, off.
    segments = {r["segment"] for r in T.ledger_scan(spark, path).select("segment").distinct().collect()}
    assert segments == {"b1", "b3"}


def test_health_windows(spark, feed, policies, lexicon):
    out = work_folder(spark, "test-out")
    at_once = spark.readStream.schema(requests.REQUESTS).parquet(feed)
    stream = jobs.stream_health(jobs.stream_decide(at_once, policies, lexicon), "1 day", "1 hour")
    jobs.run_available(stream, f"{out}-progress", out)
    table = queries.decisions(spark, SF)
    expected = table.filter("ts < timestamp'2024-01-30'").groupBy("tenant_id").count()
    got = spark.read.schema(stream.schema).parquet(out).groupBy("tenant_id").sum("total")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))

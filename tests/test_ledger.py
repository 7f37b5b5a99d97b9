"""Chains against a plain loop, and what tampering leaves behind."""

import hashlib
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from comparing import SF
from wardline.catalog import queries
from wardline.functions.hashing import GENESIS, entry_payload, recomputed_hash
from wardline.operators import ledger as L
from wardline.operators import reports
from wardline.schemas import LEDGER
from wardline.session import stage, work_folder
from wardline.sources import ledger_table as T
from wardline.sources.id_index import build_filter, may_have, stored_ids, write_ids
from wardline.sources.manifest import ConcurrentAppendError, read_manifest


def plain_chains(rows, block_rows=None):
    """request_id -> (seq, block, previous, current), from entries in append order."""
    count, head, out = {}, {}, {}
    for rid, tenant, action, rule, segment in rows:
        seq = count[tenant, segment] = count.get((tenant, segment), 0) + 1
        block = 0 if block_rows is None else (seq - 1) // block_rows
        previous = head.get((tenant, segment, block), GENESIS)
        current = hashlib.sha256(f"{rid}{tenant}{action}{rule or ''}{previous}".encode()).hexdigest()
        head[tenant, segment, block] = current
        out[rid] = (seq, block, previous, current)
    return out


def as_dict(ledger):
    return {r["request_id"]: (r["seq"], r["block"], r["previous_hash"], r["current_hash"]) for r in ledger.collect()}


@pytest.fixture(scope="module")
def entries(spark):
    return stage(queries.entries(spark, SF), "test-entries")


def in_order(entries):
    rows = entries.withColumn("segment", L.day_segment()).orderBy("ts", "request_id", "is_output").collect()
    return [(r["request_id"], r["tenant_id"], r["action_taken"], r["rule_violated"], r["segment"]) for r in rows]


@pytest.mark.parametrize("partitions", [1, 4, 17])
@pytest.mark.parametrize("block_rows", [None, 3])
def test_seal_agrees_with_a_loop_whatever_the_partitions(spark, entries, partitions, block_rows):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        sealed = L.seal(entries.repartition(partitions), block_rows=block_rows)
        assert as_dict(sealed) == plain_chains(in_order(entries), block_rows)
        assert [r["request_id"] for r in sealed.orderBy("id").collect()] == [r[0] for r in in_order(entries)]
        assert {r["id"] for r in sealed.collect()} == set(range(1, entries.count() + 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_chain_over_everything(spark, entries):
    one = entries.withColumn("tenant_id", F.lit("t"))
    sealed = L.seal(one, segment=F.lit("all"), block_rows=None)
    rows = [(r[0], "t", r[2], r[3], "all") for r in in_order(entries)]
    assert as_dict(sealed) == plain_chains(rows)


def test_fold_in_sql_gives_the_same_heads(spark, entries):
    sealed = L.seal(entries)
    folded = sealed.groupBy(*L.CHAIN).agg(
        F.array_sort(F.collect_list(F.struct("seq", entry_payload().alias("payload")))).alias("rows")
    ).select(
        *L.CHAIN,
        F.aggregate("rows", F.lit(GENESIS), lambda acc, x: F.sha2(F.concat(x["payload"], acc), 256)).alias("folded"),
    )
    heads = L.chain_heads(sealed).join(folded, L.CHAIN)
    assert heads.filter("head <> folded").count() == 0 and heads.count() > 100


def test_append_goes_on_from_stored_chains(spark, entries):
    path = work_folder(spark, "test-ledger")
    first, second = entries.filter("hash(request_id) % 2 = 0"), entries.filter("hash(request_id) % 2 <> 0")
    T.ledger_append(first, path, block_rows=4)
    T.ledger_append(second, path, block_rows=4)
    stored = T.ledger_scan(spark, path)
    assert as_dict(stored) == plain_chains(in_order(first) + in_order(second), 4)
    assert stored.select("id").distinct().count() == entries.count()
    assert tuple(L.verify_chain(stored).first()) == (True, -1)
    assert L.chain_links(stored).count() == 0


def test_a_hot_day_is_split_into_blocks(spark, entries_of):
    rows = [(f"q{i:04}", "big" if i % 10 else "small", "PASSED", None) for i in range(1000)]
    same_time = entries_of(rows).withColumn("ts", F.timestamp_seconds(F.lit(1704067200)))
    sealed = L.seal(same_time, block_rows=50)
    assert sealed.groupBy(*L.CHAIN).count().agg(F.max("count")).first()[0] == 50
    ordered = [(rid, t, a, r, "2024-01-01") for rid, t, a, r in sorted(rows)]
    assert as_dict(sealed) == plain_chains(ordered, 50)


def test_rows_alike_in_every_key_are_numbered_apart(spark, entries_of):
    rows = entries_of([(None, "t", "PASSED", None)] * 500).withColumn("ts", F.timestamp_seconds(F.lit(1704067200)))
    sealed = stage(L.seal(rows, block_rows=100), "test-alike")
    assert sorted(r["id"] for r in sealed.collect()) == list(range(1, 501))
    assert tuple(L.verify_chain(sealed).first()) == (True, -1) and L.chain_links(sealed).count() == 0


def test_duplicates_are_refused_or_skipped(spark, entries_of):
    path = work_folder(spark, "test-ledger")
    T.ledger_append(entries_of([("a", "t", "PASSED", None), (None, "t", "PASSED", None), (None, "t", "PASSED", None)]), path)
    for rows in ([("a", "t", "PASSED", None)], [("b", "t", "PASSED", None), ("b", "t", "BLOCKED", "x")]):
        with pytest.raises(T.DuplicateRequestError):
            T.ledger_append(entries_of(rows), path)
    assert T.ledger_scan(spark, path).count() == 3
    T.ledger_append(
        entries_of([("a", "t", "BLOCKED", "x"), ("b", "t", "PASSED", None), ("b", "t", "BLOCKED", "y"), (None, "t", "PASSED", None)]),
        path,
        on_duplicate="skip",
    )
    stored = T.ledger_scan(spark, path)
    assert stored.count() == 5
    assert stored.filter("request_id = 'b'").first()["action_taken"] == "PASSED"
    assert tuple(L.verify_chain(stored).first()) == (True, -1)


def test_an_append_reads_no_ledger_rows(spark, entries, monkeypatch):
    path = work_folder(spark, "test-ledger")
    T.ledger_append(entries.filter("hash(request_id) % 3 = 0"), path, block_rows=4)
    # Rows of the first append that nobody may read: the second one goes on from heads, ids and manifest alone.
    stored = T.ledger_scan(spark, path).collect()
    [first] = read_manifest(spark, path).appends
    shutil.rmtree(f"{path}/append={first}")
    T.ledger_append(entries.filter("hash(request_id) % 3 <> 0"), path, block_rows=4)
    now = read_manifest(spark, path)
    assert now.last_id == entries.count() and now.appends[0] == first
    second = spark.read.schema(LEDGER).parquet(f"{path}/append={now.appends[1]}")
    whole = spark.createDataFrame(stored, LEDGER).unionByName(second.select(*LEDGER.names))
    assert sorted(r["id"] for r in whole.collect()) == list(range(1, entries.count() + 1))
    assert L.chain_links(whole).count() == 0 and tuple(L.verify_chain(whole).first()) == (True, -1)


def test_rows_of_a_failed_append_do_not_count(spark, entries_of, monkeypatch):
    path = work_folder(spark, "test-ledger")
    T.ledger_append(entries_of([("a", "t", "PASSED", None)]), path)

    def fail(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(T, "commit", fail)
        with pytest.raises(OSError):
            T.ledger_append(entries_of([("b", "t", "PASSED", None)]), path)
    assert [r["request_id"] for r in T.ledger_scan(spark, path).collect()] == ["a"]
    T.ledger_append(entries_of([("b", "t", "PASSED", None)]), path)
    stored = T.ledger_scan(spark, path)
    assert sorted((r["id"], r["request_id"]) for r in stored.collect()) == [(1, "a"), (2, "b")]
    assert L.chain_links(stored).count() == 0
    with pytest.raises(T.DuplicateRequestError):
        T.ledger_append(entries_of([("b", "t", "PASSED", None)]), path)


def test_of_two_writers_the_second_fails(spark, entries_of, monkeypatch):
    path = work_folder(spark, "test-ledger")
    T.ledger_append(entries_of([("a", "t", "PASSED", None)]), path)
    old = read_manifest(spark, path)
    T.ledger_append(entries_of([("b", "t", "PASSED", None)]), path)
    with monkeypatch.context() as m:
        m.setattr(T, "read_manifest", lambda *_: old)
        with pytest.raises(ConcurrentAppendError):
            T.ledger_append(entries_of([("c", "t", "PASSED", None)]), path)
    assert sorted(r["request_id"] for r in T.ledger_scan(spark, path).collect()) == ["a", "b"]
    # A file that a writer died over is passed over, and its number is not used again.
    with open(f"{path}/_manifest/3.json", "w") as file:
        file.write("{")
    T.ledger_append(entries_of([("d", "t", "PASSED", None)]), path)
    assert read_manifest(spark, path).number == 4
    assert sorted(r["request_id"] for r in T.ledger_scan(spark, path).collect()) == ["a", "b", "d"]


def test_id_index_against_a_plain_lookup(spark):
    path = work_folder(spark, "test-ids")
    appends = {"1-x": range(0, 3000, 2), "2-y": range(1, 900, 3), "3-z": []}
    for name, numbers in appends.items():
        rows = spark.createDataFrame([(f"q{i}",) for i in numbers] + [(None,)], "request_id string")
        write_ids(rows, path, name)
    batch = spark.createDataFrame([(f"q{i}",) for i in range(0, 6000, 5)] + [(None,), ("q0",)], "request_id string")
    have = {f"q{i}" for numbers in appends.values() for i in numbers}
    got = [r[0] for r in stored_ids(batch, path, tuple(appends)).collect()]
    assert sorted(got) == sorted(have & {f"q{i}" for i in range(0, 6000, 5)})
    fresh = spark.createDataFrame([("new",), (None,)], "request_id string")
    assert stored_ids(fresh, path, tuple(appends)).count() == 0


def test_filters_miss_nothing_and_admit_little():
    rng = np.random.default_rng(2)
    for n in (1, 10, 5000):
        mine, others = rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, 20_000, np.uint64)
        bits = build_filter(mine)
        assert may_have(bits, mine).all() and may_have(bits, others).mean() < 0.01


def test_a_ledger_without_a_manifest_is_not_appended_to(spark, entries_of):
    path = work_folder(spark, "test-ledger")
    T.write_sealed(L.seal(entries_of([("a", "t", "PASSED", None)])), path)
    with pytest.raises(ValueError, match="without a manifest"):
        T.ledger_append(entries_of([("b", "t", "PASSED", None)]), path)


def test_empty_store_and_genesis(spark, entries_of):
    path = work_folder(spark, "test-ledger")
    assert T.ledger_scan(spark, path).count() == 0
    assert tuple(L.verify_chain(T.ledger_scan(spark, path)).first()) == (True, -1)
    assert GENESIS == "0" * 32
    assert T.bootstrap_ledger(entries_of([("a", "t", "PASSED", None)]), path) == 1
    assert T.bootstrap_ledger(entries_of([("b", "t", "PASSED", None)]), path) == 0
    assert T.ledger_scan(spark, path).first()["previous_hash"] == GENESIS


def test_odd_values_stay_intact(spark, entries_of):
    rows = [
        ("r1", "t1", "PASSED", None),
        ("r2", "t1", "BLOCKED", "违规内容: malware"),
        ("r3", "t1", "BLOCKED", "X" * 10_000),
        (None, "t1", "PASSED", None),
        ("r5", None, "PASSED", 'quote " comma, line\nbreak'),
        ("r6", "", "PASSED", ""),
    ]
    path = work_folder(spark, "test-ledger")
    T.ledger_append(entries_of(rows), path)
    stored = T.ledger_scan(spark, path)
    assert tuple(L.verify_chain(stored).first()) == (True, -1)
    out = work_folder(spark, "test-csv")
    T.export_ledger_csv(stored, out)
    back = {r["id"]: r["rule_violated"] for r in T.read_ledger_csv(spark, out).collect()}
    assert back[2] == "违规内容: malware" and back[5] == 'quote " comma, line\nbreak'


@pytest.fixture(scope="module")
def chain(spark):
    rows = [(f"r{i}", "t", "BLOCKED" if i % 3 == 0 else "PASSED", f"rule {i}" if i % 3 == 0 else None, "CLOSED", 1704067200 + i) for i in range(1, 11)]
    df = spark.createDataFrame(
        rows, "request_id string, tenant_id string, action_taken string, rule_violated string, review_status string, s long"
    ).selectExpr("* except (s)", "timestamp_seconds(s) AS ts", "false AS is_output")
    return stage(L.seal(df), "test-chain")


def found(ledger):
    links = {(r["seq"], r["fault"]) for r in L.chain_links(ledger).collect()}
    return tuple(L.verify_chain(ledger).first()), links


def test_intact_chain(chain):
    assert found(chain) == ((True, -1), set())


def test_edited_field(chain):
    edited = chain.withColumn("action_taken", F.when(F.col("seq") == 3, "PASSED").otherwise(F.col("action_taken")))
    assert found(edited) == ((False, 3), set())


def test_position_is_not_the_id(chain):
    edited = chain.filter("seq > 2").withColumn("rule_violated", F.when(F.col("seq") == 6, "x").otherwise(F.col("rule_violated")))
    assert found(edited)[0] == (False, 4)


def test_deleted_row(chain):
    assert found(chain.filter("seq <> 5")) == ((True, -1), {(6, "orphan")})


def test_swapped_rows(chain):
    swapped = chain.withColumn("seq", F.when(F.col("seq") == 4, 5).when(F.col("seq") == 5, 4).otherwise(F.col("seq")).cast("long"))
    assert found(swapped) == ((True, -1), {(4, "order"), (5, "order"), (6, "order")})


def test_rehashed_row(chain):
    edited = chain.withColumn("action_taken", F.when(F.col("seq") == 3, "PASSED").otherwise(F.col("action_taken")))
    forged = edited.withColumn("current_hash", recomputed_hash())
    assert found(forged) == ((True, -1), {(4, "orphan")})


def test_fork(chain):
    other = chain.filter("seq = 4").withColumn("request_id", F.lit("r4b")).withColumn("seq", F.lit(11).cast("long"))
    forked = chain.unionByName(other.withColumn("current_hash", recomputed_hash()))
    assert found(forked)[1] == {(4, "fork"), (11, "fork")}


def test_every_orphan_is_named_with_its_own_id(chain):
    lost = [chain.filter("seq = 5").withColumns({"seq": F.lit(seq).cast("long"), "id": F.lit(i).cast("long"), "previous_hash": F.lit("gone")}) for i, seq in ((2000, 20), (5000, 7))]
    links = {(r["id"], r["seq"], r["fault"]) for r in L.chain_links(chain.unionByName(lost[0]).unionByName(lost[1])).collect()}
    assert links == {(2000, 20, "orphan"), (5000, 7, "orphan")}


def test_second_start(chain):
    other = chain.filter("seq = 1").withColumn("request_id", F.lit("r1b")).withColumn("seq", F.lit(11).cast("long"))
    assert found(chain.unionByName(other.withColumn("current_hash", recomputed_hash())))[1] == {(1, "fork"), (11, "fork")}


def test_cut_tail_shows_in_the_seals(chain):
    cut = chain.filter("seq < 9")
    assert found(cut) == ((True, -1), set())
    assert L.seal_segments(cut).first()["seal"] != L.seal_segments(chain).first()["seal"]


def test_reviews(spark, chain):
    reviews = spark.sql(
        """SELECT * FROM VALUES ('r1', 'REJECTED', timestamp'2024-01-02'), ('r1', 'APPROVED', timestamp'2024-01-03'),
        ('nobody', 'APPROVED', timestamp'2024-01-03'), (NULL, 'APPROVED', timestamp'2024-01-03') AS t(request_id, new_status, decided_at)"""
    )
    unnamed = chain.withColumn("request_id", F.when(F.col("seq") < 5, F.col("request_id")))
    reviewed = L.apply_reviews(unnamed, reviews)
    assert reviewed.count() == 10
    assert [r["request_id"] for r in reviewed.filter("review_status = 'APPROVED'").collect()] == ["r1"]
    assert tuple(L.verify_chain(L.apply_reviews(chain, reviews)).first()) == (True, -1)


@pytest.mark.parametrize("issues, score", [(1, 93.8), (15, 6.2), (16, 0.0), (0, 100.0)])
def test_fairness_score_rounds_ties_to_even(spark, issues, score):
    rule = F.when(F.col("id") < issues, "some BIAS here")
    rows = spark.range(16).select(F.lit("PASSED").alias("action_taken"), rule.alias("rule_violated"))
    assert reports.health_report(rows).first()["fairness_score"] == score


def test_reports_on_an_empty_ledger(chain):
    assert tuple(reports.health_report(chain.limit(0)).first()) == (0, 0, 0, 0, 100.0)
    assert tuple(reports.ledger_counts(chain.limit(0)).first()) == (0, 0, 0, 0)
    assert tuple(reports.hash_uniqueness(chain.limit(0)).first()) == (0, 0)


def test_lists_are_newest_first(chain):
    assert [r["id"] for r in reports.ledger_recent(chain, 3).orderBy("id").collect()] == [8, 9, 10]
    pending = chain.withColumn("review_status", F.when(F.col("id") % 2 == 0, "PENDING_REVIEW").otherwise("CLOSED"))
    assert {r["id"] for r in reports.review_queue(pending, 2).collect()} == {8, 10}


def test_deciding_does_not_follow_the_files(spark, tmp_path):
    """One file with one row group is one task; deciding on its rows is not."""
    from wardline.catalog import queries
    from wardline.session import spread

    spark.range(200_000).selectExpr("id", "sha2(string(id), 512) AS text").coalesce(1).write.parquet(str(tmp_path / "one"))
    rows = spread(spark.read.parquet(str(tmp_path / "one")))
    assert rows.rdd.getNumPartitions() > 1 and rows.select("id").distinct().count() == rows.count() == 200_000
    for name in ("decisions", "entries"):
        plan = getattr(queries, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "RebalancePartitions" in plan

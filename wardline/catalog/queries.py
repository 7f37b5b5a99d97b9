"""One named query per operator, each over whole tables.

Lists are joined to text in the results, so that they compare as plain values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog import views
from wardline.operators import decide as dec
from wardline.operators import ann, audit, guards, identity, ledger, lexical, lookups, outcomes, registered, reports, retrieval
from wardline.functions.text import contained_terms, token_count
from wardline.plans.gateway import gate, gateway_ledger
from wardline.session import spread, stage, work_folder
from wardline.sources import control, corpus, ledger_table, policies, requests, verified
from wardline.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Short chains for the queries that show how a segment is cut into blocks.
SHORT_BLOCK = 40


def query(fn=None, *, name: str | None = None):
    """Register a query under its own name, or under ``name``."""
    if fn is None:
        return lambda f: query(f, name=name)
    QUERIES[name or fn.__name__] = fn
    return fn


def joined(*names: str):
    """The named list columns as text."""
    return {name: F.array_join(name, ",") for name in names}


def event_no(column: str = "request_id"):
    """The number in a request id of the ``prompts`` view."""
    return F.regexp_extract(column, r"^req-(\d+)", 1).cast("long")


def bound_prompts(spark, sf):
    valid, _ = guards.validate(views.prompts(spark, sf))
    return lookups.bind_policy(valid, views.policies(spark))


def decisions(spark, sf):
    return dec.decide(spread(views.prompts(spark, sf)), views.policies(spark), views.lexicon(spark))


def entries(spark, sf):
    return dec.ledger_entries(decisions(spark, sf))


_SEALED: dict[tuple, str] = {}


def sealed_ledger(spark, sf) -> DataFrame:
    """The ledger of the prompts as a stored table, made once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SEALED:
        path = work_folder(spark, "ledger")
        ledger_table.write_sealed(ledger.seal(entries(spark, sf)), path)
        _SEALED[key] = path
    return ledger_table.ledger_scan(spark, _SEALED[key])


def damaged_ledger(spark, sf) -> DataFrame:
    """The ledger after tampering: actions edited, rows removed, rows re-hashed after an edit."""
    from wardline.functions.hashing import recomputed_hash

    n = event_no()
    edited = n % 997 == 5
    forged = n % 991 == 3
    return (
        sealed_ledger(spark, sf)
        .filter(n % 1009 != 0)
        .withColumn("action_taken", F.when(edited | forged, "PASSED*").otherwise(F.col("action_taken")))
        .withColumn("current_hash", F.when(forged, recomputed_hash()).otherwise(F.col("current_hash")))
    )


# Sources and sinks


@query
def load_requests(spark, sf):
    path = work_folder(spark, "requests")
    views.prompts(spark, sf).select(F.to_json(F.struct("request_id", "tenant_id", "ts", "prompt")).alias("value")).write.text(path)
    rows = requests.load_requests(spark, path, "json")
    return rows.select("request_id", "tenant_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "prompt")


@query
def load_policy(spark, sf):
    """The loaded rules of every tenant and the requests they apply to."""
    seen = views.prompts(spark, sf).groupBy("tenant_id").agg(F.count("*").alias("n_requests"))
    rules = views.policies(spark).select(
        "tenant_id",
        "version",
        F.array_join("frameworks", ",").alias("frameworks"),
        F.array_join("block_forbidden_tokens", ",").alias("forbidden"),
        F.array_join("hitl_triggers", ",").alias("triggers"),
        "enforce_pii_masking",
        "minimum_safety_threshold",
        F.col("fallbacks")["kill_switch"].alias("kill_switch_message"),
    )
    return rules.join(seen, "tenant_id")


@query
def bias_lexicon(spark, sf):
    lexicon = views.lexicon(spark)
    docs = views.texts(spark, sf, "documents").withColumn("terms", policies.lexicon_terms(lexicon))
    hits = (
        docs.select(F.explode(contained_terms(F.lower("text"), F.col("terms"))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n_docs"))
    )
    return lexicon.join(hits, "term", "left").select("category", "term", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def _append_in_two(spark, sf):
    """Even requests first, odd ones later into the same days, so that chains go on."""
    path = work_folder(spark, "ledger")
    rows = stage(entries(spark, sf), "entries")
    for half in (0, 1):
        ledger_table.ledger_append(rows.filter(event_no() % 2 == half), path, block_rows=SHORT_BLOCK)
    return ledger_table.ledger_scan(spark, path)


@query
def ledger_append(spark, sf):
    return _append_in_two(spark, sf)


@query
def ledger_scan(spark, sf):
    return sealed_ledger(spark, sf)


@query
def export_ledger_csv(spark, sf):
    path = work_folder(spark, "export")
    ledger_table.export_ledger_csv(sealed_ledger(spark, sf), path)
    return ledger_table.read_ledger_csv(spark, path)


@query
def bootstrap_ledger(spark, sf):
    path = work_folder(spark, "ledger")
    rows = entries(spark, sf)
    first = ledger_table.bootstrap_ledger(rows, path)
    second = ledger_table.bootstrap_ledger(rows, path)
    stored = ledger_table.ledger_scan(spark, path)
    return stored.agg(
        F.lit(first).alias("first_call"), F.lit(second).alias("second_call"), F.count("*").alias("stored")
    )


@query
def corpus_upsert_new(spark, sf):
    path = work_folder(spark, "corpus")
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    corpus.corpus_upsert_new(docs.filter("lang = 'en'").withColumn("text", F.lower("text")), path)
    corpus.corpus_upsert_new(docs, path)
    return corpus.corpus_scan(spark, path, docs.schema)


@query
def admit_pages(spark, sf):
    status = F.when(F.contains("url", F.lit("example.org")), 404).otherwise(200)
    pages = views.table(spark, sf, "pages").withColumn("status", status)
    return requests.admit_pages(pages).select("page_id", "html")


@query
def control_state(spark, sf):
    log = views.table(spark, sf, "events").select("user_id", "ts", (F.col("event_type") == "error").alias("active"))
    return control.latest_state(log, ["user_id"])


@query
def control_state_files(spark, sf):
    """State files made from the control log, read by the reader: the switch on, off, broken and missing."""
    path = work_folder(spark, "state")
    log = views.view(spark, sf, views.CONTROL_LOG_SQL)
    texts = {
        "on": log.filter("active").select(F.to_json(F.struct(F.col("active").alias("kill_switch_active"), "ts"))),
        "off": log.filter("NOT active").select(F.to_json(F.struct(F.col("active").alias("kill_switch_active"), "ts"))),
        "broken": log.select(F.concat(F.lit("{ not json "), F.col("ts").cast("string"))),
    }
    for name, rows in texts.items():
        rows.coalesce(1).write.text(f"{path}/{name}")
    states = [control.control_state(spark, f"{path}/{name}").withColumn("file", F.lit(name)) for name in (*texts, "missing")]
    return reduce(DataFrame.unionByName, states)


@query
def assign_request_ids(spark, sf):
    rows = views.view(spark, sf, views.PROMPTS_SQL).withColumn("request_id", F.when(F.col("event_id") % 5 != 0, F.col("request_id")))
    return identity.assign_request_ids(rows, ["event_id", "tenant_id"]).select("event_id", "request_id")


# Guards


@query
def validate_requests(spark, sf):
    valid, rejected = guards.validate(views.prompts(spark, sf))
    return valid.select("request_id", F.lit(0).alias("status")).unionByName(rejected.select("request_id", "status"))


@query
def guard_forbidden(spark, sf):
    return guards.guard_forbidden(bound_prompts(spark, sf)).select("request_id", "forbidden_term")


@query
def safety_candidates(spark, sf):
    return guards.safety_candidates(bound_prompts(spark, sf)).select("request_id", "candidate")


@query
def safety_candidates_documents(spark, sf):
    docs = views.texts(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    docs = docs.withColumn("tenant_id", F.concat(F.lit("tenant_"), F.col("doc_id") % 4))
    bound = lookups.bind_policy(docs, views.policies(spark))
    return guards.safety_candidates(bound).select("doc_id", "candidate")


@query
def safety_score(spark, sf):
    return guards.safety_score(bound_prompts(spark, sf)).select("request_id", "safety_score")


@query
def safety_score_spellings(spark, sf):
    """Near spellings of the policy's terms, on both sides of the ratio's limit."""
    spelled = views.view(spark, sf, views.SPELLINGS_SQL).withColumn("tenant_id", F.lit("tenant_0"))
    bound = lookups.bind_policy(spelled, views.policies(spark))
    return guards.safety_score(bound).select("event_id", "prompt", "safety_score")


@query
def guard_threshold(spark, sf):
    return guards.guard_threshold(bound_prompts(spark, sf)).select("request_id", "safety_score", "below_threshold")


@query
def mask_pii(spark, sf):
    valid, _ = guards.validate(views.prompts(spark, sf))
    return guards.mask_pii(valid).select("request_id", "has_pii", "clean", "pii_types").withColumns(joined("pii_types"))


@query
def mask_pii_documents(spark, sf):
    docs = views.texts(spark, sf, "documents")
    return guards.mask_pii(docs, "text").select("doc_id", "has_pii", "clean", "pii_types").withColumns(joined("pii_types"))


@query
def mask_pii_pages(spark, sf):
    pages = views.texts(spark, sf, "pages")
    return guards.mask_pii(pages, "html").select("page_id", "has_pii", "clean", "pii_types").withColumns(joined("pii_types"))


@query
def detect_pii(spark, sf):
    valid, _ = guards.validate(views.prompts(spark, sf))
    return guards.detect_pii(valid).select("request_id", "has_pii", "pii_types").withColumns(joined("pii_types"))


@query
def detect_pii_documents(spark, sf):
    docs = views.texts(spark, sf, "documents")
    return guards.detect_pii(docs, "text").select("doc_id", "has_pii", "pii_types").withColumns(joined("pii_types"))


@query
def detect_pii_pages(spark, sf):
    pages = views.texts(spark, sf, "pages")
    return guards.detect_pii(pages, "html").select("page_id", "has_pii", "pii_types").withColumns(joined("pii_types"))


@query
def guard_pii_block(spark, sf):
    return guards.guard_pii_block(bound_prompts(spark, sf)).select("request_id", "clean", "pii_blocked")


@query
def guard_hitl(spark, sf):
    return guards.guard_hitl(bound_prompts(spark, sf)).select("request_id", "hitl_trigger")


@query
def fairness_flag(spark, sf):
    valid, _ = guards.validate(views.prompts(spark, sf))
    columns = ["is_fair", "fairness_score", "bias_term", "fairness_reason"]
    return guards.fairness_flag(valid, views.lexicon(spark)).select("request_id", *columns)


@query
def fairness_flag_documents(spark, sf):
    docs = views.texts(spark, sf, "documents")
    return guards.fairness_flag(docs, views.lexicon(spark), "text").select("doc_id", "is_fair", "bias_term")


@query
def decide(spark, sf):
    return decisions(spark, sf).select("request_id", "tenant_id", *dec.DECISION_COLUMNS).withColumns(joined("pii_detected"))


OWN_GUARDS = (
    registered.pattern_guard("inner network", r"192\.168\.[0-9.]+", "Address of the inner network: %s", after="start"),
    registered.term_guard("contracts", ["about the contract"], "Contracts are not discussed here.", after="pii"),
    registered.term_guard("cases", ["case ", "lawsuit"], "Case named: '%s'", action=registered.REVIEW),
    registered.pattern_guard("numbers", r"report number [0-9]+", "Report named: '%s'", action=registered.FLAG),
)


@query
def decide_with_guards(spark, sf):
    """The cascade with guards of one's own at the start, after the identifiers, at the end, and one that only marks."""
    rows = dec.decide(spread(views.prompts(spark, sf)), views.policies(spark), views.lexicon(spark), own_guards=OWN_GUARDS)
    return rows.select("request_id", "tenant_id", *dec.DECISION_COLUMNS).withColumns(joined("pii_detected"))


@query
def explain(spark, sf):
    return decisions(spark, sf).select("request_id", "action", "explanation")


@query
def verify_output(spark, sf):
    return guards.verify_output(views.responses(spark, sf)).select("request_id", "output_allowed", "output_reason")


@query
def verify_output_documents(spark, sf):
    docs = views.texts(spark, sf, "documents")
    return guards.verify_output(docs, "text").select("doc_id", "output_allowed", "output_reason")


@query
def ledger_entries(spark, sf):
    return entries(spark, sf).drop("ts", "is_output")


def gated_prompts(spark, sf):
    return gate(views.prompts(spark, sf), control_log=views.view(spark, sf, views.CONTROL_LOG_SQL))


@query
def gateway_response(spark, sf):
    gated = gated_prompts(spark, sf)
    turned_away = F.col("kill_switch_active") | F.col("prompt").isNull()
    decided = dec.decide(spread(gated.filter(~turned_away)), views.policies(spark), views.lexicon(spark))
    checked = guards.verify_output(views.responses(spark, sf))
    return outcomes.gateway_response(decided, gated.filter(turned_away), checked).withColumns(joined("pii_redacted"))


@query
def sdk_result(spark, sf):
    return outcomes.library_result(decisions(spark, sf)).withColumns(joined("pii_detected"))


@query
def token_count_documents(spark, sf):
    return views.texts(spark, sf, "documents").select("doc_id", token_count(F.col("text")).alias("n_tokens"))


@query(name="token_count")
def token_count_prompts(spark, sf):
    valid, _ = guards.validate(views.prompts(spark, sf))
    return valid.select("request_id", token_count(F.col("prompt")).alias("n_tokens"))


@query
def ledger_preview_cols(spark, sf):
    return reports.ledger_preview(sealed_ledger(spark, sf))


@query
def review_item_cols(spark, sf):
    return reports.review_items(sealed_ledger(spark, sf))


@query
def forward_preview(spark, sf):
    return outcomes.forward_preview(decisions(spark, sf))


# Lookups and joins


@query
def bind_policy(spark, sf):
    policy = F.col("policy")
    return bound_prompts(spark, sf).select(
        "request_id",
        "tenant_id",
        F.size(policy["forbidden"]).alias("n_forbidden"),
        F.size(policy["triggers"]).alias("n_triggers"),
        policy["mask_pii"].alias("mask_pii"),
        policy["threshold"].alias("threshold"),
    )


@query
def kill_switch_gate(spark, sf):
    return gated_prompts(spark, sf).select("request_id", "kill_switch_active")


@query
def pair_responses(spark, sf):
    valid, _ = guards.validate(views.prompts(spark, sf))
    return lookups.pair_responses(valid, views.responses(spark, sf)).select(
        "request_id", "prompt", "output_allowed", "output_reason"
    )


@query
def pair_conversations(spark, sf):
    turns = lookups.pair_turns(views.table(spark, sf, "conversations"))
    return turns.select("conv_id", "turn", "prompt", "response", "output_allowed", "output_reason")


@query
def apply_reviews(spark, sf):
    reviewed = ledger.apply_reviews(sealed_ledger(spark, sf), views.view(spark, sf, views.REVIEWS_SQL))
    return reviewed.select("id", "request_id", "review_status", "current_hash")


@query
def duplicate_requests(spark, sf):
    batch = entries(spark, sf).withColumn("request_id", F.concat(F.lit("req-"), F.expr(f"cast(substr(request_id, 5) as long) div 2")))
    return ledger.duplicate_requests(batch, sealed_ledger(spark, sf))


@query
def chain_links(spark, sf):
    """Over the damaged ledger with copies of some rows, which fork chains or start them a second time."""
    damaged, n = damaged_ledger(spark, sf), event_no()
    copies = damaged.filter((n % 983 == 7) | ((F.col("seq") == 1) & (n % 7 == 0)))
    return ledger.chain_links(damaged.unionByName(copies.withColumn("id", F.col("id") + 1_000_000_000)))


@query
def verify_seals(spark, sf):
    """Seals of all days but the 25th, against a ledger with cut tails, a lost chain, a lost day and altered hashes."""
    whole, segment, tenant = sealed_ledger(spark, sf), F.col("segment"), F.col("tenant_id")
    seals = stage(ledger.seal_segments(whole.filter(~segment.endswith("-25"))), "seals")
    cut = (tenant == "tenant_0") & segment.endswith("-05") & (F.col("seq") > 1)
    lost = segment.endswith("-15") | ((tenant == "tenant_1") & segment.endswith("-10"))
    altered = (tenant == "tenant_2") & segment.endswith("-20")
    now = whole.filter(~(cut | lost)).withColumn("current_hash", F.when(altered, F.sha2("current_hash", 256)).otherwise(F.col("current_hash")))
    return audit.verify_seals(now, seals)


@query
def health_status(spark, sf):
    active = control.is_active(control.latest_state(views.view(spark, sf, views.CONTROL_LOG_SQL)))
    both = {"intact": sealed_ledger(spark, sf), "damaged": damaged_ledger(spark, sf)}
    intact, damaged = (audit.health_status(rows, active).withColumn("ledger", F.lit(name)) for name, rows in both.items())
    return intact.unionByName(damaged)


# Aggregations


@query
def ledger_counts(spark, sf):
    return reports.ledger_counts(sealed_ledger(spark, sf))


@query
def health_report(spark, sf):
    return reports.health_report(sealed_ledger(spark, sf))


@query
def health_report_by_tenant(spark, sf):
    return reports.health_report(sealed_ledger(spark, sf), ["tenant_id"])


@query
def verify_chain(spark, sf):
    intact, damaged = sealed_ledger(spark, sf), damaged_ledger(spark, sf)
    return (
        ledger.verify_chain(intact)
        .withColumn("ledger", F.lit("intact"))
        .unionByName(ledger.verify_chain(damaged).withColumn("ledger", F.lit("damaged")))
    )


@query
def verify_appends(spark, sf):
    """Two appends, each verified as it comes; a third run finds nothing new and reads no row."""
    path, key = work_folder(spark, "ledger"), "key of the catalog's own ledger"
    rows, runs = entries(spark, sf), []
    for half in (0, 1):
        ledger_table.ledger_append(rows.filter(event_no() % 2 == half), path, block_rows=SHORT_BLOCK)
        runs.append(verified.verify_appends(spark, path, key))
    runs.append(verified.verify_appends(spark, path, key))
    return reduce(DataFrame.unionByName, [run.withColumn("run", F.lit(n + 1)) for n, run in enumerate(runs)])


@query
def hash_uniqueness(spark, sf):
    whole = sealed_ledger(spark, sf)
    copies = damaged_ledger(spark, sf)
    return reports.hash_uniqueness(whole.unionByName(copies))


@query
def load_report(spark, sf):
    return reports.load_report(views.view(spark, sf, views.SAMPLES_SQL))


def battery_cases(spark, sf):
    """Expectations by kind of prompt: those of a masking tenant, with one kind mislabelled."""
    kind = event_no() % 16
    expected = F.when(kind.isin(1, 2, 8, 9, 10, 12), 403).when(kind == 14, 422).otherwise(200)
    return views.prompts(spark, sf).select(F.col("request_id").alias("case_id"), expected.alias("expected_status"))


@query
def red_team_cases(spark, sf):
    return reports.red_team_cases(battery_cases(spark, sf), decisions(spark, sf))


@query
def red_team_battery(spark, sf):
    return reports.red_team_battery(battery_cases(spark, sf), decisions(spark, sf))


@query
def pii_histogram(spark, sf):
    return reports.pii_histogram(decisions(spark, sf))


# Order, chains, top rows


@query
def chain_heads(spark, sf):
    return ledger.chain_heads(sealed_ledger(spark, sf))


@query
def assign_seq(spark, sf):
    return ledger.assign_seq(stage(entries(spark, sf), "entries")).select("id", "request_id", "tenant_id", "segment", "seq")


@query
def seal_ledger(spark, sf):
    return ledger.seal(entries(spark, sf))


@query
def seal_blocks(spark, sf):
    return ledger.seal(entries(spark, sf), block_rows=SHORT_BLOCK)


@query
def seal_segments(spark, sf):
    return ledger.seal_segments(sealed_ledger(spark, sf))


@query
def ledger_recent(spark, sf):
    return reports.ledger_recent(sealed_ledger(spark, sf))


@query
def review_queue(spark, sf):
    return reports.review_queue(ledger.apply_reviews(sealed_ledger(spark, sf), views.view(spark, sf, views.REVIEWS_SQL)))


@query(name="gateway_ledger")
def gateway_ledger_rows(spark, sf):
    rows = gateway_ledger(
        spread(views.prompts(spark, sf)),
        views.responses(spark, sf),
        views.policies(spark),
        views.lexicon(spark),
        control_log=views.view(spark, sf, views.CONTROL_LOG_SQL),
    )
    return ledger.seal(rows)


# Retrieval


def label_queries(spark, sf):
    """One question per label: the mean of its vectors."""
    means = retrieval.mean_vectors(views.table(spark, sf, "embeddings"), "label", "embedding")
    return means.withColumnRenamed("label", "query_id")


def vectors(spark, sf):
    return views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


@query
def cosine_topk(spark, sf):
    return retrieval.cosine_topk(label_queries(spark, sf), vectors(spark, sf), k=10)


_INDEXED: dict[tuple, str] = {}


def stored_index(spark, sf):
    """The cells and blocks of the vectors as a stored index, made once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXED:
        path, items = work_folder(spark, "cells"), vectors(spark, sf)
        ann.write_index(ann.fit_cells(items, k=10), items, path)
        _INDEXED[key] = path
    return ann.read_index(spark, _INDEXED[key])


@query
def ann_topk(spark, sf):
    return ann.ann_topk(*stored_index(spark, sf), label_queries(spark, sf), k=10)


def _nearest_documents(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    items = vectors(spark, sf).join(docs.select(F.col("doc_id").alias("item_id")), "item_id", "left_semi")
    return retrieval.passages(retrieval.cosine_topk(label_queries(spark, sf), items), docs)


@query
def retrieve_passages(spark, sf):
    return _nearest_documents(spark, sf).select("query_id", "rank", "item_id", "similarity", "text")


@query
def format_passages(spark, sf):
    ranked = _nearest_documents(spark, sf).withColumn("doc_id", F.concat(F.lit("policy_note_"), "item_id"))
    return retrieval.format_passages(label_queries(spark, sf), ranked)


def _embedded(spark, sf):
    """The documents' terms, how rare each is, and the documents' vectors."""
    counted = lexical.count_terms(views.texts(spark, sf, "documents"), "doc_id")
    rarity = lexical.fit_rarity(counted)
    return counted, rarity, lexical.embed_terms(counted, rarity, "doc_id")


@query
def embed_tfidf(spark, sf):
    counted, _, vectors = _embedded(spark, sf)
    most = F.round(F.array_max(F.transform("vector", lambda t: t["weight"])), 6)
    told = vectors.select("doc_id", F.size("vector").alias("n_features"), most.alias("most"))
    whole = counted.select("doc_id").join(told, "doc_id", "left")
    return whole.select("doc_id", F.coalesce("n_features", F.lit(0)).alias("n_features"), F.coalesce("most", F.lit(0.0)).alias("greatest_weight"))


@query
def question_passages(spark, sf):
    """The passages nearest to every benchmark text under the lexical embedding."""
    _, rarity, vectors = _embedded(spark, sf)
    asked = lexical.count_terms(views.table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id")
    questions = lexical.embed_terms(asked, rarity, "query_id")
    return lexical.lexical_topk(questions, vectors.withColumnRenamed("doc_id", "item_id"))


# Streams


def _stream_to_table(spark, stream, schema) -> DataFrame:
    path = work_folder(spark, "stream")
    jobs.run_available(stream, f"{path}-progress", path)
    return spark.read.schema(schema).parquet(path)


@query
def stream_decide(spark, sf):
    stream = jobs.stream_decide(views.prompts_stream(spark, sf), views.policies(spark), views.lexicon(spark))
    out = stream.select("request_id", "tenant_id", "action", "reason", "anonymized_prompt", "review_reason")
    return _stream_to_table(spark, out, out.schema)


@query
def stream_seal(spark, sf):
    path = work_folder(spark, "ledger")
    stream = jobs.stream_decide(views.prompts_stream(spark, sf), views.policies(spark), views.lexicon(spark))
    jobs.run_available(stream, f"{path}-progress", batch=jobs.ledger_sink(path, block_rows=SHORT_BLOCK))
    return ledger_table.ledger_scan(spark, path)


@query
def stream_dedup(spark, sf):
    stream = views.prompts_stream(spark, sf).withColumn(
        "request_id", F.concat(F.lit("req-"), F.expr("cast(substr(request_id, 5) as long) div 2"))
    )
    out = jobs.stream_dedup(stream, "7 days").select("request_id")
    return _stream_to_table(spark, out, out.schema)


@query
def stream_health(spark, sf):
    """The end of the stream is marked after the first run, so that a second one puts out the last windows."""
    end, path = work_folder(spark, "end"), work_folder(spark, "stream")
    stream = jobs.stream_decide(views.prompts_stream(spark, sf), views.policies(spark), views.lexicon(spark))
    out = jobs.stream_health(jobs.with_end(stream, end), width="1 hour", delay="1 minute")
    jobs.run_available(out, f"{path}-progress", path)
    jobs.mark_end(spark, end)
    jobs.run_available(out, f"{path}-progress", path)
    stamps = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")}
    return spark.read.schema(out.schema).parquet(path).withColumns(stamps)


@query
def stream_kill_switch(spark, sf):
    """Two runs over the same stream: the switch on, which leaves no trace, then off."""
    path = work_folder(spark, "ledger")
    for active in (True, False):
        state = work_folder(spark, "state")
        spark.range(1).select(F.lit(active).alias("kill_switch_active")).write.json(state)
        sink = jobs.gateway_sink(path, state, views.policies(spark), views.lexicon(spark))
        jobs.run_available(views.prompts_stream(spark, sf), f"{path}-progress-{active}", batch=sink)
    return ledger_table.ledger_scan(spark, path).select("request_id", "tenant_id", "action_taken", "review_status")

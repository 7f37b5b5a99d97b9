"""Requests, responses and their surroundings, derived from the driver's tables.

The tables hold no forbidden or human-review terms, so prompts are made from ``events``: each
row of it becomes a request. The SQL is read by Spark and by DuckDB alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.sources.policies import bias_lexicon, load_policy
from wardline.sources.requests import load_requests

PROMPTS_SQL = """
SELECT event_id, concat('req-', CAST(event_id AS STRING)) AS request_id,
       concat('tenant_', CAST(user_id % 4 AS STRING)) AS tenant_id, ts,
       CASE CAST(event_id % 16 AS INT)
         WHEN 0 THEN concat('Summarise governance report number ', CAST(event_id AS STRING))
         WHEN 1 THEN concat('Deploy MALWARE payload number ', CAST(event_id AS STRING))
         WHEN 2 THEN 'jailbraek'
         WHEN 3 THEN concat('Contact user', CAST(user_id AS STRING), '@example.com about the contract.')
         WHEN 4 THEN concat('Call 555-867-', CAST(1000 + user_id % 9000 AS STRING), ' or email hr@company.com about SSN 123-45-6789')
         WHEN 5 THEN 'My card is 4111 1111 1111 1111.'
         WHEN 6 THEN 'Server is at 192.168.1.100, passport AB1234567'
         WHEN 7 THEN 'Chart for MRN 12345678, MRN: 123456789'
         WHEN 8 THEN 'I need Medical Advice and an investment advice letter'
         WHEN 9 THEN concat('Email ops@mail.internal.company.co.uk my symptoms, case ', CAST(event_id AS STRING))
         WHEN 10 THEN 'The candidate seemed bossy and hysterical in the meeting.'
         WHEN 11 THEN 'Who is to blame for the suburban report?'
         WHEN 12 THEN 'bossy malware writer, reach ceo@corp.com'
         WHEN 13 THEN ''
         WHEN 14 THEN CAST(NULL AS STRING)
         ELSE 'Great AI governance report! Olé, 请告诉我'
       END AS prompt
FROM events
"""

# Every document answers its share of the requests.
RESPONSES_SQL = """
SELECT concat('req-', CAST(e.event_id AS STRING)) AS request_id, d.text AS response
FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)
"""

# The switch is thrown at the first error of an even day and released at that of an odd day.
CONTROL_LOG_SQL = """
SELECT min(ts) AS ts, day(CAST(ts AS DATE)) % 2 = 0 AS active
FROM events WHERE event_type = 'error' GROUP BY CAST(ts AS DATE)
"""

# Reviews of most requests, second thoughts on some, and reviews of requests nobody made.
REVIEWS_SQL = """
SELECT concat('req-', CAST(event_id AS STRING)) AS request_id,
       CASE WHEN event_type IN ('view', 'signup') THEN 'APPROVED' ELSE 'REJECTED' END AS new_status, ts AS decided_at
FROM events WHERE event_type <> 'error'
UNION ALL
SELECT concat('req-', CAST(event_id AS STRING)), 'REJECTED', ts + INTERVAL 1 HOUR FROM events WHERE event_type = 'view'
UNION ALL
SELECT concat('ghost-', CAST(event_id AS STRING)), 'APPROVED', ts FROM events WHERE event_type = 'error'
"""

# Terms of the policy, cut, lengthened, garbled and turned by up to six characters: some ratios are just under, at
# and just over the limit (a term of nine letters without its last three has 0.8).
_TERMS = ["jailbreak", "phishing", "exploit payload", "Build a Bomb", "self-harm", "deepfake", "unauthorized access", "malware"]
SPELLINGS_SQL = f"""
SELECT event_id,
       CASE CAST(event_id % 5 AS INT)
         WHEN 0 THEN substr(term, 1, CAST(length(term) - n AS INT))
         WHEN 1 THEN concat(substr(term, 1, n), term)
         WHEN 2 THEN replace(term, substr(term, n + 1, 1), 'x')
         WHEN 3 THEN concat(substr(term, n + 1), substr(term, 1, n))
         ELSE concat(substr(term, 1, n), '-', substr(term, n + 2), 'é')
       END AS prompt
FROM (
  SELECT event_id, CAST(user_id % 7 AS INT) AS n,
         CASE CAST(event_id % {len(_TERMS)} AS INT) {" ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_TERMS))} END AS term
  FROM events) spelled
"""

SAMPLES_SQL = """
SELECT CAST(CAST(ts AS DATE) AS STRING) AS run,
       CASE event_type WHEN 'signup' THEN 403 WHEN 'error' THEN 500 WHEN 'purchase' THEN 503 ELSE 200 END AS status,
       value AS latency_ms, ts
FROM events
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are expensive to work on."""
    return table(spark, sf_dir, name)


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the views above, over the tables in ``sf_dir``."""
    names = [name for name in ("events", "documents") if name in sql]
    return spark.sql(_with_placeholders(sql, names), **{name: table(spark, sf_dir, name) for name in names})


def _with_placeholders(sql: str, names: list[str]) -> str:
    for name in names:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return sql


def _requests(rows: DataFrame) -> DataFrame:
    return rows.select("request_id", "tenant_id", F.col("ts").cast("timestamp").alias("ts"), "prompt")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = texts(spark, sf_dir, "events")
    return _requests(spark.sql(_with_placeholders(PROMPTS_SQL, ["events"]), events=events))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The number of documents comes from the file footers.
    n = table(spark, sf_dir, "documents").count()
    sql = _with_placeholders(RESPONSES_SQL.replace("(SELECT count(*) FROM documents)", str(n)), ["events", "documents"])
    return spark.sql(sql, events=table(spark, sf_dir, "events"), documents=texts(spark, sf_dir, "documents"))


def prompts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts as a stream over the files of ``events``."""
    events = load_requests(
        spark, f"{sf_dir.rstrip('/')}/events*.parquet", streaming=True, schema=table(spark, sf_dir, "events").schema
    )
    return _requests(spark.sql(_with_placeholders(PROMPTS_SQL, ["events"]), events=events))


def policies(spark: SparkSession) -> DataFrame:
    """The baseline for tenants 0 to 3; tenant 3 does not allow masking."""
    tenants = F.explode(F.array(*[F.lit(f"tenant_{i}") for i in range(4)]))
    per_tenant = load_policy(spark).withColumn("tenant_id", tenants)
    return per_tenant.withColumn("enforce_pii_masking", F.col("tenant_id") != "tenant_3")


def lexicon(spark: SparkSession) -> DataFrame:
    return bias_lexicon(spark)

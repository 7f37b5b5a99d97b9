"""For each named query the same result in plain SQL over the driver's tables."""

from __future__ import annotations

import json

from wardline import config
from wardline.catalog.queries import SHORT_BLOCK
from wardline.catalog.views import CONTROL_LOG_SQL, PROMPTS_SQL, RESPONSES_SQL, REVIEWS_SQL, SAMPLES_SQL, SPELLINGS_SQL
from wardline.functions.pii import PII_PATTERNS
from wardline.operators import decide as dec
from wardline.operators import guards, outcomes, retrieval
from wardline.operators.ledger import BLOCK_ROWS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_quoted(v) for v in values) + "]"


with open(config.BASELINE_POLICY) as _f:
    _POLICY = json.load(_f)
with open(config.BIAS_LEXICON) as _f:
    _LEXICON = {k: v for k, v in json.load(_f).items() if k != "bias_lexicon_metadata"}

_TOKENS = _POLICY["security_rules"]["block_forbidden_tokens"]
_TRIGGERS = _POLICY["security_rules"]["hitl_triggers"]
_TERMS = sorted({term.split(" (")[0].lower() for terms in _LEXICON.values() for term in terms})
_TOKEN_REASON = _quoted(_POLICY["fallbacks"]["token_violation"])
_PII_REASON = _quoted(_POLICY["fallbacks"]["pii_violation"])


def _percent_s(template: str, value: str) -> str:
    before, after = template.split("%s")
    return f"concat({_quoted(before)}, {value}, {_quoted(after)})"


def _first(text: str, terms) -> str:
    return f"list_filter({_list(terms)}, lambda t: contains({text}, t))[1]"


def _masked(source: str, key: str, text: str, keep: str = "") -> str:
    """CTEs m0..m7 over ``source`` and ``masked`` with ``clean`` and the list ``types``."""
    ctes = [f"m0 AS (SELECT {key}{keep}, {text} AS t0 FROM {source})"]
    for i, p in enumerate(PII_PATTERNS):
        ctes.append(
            f"m{i + 1} AS (SELECT *, regexp_replace(t{i}, {_quoted(p.regex)}, '<{p.type}>', 'g') AS t{i + 1} FROM m{i})"
        )
    n = len(PII_PATTERNS)
    types = ", ".join(f"CASE WHEN t{i + 1} <> t{i} THEN '{p.type}' END" for i, p in enumerate(PII_PATTERNS))
    ctes.append(
        f"masked AS (SELECT {key}{keep}, t0, t{n} AS clean,"
        f" list_filter([{types}], lambda x: x IS NOT NULL) AS types FROM m{n})"
    )
    return ", ".join(ctes)


def _detected(text: str) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({text}, {_quoted(p.regex)}) THEN '{p.type}' END" for p in PII_PATTERNS)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def _joined(column: str) -> str:
    return f"array_to_string({column}, ',')"


_PROMPTS = f"prompts AS ({PROMPTS_SQL})"
_VALID = f"{_PROMPTS}, valid AS (SELECT *, lower(prompt) AS lp FROM prompts WHERE prompt IS NOT NULL)"
_RESPONSES = f"responses AS ({RESPONSES_SQL})"

_OUTPUT_REASON = (
    f"CASE WHEN len(types) > 0 THEN {_percent_s(guards.OUTPUT_BLOCKED, 'array_to_string(types, chr(44) || chr(32))')}"
    f" ELSE {_quoted(guards.OUTPUT_CLEAN)} END"
)
def _candidate(text: str) -> str:
    """The text if any term shares enough characters with it to reach the ratio, else null."""
    shared = (
        f"list_sum(list_transform(list_distinct(string_split(t, '')), lambda c:"
        f" least(len(t) - len(replace(t, c, '')), len({text}) - len(replace({text}, c, '')))))"
    )
    near = (
        f"5 * least(len(t), len({text})) > 2 * (len(t) + len({text}))"
        f" AND 5 * {shared} > 2 * (len(t) + len({text}))"
    )
    short = f"len({text}) < {1.5 * max(map(len, _TOKENS))}"
    return f"CASE WHEN {short} THEN CASE WHEN len(list_filter({_list(_TOKENS)}, lambda t: {near})) > 0 THEN {text} END END"


def _block(a: str, b: str) -> str:
    """The longest block that both texts have, the first one of that length in ``a``, at its first place in ``b``."""
    part = f"substr({a}, i, n)"
    found = f"CASE WHEN contains({b}, {part}) THEN {{'n': n, 'i': -i, 'j': -instr({b}, {part})}} END"
    by_length = f"list_transform(range(1, len({a}) - i + 2), lambda n: {found})"
    return f"list_max(flatten(list_transform(range(1, len({a}) + 1), lambda i: {by_length})))"


def _near_texts(source: str) -> str:
    """CTEs over the texts ``lp`` of ``source``, down to ``near``, those whose ratio with a term is above 4/5.

    The ratio counts the characters of the longest common block and, in the same way, of what lies left and
    right of it in both.
    """
    left = "{'a': substr(a, 1, -k.i - 1), 'b': substr(b, 1, -k.j - 1)}"
    right = "{'a': substr(a, -k.i + k.n), 'b': substr(b, -k.j + k.n)}"
    return f"""
candidates AS (SELECT DISTINCT {_candidate("lp")} AS lp FROM {source}),
blocks AS (
  SELECT lp, term, term AS a, lp AS b, {_block("term", "lp")} AS k
  FROM candidates, (SELECT unnest({_list(_TOKENS)}) AS term) WHERE lp IS NOT NULL
  UNION ALL
  SELECT lp, term, rest.a, rest.b, {_block("rest.a", "rest.b")}
  FROM (SELECT lp, term, unnest([{left}, {right}]) AS rest FROM blocks WHERE k IS NOT NULL)
  WHERE rest.a <> '' AND rest.b <> ''),
near AS (
  SELECT DISTINCT lp FROM (SELECT lp, term, coalesce(sum(k.n), 0) AS m FROM blocks GROUP BY lp, term)
  WHERE 5 * m > 2 * (len(term) + len(lp)))"""


_NEAR = "lp IN (SELECT lp FROM near)"
_VALID_NEAR = f"{_VALID}, {_near_texts('valid')}"

_STOPS = f"""{_VALID_NEAR},
{_masked("valid", "request_id", "prompt", ", tenant_id, ts, lp")},
stops AS (
  SELECT *, {_first("lp", _TRIGGERS)} AS hitl_trigger, {_first("lp", _TERMS)} AS term,
    CASE WHEN {_first("lp", _TOKENS)} IS NOT NULL THEN 1 WHEN {_NEAR} THEN 2
         WHEN len(types) > 0 AND tenant_id = 'tenant_3' THEN 3
         WHEN {_first("lp", _TRIGGERS)} IS NOT NULL THEN 4 ELSE 0 END AS stop
  FROM masked)"""

_EXPLAINED = f"""decisions AS (
  SELECT *,
    CASE WHEN action = 'BLOCKED' THEN concat({_percent_s(dec.EXPLAIN_BLOCKED, "reason")},
           CASE WHEN len(types) > 0 THEN {_percent_s(dec.EXPLAIN_SCRUBBED, "array_to_string(types, ', ')")} ELSE '' END)
      WHEN action = 'PENDING_HITL' THEN {_percent_s(dec.EXPLAIN_HITL, "reason")}
      WHEN requires_review THEN {_percent_s(dec.EXPLAIN_FLAGGED, "review_reason")}
      ELSE {_quoted(dec.EXPLAIN_PASSED)} END AS explanation
  FROM decided)"""

_DECISIONS = f"""
{_STOPS},
decided AS (
  SELECT request_id, tenant_id, ts, stop = 0 AS allowed,
    CASE stop WHEN 0 THEN 'PASSED' WHEN 4 THEN 'PENDING_HITL' ELSE 'BLOCKED' END AS action,
    CASE stop WHEN 1 THEN {_TOKEN_REASON} WHEN 2 THEN {_quoted(guards.SCORE_VIOLATION)} WHEN 3 THEN {_PII_REASON}
      WHEN 4 THEN {_percent_s(guards.HITL_REASON, "hitl_trigger")} ELSE {_quoted(dec.PASSED_REASON)} END AS reason,
    stop = 4 OR (stop = 0 AND term IS NOT NULL) AS requires_review,
    CASE WHEN stop = 0 AND term IS NOT NULL THEN {_percent_s(guards.UNFAIR_REASON, "term")} END AS review_reason,
    CASE WHEN stop IN (1, 2) THEN t0 ELSE clean END AS anonymized_prompt,
    CASE WHEN stop IN (1, 2) THEN [] ELSE types END AS types
  FROM stops),
{_EXPLAINED}"""

# 5 to 7: the catalog's own guards that stop a request, at the start, after the identifiers and at the end.
_INNER = r"192\.168\.[0-9.]+"
_OWN_DECISIONS = f"""
{_STOPS},
halts AS (
  SELECT *, CASE WHEN regexp_matches(t0, '{_INNER}') THEN 5 WHEN stop IN (1, 2, 3) THEN stop
    WHEN contains(lp, 'about the contract') THEN 6 WHEN stop = 4 THEN 4
    WHEN contains(lp, 'case ') OR contains(lp, 'lawsuit') THEN 7 ELSE 0 END AS halt,
    regexp_extract(t0, 'report number [0-9]+') AS report
  FROM stops),
decided AS (
  SELECT request_id, tenant_id, ts, halt = 0 AS allowed,
    CASE WHEN halt = 0 THEN 'PASSED' WHEN halt IN (4, 7) THEN 'PENDING_HITL' ELSE 'BLOCKED' END AS action,
    CASE halt WHEN 1 THEN {_TOKEN_REASON} WHEN 2 THEN {_quoted(guards.SCORE_VIOLATION)} WHEN 3 THEN {_PII_REASON}
      WHEN 4 THEN {_percent_s(guards.HITL_REASON, "hitl_trigger")}
      WHEN 5 THEN concat('Address of the inner network: ', regexp_extract(t0, '{_INNER}'))
      WHEN 6 THEN 'Contracts are not discussed here.'
      WHEN 7 THEN {_percent_s("Case named: '%s'", "CASE WHEN contains(lp, 'case ') THEN 'case ' ELSE 'lawsuit' END")}
      ELSE {_quoted(dec.PASSED_REASON)} END AS reason,
    halt IN (4, 7) OR (halt = 0 AND (term IS NOT NULL OR report <> '')) AS requires_review,
    CASE WHEN halt = 0 AND term IS NOT NULL THEN {_percent_s(guards.UNFAIR_REASON, "term")}
      WHEN halt = 0 AND report <> '' THEN {_percent_s("Report named: '%s'", "report")} END AS review_reason,
    CASE WHEN halt IN (1, 2, 5) THEN t0 ELSE clean END AS anonymized_prompt,
    CASE WHEN halt IN (1, 2, 5) THEN [] ELSE types END AS types
  FROM halts),
{_EXPLAINED}"""

_ENTRY_COLUMNS = """request_id, tenant_id, ts, false AS is_output, action AS action_taken,
    CASE WHEN allowed THEN review_reason ELSE reason END AS rule_violated,
    CASE WHEN requires_review THEN 'PENDING_REVIEW' ELSE 'CLOSED' END AS review_status"""
_ENTRIES = f"{_DECISIONS}, entries AS (SELECT {_ENTRY_COLUMNS} FROM decisions)"

_PAYLOAD = "concat(coalesce({0}.request_id, 'None'), coalesce({0}.tenant_id, 'None'), coalesce({0}.action_taken, 'None'), coalesce({0}.rule_violated, ''))"
_GENESIS = "repeat('0', 32)"
_LEDGER_COLUMNS = (
    "id, request_id, tenant_id, segment, block, seq, action_taken, rule_violated, review_status,"
    " previous_hash, current_hash"
)


def _numbered(segment: str = "strftime(ts, '%Y-%m-%d')", block_rows: int = BLOCK_ROWS, batch: str = "0", source: str = "entries") -> str:
    order = f"{batch}, ts, request_id, is_output"
    return f"""
numbered AS (
  SELECT *, (seq - 1) // {block_rows} AS block FROM (
    SELECT *, row_number() OVER (ORDER BY {order}) AS id,
      row_number() OVER (PARTITION BY tenant_id, segment ORDER BY {order}) AS seq
    FROM (SELECT *, {segment} AS segment FROM {source})))"""


_CHAIN = f"""
ledger AS (
  SELECT id, request_id, tenant_id, segment, block, seq, action_taken, rule_violated, review_status,
    {_GENESIS} AS previous_hash, sha256(concat({_PAYLOAD.format("n")}, {_GENESIS})) AS current_hash
  FROM numbered n WHERE seq = 1 OR block <> (seq - 2) // {{block_rows}}
  UNION ALL
  SELECT n.id, n.request_id, n.tenant_id, n.segment, n.block, n.seq, n.action_taken, n.rule_violated, n.review_status,
    l.current_hash, sha256(concat({_PAYLOAD.format("n")}, l.current_hash))
  FROM ledger l JOIN numbered n
    ON n.tenant_id = l.tenant_id AND n.segment = l.segment AND n.block = l.block AND n.seq = l.seq + 1)"""


def _sealed(block_rows: int = BLOCK_ROWS, segment: str = "strftime(ts, '%Y-%m-%d')", batch: str = "0", source: str = "entries") -> str:
    return f"{_numbered(segment, block_rows, batch, source)}, {_CHAIN.format(block_rows=block_rows)}"


def _sql(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select.strip()}"


_LEDGER = f"{_ENTRIES}, {_sealed()}"
_EVENT_NO = "CAST(substr(request_id, 5) AS BIGINT)"
_FORGED_HASH = f"sha256(concat({_PAYLOAD.format('d')}, previous_hash))"
_DAMAGED = f"""
{_LEDGER},
edited AS (
  SELECT * REPLACE (CASE WHEN {_EVENT_NO} % 997 = 5 OR {_EVENT_NO} % 991 = 3 THEN 'PASSED*' ELSE action_taken END AS action_taken)
  FROM ledger WHERE {_EVENT_NO} % 1009 <> 0),
damaged AS (
  SELECT * REPLACE (CASE WHEN {_EVENT_NO} % 991 = 3 THEN {_FORGED_HASH} ELSE current_hash END AS current_hash)
  FROM edited d)"""

_HEALTH = """count(*) AS total, count(*) FILTER (action_taken = 'BLOCKED') AS blocked,
  count(*) FILTER (action_taken = 'PENDING_HITL') AS hitl,
  count(*) FILTER (regexp_matches(rule_violated, '(?i)bias|fairness')) AS fairness_issues,
  round_even((count(*) - count(*) FILTER (regexp_matches(rule_violated, '(?i)bias|fairness'))) / count(*) * 100.0, 1) AS fairness_score"""

_CONTROL = f"""
control AS ({CONTROL_LOG_SQL}),
gated AS (
  SELECT p.*, coalesce(c.active, false) AS kill_switch_active
  FROM prompts p ASOF LEFT JOIN control c ON p.ts >= c.ts)"""
_CHECKED = f"""
{_RESPONSES},
typed_responses AS (SELECT request_id, response, {_detected("response")} AS types FROM responses),
checked AS (SELECT request_id, response, len(types) = 0 AS output_allowed, {_OUTPUT_REASON} AS output_reason FROM typed_responses)"""

_CASES = f"""
{_DECISIONS},
cases AS (
  SELECT request_id AS case_id, CASE WHEN event_id % 16 IN (1, 2, 8, 9, 10, 12) THEN 403
    WHEN event_id % 16 = 14 THEN 422 ELSE 200 END AS expected_status
  FROM prompts),
judged AS (
  SELECT case_id, expected_status, CASE WHEN allowed IS NULL THEN 422 WHEN allowed THEN 200 ELSE 403 END AS actual_status
  FROM cases LEFT JOIN decisions ON request_id = case_id)"""

_CENTROIDS = """
dims AS (SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding) AS x FROM embeddings),
means AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS x FROM dims GROUP BY label, dim),
questions AS (SELECT label AS query_id, list(x ORDER BY dim) AS vector FROM means GROUP BY label)"""


def _nearest(k: int, items: str) -> str:
    return f"""
{_CENTROIDS},
scored AS (
  SELECT query_id, vec_id AS item_id, round(list_cosine_similarity(vector, CAST(embedding AS DOUBLE[])), 6) AS similarity
  FROM questions, {items}),
nearest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM scored)
  WHERE rank <= {k})"""


_NEAREST_DOCUMENTS = _nearest(2, "(SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))")


_TOKEN_COUNT = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda t: t <> ''))"
_PREVIEW = """id, concat(substr(request_id, 1, 18), '...') AS request_id, tenant_id, action_taken,
  coalesce(rule_violated, '—') AS rule_violated, review_status, concat(substr(current_hash, 1, 14), '…') AS hash_preview"""
_ITEM = """id, request_id, concat(substr(request_id, 1, 22), '...') AS request_preview,
  coalesce(rule_violated, 'None') AS rule, action_taken = 'PENDING_HITL' AS is_hitl,
  CASE WHEN action_taken = 'PENDING_HITL' THEN '🛑 HITL PAUSE:' ELSE '⚠ REVIEW:' END AS label"""


def _weighed(name: str, source: str, key: str) -> str:
    """CTEs down to ``name`` with ``key, term, weight``: counts times rarity among the documents, of unit length."""
    return f"""
{name}_words AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+')) AS term FROM {source}),
{name}_raw AS (
  SELECT {key}, term, count(*) * rarity AS weight FROM {name}_words JOIN rarity USING (term) GROUP BY {key}, term, rarity),
{name} AS (SELECT {key}, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY {key})) AS weight FROM {name}_raw)"""


_RARITY = """
rarity AS (
  SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS rarity
  FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')) AS term FROM documents)
  GROUP BY term HAVING count(*) < (SELECT count(*) FROM documents))"""

_REVIEWED = f"""
{_LEDGER},
reviews AS ({REVIEWS_SQL}),
latest AS (SELECT request_id, arg_max(new_status, (decided_at, new_status)) AS new_status FROM reviews GROUP BY request_id),
reviewed AS (
  SELECT l.* REPLACE (coalesce(r.new_status, l.review_status) AS review_status)
  FROM ledger l LEFT JOIN latest r ON r.request_id = l.request_id)"""
_GATEWAY_ENTRIES = f"""
{_DECISIONS}, {_CONTROL}, {_CHECKED},
live AS (SELECT d.* FROM decisions d JOIN gated g ON g.request_id = d.request_id WHERE NOT g.kill_switch_active),
feed AS (
  SELECT {_ENTRY_COLUMNS} FROM live
  UNION ALL
  SELECT concat(request_id, '-OUT'), tenant_id, ts, true, 'BLOCKED', output_reason, 'CLOSED'
  FROM live JOIN checked USING (request_id) WHERE allowed AND NOT output_allowed)"""

_VERIFIED = """
SELECT '{0}' AS ledger, bad IS NULL AS intact,
  CASE WHEN bad IS NULL THEN -1 ELSE (SELECT count(*) FROM {1} WHERE id <= bad) END AS broken_at
FROM (SELECT min(id) AS bad FROM {1} d WHERE sha256(concat(""" + _PAYLOAD.format("d") + """, previous_hash)) <> current_hash)"""

_STATS = f"""
samples AS ({SAMPLES_SQL}),
placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY latency_ms) - 1 AS pos, count(*) OVER (PARTITION BY run) AS n FROM samples)"""

ORACLES: dict[str, str] = {
    "load_requests": _sql(_PROMPTS, "SELECT request_id, tenant_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, prompt FROM prompts"),
    "load_policy": _sql(
        _PROMPTS,
        f"""SELECT tenant_id, '{_POLICY['policy_metadata']['version']}' AS version,
          {_quoted(','.join(_POLICY['policy_metadata']['frameworks']))} AS frameworks,
          {_quoted(','.join(_TOKENS))} AS forbidden, {_quoted(','.join(_TRIGGERS))} AS triggers,
          tenant_id <> 'tenant_3' AS enforce_pii_masking, 0.8::DOUBLE AS minimum_safety_threshold,
          {_quoted(_POLICY['fallbacks']['kill_switch'])} AS kill_switch_message, count(*) AS n_requests
        FROM prompts GROUP BY tenant_id""",
    ),
    "bias_lexicon": "SELECT category, term, (SELECT count(*) FROM documents WHERE contains(lower(text), term)) AS n_docs FROM (VALUES "
    + ", ".join(f"({_quoted(c)}, {_quoted(t.split(' (')[0].lower())})" for c, ts in _LEXICON.items() for t in ts)
    + ") AS lexicon(category, term)",
    "ledger_append": _sql(
        f"{_ENTRIES}, {_sealed(SHORT_BLOCK, batch=f'{_EVENT_NO} % 2')}", f"SELECT {_LEDGER_COLUMNS} FROM ledger"
    ),
    "ledger_scan": _sql(_LEDGER, f"SELECT {_LEDGER_COLUMNS} FROM ledger"),
    "export_ledger_csv": _sql(
        _LEDGER,
        "SELECT id, request_id, tenant_id, action_taken, rule_violated, review_status, previous_hash, current_hash FROM ledger",
    ),
    "bootstrap_ledger": _sql(
        _PROMPTS,
        "SELECT count(prompt) AS first_call, 0 AS second_call, count(prompt) AS stored FROM prompts",
    ),
    "corpus_upsert_new": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN lang = 'en' THEN lower(text) ELSE text END AS text, lang FROM documents",
    "admit_pages": "SELECT page_id, substr(html, 1, 4000) AS html FROM pages WHERE len(html) > 200 AND NOT contains(url, 'example.org')",
    "control_state": "SELECT user_id, arg_max(event_type = 'error', ts) AS kill_switch_active FROM events GROUP BY user_id",
    "control_state_files": f"""
        WITH control AS ({CONTROL_LOG_SQL})
        SELECT file, CASE WHEN file = 'on' THEN (SELECT count(*) > 0 FROM control WHERE active) ELSE false END AS kill_switch_active
        FROM (VALUES ('on'), ('off'), ('broken'), ('missing')) AS files(file)""",
    "assign_request_ids": f"""
        WITH {_PROMPTS},
        digests AS (
          SELECT event_id, request_id,
            sha256(concat(length(CAST(event_id AS VARCHAR)), ':', event_id, length(tenant_id), ':', tenant_id)) AS d FROM prompts)
        SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN request_id
          ELSE concat_ws('-', substr(d, 1, 8), substr(d, 9, 4), substr(d, 13, 4), substr(d, 17, 4), substr(d, 21, 12)) END AS request_id
        FROM digests""",
    "validate_requests": _sql(_PROMPTS, "SELECT request_id, CASE WHEN prompt IS NULL THEN 422 ELSE 0 END AS status FROM prompts"),
    "guard_forbidden": _sql(_VALID, f"SELECT request_id, {_first('lp', _TOKENS)} AS forbidden_term FROM valid"),
    "safety_candidates": _sql(_VALID, f"SELECT request_id, {_candidate('lp')} AS candidate FROM valid"),
    "safety_candidates_documents": _sql(
        "docs AS (SELECT doc_id, lower(text) AS lp FROM documents)", f"SELECT doc_id, {_candidate('lp')} AS candidate FROM docs"
    ),
    "safety_score": _sql(_VALID_NEAR, f"SELECT request_id, CASE WHEN {_NEAR} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS safety_score FROM valid"),
    "safety_score_spellings": _sql(
        f"spelled AS ({SPELLINGS_SQL}), valid AS (SELECT *, lower(prompt) AS lp FROM spelled), {_near_texts('valid')}",
        f"SELECT event_id, prompt, CASE WHEN {_NEAR} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS safety_score FROM valid",
    ),
    "guard_threshold": _sql(
        _VALID_NEAR,
        f"SELECT request_id, CASE WHEN {_NEAR} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS safety_score, {_NEAR} AS below_threshold FROM valid",
    ),
    "mask_pii": _sql(
        f"{_VALID}, {_masked('valid', 'request_id', 'prompt')}",
        f"SELECT request_id, len(types) > 0 AS has_pii, clean, {_joined('types')} AS pii_types FROM masked",
    ),
    "mask_pii_documents": _sql(
        _masked("documents", "doc_id", "text"),
        f"SELECT doc_id, len(types) > 0 AS has_pii, clean, {_joined('types')} AS pii_types FROM masked",
    ),
    "mask_pii_pages": _sql(
        _masked("pages", "page_id", "html"),
        f"SELECT page_id, len(types) > 0 AS has_pii, clean, {_joined('types')} AS pii_types FROM masked",
    ),
    "detect_pii": _sql(
        f"{_VALID}, found AS (SELECT request_id, {_detected('prompt')} AS types FROM valid)",
        f"SELECT request_id, len(types) > 0 AS has_pii, {_joined('types')} AS pii_types FROM found",
    ),
    "detect_pii_documents": _sql(
        f"found AS (SELECT doc_id, {_detected('text')} AS types FROM documents)",
        f"SELECT doc_id, len(types) > 0 AS has_pii, {_joined('types')} AS pii_types FROM found",
    ),
    "detect_pii_pages": _sql(
        f"found AS (SELECT page_id, {_detected('html')} AS types FROM pages)",
        f"SELECT page_id, len(types) > 0 AS has_pii, {_joined('types')} AS pii_types FROM found",
    ),
    "guard_pii_block": _sql(
        f"{_VALID}, {_masked('valid', 'request_id', 'prompt', ', tenant_id')}",
        "SELECT request_id, clean, len(types) > 0 AND tenant_id = 'tenant_3' AS pii_blocked FROM masked",
    ),
    "guard_hitl": _sql(_VALID, f"SELECT request_id, {_first('lp', _TRIGGERS)} AS hitl_trigger FROM valid"),
    "fairness_flag": _sql(
        f"{_VALID}, found AS (SELECT request_id, {_first('lp', _TERMS)} AS term FROM valid)",
        f"""SELECT request_id, term IS NULL AS is_fair, CASE WHEN term IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fairness_score,
        term AS bias_term, CASE WHEN term IS NULL THEN {_quoted(guards.FAIR_REASON)}
        ELSE {_percent_s(guards.UNFAIR_REASON, 'term')} END AS fairness_reason FROM found""",
    ),
    "fairness_flag_documents": _sql(
        f"found AS (SELECT doc_id, {_first('lower(text)', _TERMS)} AS term FROM documents)",
        "SELECT doc_id, term IS NULL AS is_fair, term AS bias_term FROM found",
    ),
    "decide": _sql(
        _DECISIONS,
        f"""SELECT request_id, tenant_id, allowed, action, reason, requires_review, review_reason, anonymized_prompt,
        {_joined('types')} AS pii_detected, explanation FROM decisions""",
    ),
    "decide_with_guards": _sql(
        _OWN_DECISIONS,
        f"""SELECT request_id, tenant_id, allowed, action, reason, requires_review, review_reason, anonymized_prompt,
        {_joined('types')} AS pii_detected, explanation FROM decisions""",
    ),
    "explain": _sql(_DECISIONS, "SELECT request_id, action, explanation FROM decisions"),
    "verify_output": _sql(_CHECKED, "SELECT request_id, output_allowed, output_reason FROM checked"),
    "verify_output_documents": _sql(
        f"found AS (SELECT doc_id, {_detected('text')} AS types FROM documents)",
        f"SELECT doc_id, len(types) = 0 AS output_allowed, {_OUTPUT_REASON} AS output_reason FROM found",
    ),
    "ledger_entries": _sql(_ENTRIES, "SELECT request_id, tenant_id, action_taken, rule_violated, review_status FROM entries"),
    "gateway_response": _sql(
        f"{_DECISIONS}, {_CONTROL}, {_CHECKED}",
        f"""SELECT request_id, tenant_id, http_status, CASE WHEN ok THEN 'APPROVED' END AS status,
          CASE WHEN ok THEN anonymized_prompt END AS forwarded_prompt, CASE WHEN ok THEN {_joined('types')} END AS pii_redacted,
          CASE WHEN ok THEN requires_review END AS flagged_for_review, CASE WHEN ok THEN explanation END AS explanation,
          CASE WHEN http_status = 503 THEN {_quoted(outcomes.SERVICE_OFF)} WHEN http_status = 403 AND NOT allowed THEN explanation
               WHEN http_status = 403 THEN output_reason END AS detail
        FROM (SELECT *, http_status = 200 AS ok FROM (
          SELECT g.request_id, g.tenant_id, d.* EXCLUDE (request_id, tenant_id, ts), c.output_reason,
            CASE WHEN g.kill_switch_active THEN 503 WHEN g.prompt IS NULL THEN 422
                 WHEN NOT d.allowed OR NOT c.output_allowed THEN 403 ELSE 200 END AS http_status
          FROM gated g LEFT JOIN decisions d ON d.request_id = g.request_id LEFT JOIN checked c ON c.request_id = g.request_id))""",
    ),
    "sdk_result": _sql(
        _DECISIONS,
        f"""SELECT request_id, tenant_id, CASE WHEN allowed THEN 'APPROVED' ELSE 'BLOCKED' END AS status, allowed, reason,
          anonymized_prompt AS clean_prompt, {_joined('types')} AS pii_detected, requires_review AS flagged_for_review, review_reason,
          concat('[', CASE WHEN allowed THEN 'APPROVED' ELSE 'BLOCKED' END, '] ', reason,
            CASE WHEN requires_review THEN concat(' | PENDING_REVIEW: ', coalesce(review_reason, 'None')) ELSE '' END) AS line
        FROM decisions""",
    ),
    "token_count_documents": f"SELECT doc_id, {_TOKEN_COUNT.format('text')} AS n_tokens FROM documents",
    "token_count": _sql(_VALID, f"SELECT request_id, {_TOKEN_COUNT.format('prompt')} AS n_tokens FROM valid"),
    "ledger_preview_cols": _sql(_LEDGER, f"SELECT {_PREVIEW} FROM ledger"),
    "review_item_cols": _sql(_LEDGER, f"SELECT {_ITEM} FROM ledger"),
    "forward_preview": _sql(
        _DECISIONS,
        """SELECT request_id,
          substr(anonymized_prompt, 1, 80) AS preview_80, substr(anonymized_prompt, 1, 60) AS preview_60
        FROM decisions WHERE allowed""",
    ),
    "bind_policy": _sql(
        _VALID,
        f"""SELECT request_id, tenant_id, {len(_TOKENS)} AS n_forbidden, {len(_TRIGGERS)} AS n_triggers,
          tenant_id <> 'tenant_3' AS mask_pii, 0.8::DOUBLE AS threshold FROM valid""",
    ),
    "embed_tfidf": _sql(
        f"{_RARITY}, {_weighed('items', 'documents', 'doc_id')}",
        """SELECT doc_id, CAST(count(term) AS INT) AS n_features, coalesce(round(max(weight), 6), 0.0::DOUBLE) AS greatest_weight
        FROM documents LEFT JOIN items USING (doc_id) GROUP BY doc_id""",
    ),
    "question_passages": _sql(
        f"""{_RARITY}, {_weighed('items', 'documents', 'doc_id')}, {_weighed('asked', 'benchmark', 'item_id')},
        scored AS (
          SELECT a.item_id AS query_id, doc_id AS item_id, round(sum(a.weight * i.weight), 6) AS similarity
          FROM asked a JOIN items i USING (term) GROUP BY a.item_id, doc_id),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS INT) AS rank FROM scored)""",
        "SELECT * FROM ranked WHERE rank <= 2",
    ),
    "kill_switch_gate": _sql(f"{_PROMPTS}, {_CONTROL}", "SELECT request_id, kill_switch_active FROM gated"),
    "pair_responses": _sql(
        f"{_VALID}, {_CHECKED}",
        "SELECT request_id, prompt, output_allowed, output_reason FROM valid JOIN checked USING (request_id)",
    ),
    "pair_conversations": _sql(
        f"""turns AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response, {_detected('a.text')} AS types
          FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
          WHERE u.role = 'user' AND a.role = 'assistant')""",
        f"SELECT conv_id, turn, prompt, response, len(types) = 0 AS output_allowed, {_OUTPUT_REASON} AS output_reason FROM turns",
    ),
    "apply_reviews": _sql(_REVIEWED, "SELECT id, request_id, review_status, current_hash FROM reviewed"),
    "duplicate_requests": _sql(
        f"""{_ENTRIES},
        batch AS (SELECT concat('req-', CAST({_EVENT_NO} // 2 AS VARCHAR)) AS request_id, count(*) AS n FROM entries GROUP BY 1)""",
        """SELECT request_id, n AS n_in_batch, request_id IN (SELECT request_id FROM entries) AS in_ledger
        FROM batch WHERE n > 1 OR request_id IN (SELECT request_id FROM entries)""",
    ),
    "chain_links": _sql(
        f"""{_DAMAGED},
        links AS (
          SELECT * FROM damaged
          UNION ALL
          SELECT * REPLACE (id + 1000000000 AS id) FROM damaged WHERE {_EVENT_NO} % 983 = 7 OR (seq = 1 AND {_EVENT_NO} % 7 = 0)),
        parents AS (SELECT tenant_id, segment, block, current_hash AS previous_hash, min(seq) AS parent_seq FROM links GROUP BY ALL),
        judged AS (
          SELECT tenant_id, segment, block, id, seq,
            CASE WHEN previous_hash <> {_GENESIS} AND parent_seq IS NULL THEN 'orphan'
                 WHEN count(*) OVER (PARTITION BY tenant_id, segment, block, previous_hash) > 1 THEN 'fork'
                 WHEN previous_hash <> {_GENESIS} AND parent_seq + 1 <> seq THEN 'order' END AS fault
          FROM links LEFT JOIN parents USING (tenant_id, segment, block, previous_hash))""",
        "SELECT * FROM judged WHERE fault IS NOT NULL",
    ),
    "verify_seals": _sql(
        f"""{_LEDGER},
        sealed AS (
          SELECT tenant_id, concat(segment, '/', CAST(block AS VARCHAR)) AS chain, count(*) AS n, arg_max(current_hash, seq) AS head
          FROM ledger WHERE segment NOT LIKE '%-25' GROUP BY ALL),
        now AS (
          SELECT tenant_id, concat(segment, '/', CAST(block AS VARCHAR)) AS chain, count(*) AS n,
            arg_max(CASE WHEN tenant_id = 'tenant_2' AND segment LIKE '%-20' THEN sha256(current_hash) ELSE current_hash END, seq) AS head
          FROM ledger
          WHERE segment NOT LIKE '%-15' AND NOT (tenant_id = 'tenant_1' AND segment LIKE '%-10')
            AND NOT (tenant_id = 'tenant_0' AND segment LIKE '%-05' AND seq > 1)
          GROUP BY ALL)""",
        """SELECT * FROM (
          SELECT tenant_id, chain, CASE WHEN s.n IS NULL THEN 'unsealed' WHEN w.n IS NULL THEN 'lost' WHEN w.n < s.n THEN 'cut'
            WHEN w.n > s.n THEN 'grown' WHEN w.head <> s.head THEN 'changed' END AS fault
          FROM sealed s FULL JOIN now w USING (tenant_id, chain))
        WHERE fault IS NOT NULL""",
    ),
    "health_status": _sql(
        f"{_DAMAGED}, {_CONTROL.split('gated AS')[0].strip().rstrip(',')}, verified AS ("
        + _VERIFIED.format("intact", "ledger") + " UNION ALL " + _VERIFIED.format("damaged", "damaged") + ")",
        """SELECT 'ok' AS status, (SELECT coalesce(arg_max(active, ts), false) FROM control) AS kill_switch,
          CASE WHEN intact THEN 'VERIFIED' ELSE concat('BROKEN at row ', CAST(broken_at AS VARCHAR)) END AS ledger_integrity, ledger
        FROM verified""",
    ),
    "ledger_counts": _sql(
        _ENTRIES,
        """SELECT count(*) AS total, count(*) FILTER (action_taken <> 'BLOCKED') AS approved,
          count(*) FILTER (action_taken = 'BLOCKED') AS blocked,
          count(*) FILTER (review_status = 'PENDING_REVIEW') AS pending FROM entries""",
    ),
    "health_report": _sql(_ENTRIES, f"SELECT {_HEALTH} FROM entries"),
    "health_report_by_tenant": _sql(_ENTRIES, f"SELECT tenant_id, {_HEALTH} FROM entries GROUP BY tenant_id"),
    "verify_chain": _sql(_DAMAGED, _VERIFIED.format("intact", "ledger") + " UNION ALL " + _VERIFIED.format("damaged", "damaged")),
    "verify_appends": _sql(
        f"{_ENTRIES}, halves AS (SELECT {_EVENT_NO} % 2 AS half, count(*) AS n FROM entries GROUP BY 1)",
        """SELECT runs.run, CAST(half + 1 AS INTEGER) AS append_no, CASE WHEN half + 1 = runs.run THEN 'verified' ELSE 'unchanged' END AS status,
          CASE WHEN half + 1 = runs.run THEN n ELSE 0 END AS n_read, CAST(NULL AS BIGINT) AS first_bad_id
        FROM halves, (SELECT unnest([1, 2, 3]) AS run) runs WHERE half + 1 <= runs.run""",
    ),
    "hash_uniqueness": _sql(
        _DAMAGED,
        """SELECT count(*) AS total, count(DISTINCT current_hash) AS distinct_hashes
        FROM (SELECT current_hash FROM ledger UNION ALL SELECT current_hash FROM damaged)""",
    ),
    "load_report": _sql(
        _STATS,
        """SELECT run, count(*) AS n, count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1e6) AS req_per_s,
          count(*) FILTER (status = 200) AS approved, count(*) FILTER (status = 403) AS blocked,
          count(*) FILTER (status NOT IN (200, 403, 503)) AS other,
          count(*) FILTER (status = 200) / count(*) * 100 AS approved_pct,
          count(*) FILTER (status = 403) / count(*) * 100 AS blocked_pct,
          CAST(sum(CAST(latency_ms AS DECIMAL(18, 6))) AS DOUBLE) / count(latency_ms) AS mean_ms, max(latency_ms) AS max_ms,
          max(latency_ms) FILTER (pos = floor(0.95 * n)) AS p95_ms, max(latency_ms) FILTER (pos = floor(0.99 * n)) AS p99_ms,
          median(latency_ms) AS median_ms
        FROM placed GROUP BY run""",
    ),
    "red_team_cases": _sql(_CASES, "SELECT *, expected_status = actual_status AS passed FROM judged"),
    "red_team_battery": _sql(
        _CASES,
        """SELECT expected_status, actual_status, count(*) AS n_cases,
          count(*) FILTER (expected_status = actual_status) AS n_passed,
          count(*) FILTER (expected_status = 403 AND actual_status = 200) AS n_bypasses,
          count(*) FILTER (expected_status = 200 AND actual_status = 403) AS n_false_positives
        FROM judged GROUP BY ALL""",
    ),
    "pii_histogram": _sql(
        f"{_DECISIONS}, typed AS (SELECT unnest(types) AS pii_type FROM decisions)",
        "SELECT pii_type, count(*) AS n_requests FROM typed GROUP BY pii_type",
    ),
    "chain_heads": _sql(
        _LEDGER,
        """SELECT tenant_id, segment, block, count(*) AS n_rows, max(seq) AS last_seq, arg_max(current_hash, seq) AS head
        FROM ledger GROUP BY tenant_id, segment, block""",
    ),
    "assign_seq": _sql(f"{_ENTRIES}, {_numbered()}", "SELECT id, request_id, tenant_id, segment, seq FROM numbered"),
    "seal_ledger": _sql(_LEDGER, f"SELECT {_LEDGER_COLUMNS} FROM ledger"),
    "seal_blocks": _sql(f"{_ENTRIES}, {_sealed(SHORT_BLOCK)}", f"SELECT {_LEDGER_COLUMNS} FROM ledger"),
    "seal_segments": _sql(
        f"""{_LEDGER},
        heads AS (SELECT tenant_id, segment, block, count(*) AS n_rows, arg_max(current_hash, seq) AS head FROM ledger
          GROUP BY tenant_id, segment, block),
        headed AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY segment, block) AS head_no,
          concat(segment, '/', CAST(block AS VARCHAR)) AS chain FROM heads),
        seals AS (
          SELECT tenant_id, head_no, chain, n_rows, head, {_GENESIS} AS previous_seal,
            sha256(concat(chain, tenant_id, CAST(n_rows AS VARCHAR), head, {_GENESIS})) AS seal
          FROM headed WHERE head_no = 1
          UNION ALL
          SELECT h.tenant_id, h.head_no, h.chain, h.n_rows, h.head, s.seal,
            sha256(concat(h.chain, h.tenant_id, CAST(h.n_rows AS VARCHAR), h.head, s.seal))
          FROM seals s JOIN headed h ON h.tenant_id = s.tenant_id AND h.head_no = s.head_no + 1)""",
        "SELECT * FROM seals",
    ),
    "ledger_recent": _sql(_LEDGER, f"SELECT {_PREVIEW} FROM (SELECT * FROM ledger ORDER BY id DESC LIMIT 100)"),
    "review_queue": _sql(
        _REVIEWED,
        f"SELECT {_ITEM} FROM (SELECT * FROM reviewed WHERE review_status = 'PENDING_REVIEW' ORDER BY id DESC LIMIT 10)",
    ),
    "gateway_ledger": _sql(f"{_GATEWAY_ENTRIES}, {_sealed(source='feed')}", f"SELECT {_LEDGER_COLUMNS} FROM ledger"),
    "cosine_topk": _sql(_nearest(10, "embeddings"), "SELECT query_id, item_id, similarity, rank FROM nearest"),
    "retrieve_passages": _sql(
        _NEAREST_DOCUMENTS,
        "SELECT query_id, rank, item_id, similarity, text FROM nearest JOIN documents ON doc_id = item_id",
    ),
    "format_passages": _sql(
        _NEAREST_DOCUMENTS,
        f"""SELECT query_id, coalesce(string_agg(
          concat('**[POLICY NOTE ', CAST(item_id AS VARCHAR), ']**', chr(10), regexp_replace(text, '^\\s+|\\s+$', '', 'g')),
          concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank), {_quoted(retrieval.NOTHING_FOUND)}) AS answer
        FROM questions LEFT JOIN (nearest JOIN documents ON doc_id = item_id) USING (query_id) GROUP BY query_id""",
    ),
    "stream_decide": _sql(_DECISIONS, "SELECT request_id, tenant_id, action, reason, anonymized_prompt, review_reason FROM decisions"),
    "stream_seal": _sql(f"{_ENTRIES}, {_sealed(SHORT_BLOCK, segment=_quoted('b0'))}", f"SELECT {_LEDGER_COLUMNS} FROM ledger"),
    "stream_dedup": _sql(
        _PROMPTS, f"SELECT DISTINCT concat('req-', CAST({_EVENT_NO} // 2 AS VARCHAR)) AS request_id FROM prompts"
    ),
    "stream_health": _sql(
        f"{_ENTRIES}, windows AS (SELECT *, date_trunc('hour', ts) AS ws FROM entries)",
        """SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(ws + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
          tenant_id, count(*) AS total, count(*) FILTER (action_taken <> 'BLOCKED') AS approved,
          count(*) FILTER (action_taken = 'BLOCKED') AS blocked, count(*) FILTER (action_taken = 'PENDING_HITL') AS hitl,
          count(*) FILTER (review_status = 'PENDING_REVIEW') AS pending,
          count(*) FILTER (regexp_matches(rule_violated, '(?i)bias|fairness')) AS fairness_issues
        FROM windows GROUP BY ws, tenant_id""",
    ),
    "stream_kill_switch": _sql(_ENTRIES, "SELECT request_id, tenant_id, action_taken, review_status FROM entries"),
}

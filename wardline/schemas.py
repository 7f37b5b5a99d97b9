"""Row types of the tables."""

from pyspark.sql import types as T

REQUESTS = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("prompt", T.StringType()),
    ]
)

RESPONSES = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("response", T.StringType()),
    ]
)

POLICY_FILE = T.StructType(
    [
        T.StructField(
            "policy_metadata",
            T.StructType(
                [
                    T.StructField("tenant_id", T.StringType()),
                    T.StructField("version", T.StringType()),
                    T.StructField("frameworks", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField(
            "security_rules",
            T.StructType(
                [
                    T.StructField("block_forbidden_tokens", T.ArrayType(T.StringType())),
                    T.StructField("hitl_triggers", T.ArrayType(T.StringType())),
                    T.StructField("enforce_pii_masking", T.BooleanType()),
                    T.StructField("minimum_safety_threshold", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("fallbacks", T.MapType(T.StringType(), T.StringType())),
    ]
)

CONTROL_FILE = T.StructType(
    [
        T.StructField("kill_switch_active", T.BooleanType()),
        T.StructField("last_toggled_by", T.StringType()),
        T.StructField("last_toggled_at", T.StringType()),
    ]
)

# A chain is one (tenant_id, segment, block): segment is a day or a batch, block cuts a
# segment into chains of bounded length. seq counts the rows of a segment from 1.
LEDGER = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("action_taken", T.StringType()),
        T.StructField("rule_violated", T.StringType()),
        T.StructField("review_status", T.StringType()),
        T.StructField("previous_hash", T.StringType()),
        T.StructField("current_hash", T.StringType()),
    ]
)

REVIEW_DECISIONS = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("new_status", T.StringType()),
        T.StructField("decided_at", T.TimestampType()),
    ]
)

CORPUS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

# The auditors' eight columns.
AUDIT_COLUMNS = [
    "id",
    "request_id",
    "tenant_id",
    "action_taken",
    "rule_violated",
    "review_status",
    "previous_hash",
    "current_hash",
]

"""Policies and the bias lexicon as small tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import config
from wardline.functions.similarity import term_profiles
from wardline.schemas import POLICY_FILE

#: What a policy file must have for every guard to work.
REQUIRED = (
    "policy_metadata.tenant_id",
    "security_rules.block_forbidden_tokens",
    "security_rules.minimum_safety_threshold",
    "fallbacks",
    "fallbacks['token_violation']",
)
LEXICON_METADATA = "bias_lexicon_metadata"


def load_policy(spark: SparkSession, name_or_path: str = "global_baseline") -> DataFrame:
    """One row per policy of a JSON file or folder; an unknown name is taken as a path.

    A file that cannot be read as a policy is an error, and so is one that lacks what a guard
    needs: a guard without its rule would let everything pass.
    """
    path = config.POLICY_ALIASES.get(name_or_path, name_or_path)
    raw = spark.read.schema(POLICY_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    # Where identifiers are not masked they block, with a message of their own.
    blocks = F.expr("NOT security_rules.enforce_pii_masking AND fallbacks['pii_violation'] IS NULL")
    lacks = F.coalesce(
        *[F.when(F.expr(field).isNull(), F.lit(field)) for field in REQUIRED],
        F.when(blocks, F.lit("fallbacks['pii_violation']")),
    )
    error = F.raise_error(F.concat(F.lit("policy file "), F.col("_metadata.file_path"), F.lit(" lacks "), lacks))
    return raw.select(
        F.when(lacks.isNotNull(), error).otherwise(F.col("policy_metadata.tenant_id")).alias("tenant_id"),
        "policy_metadata.version",
        "policy_metadata.frameworks",
        "security_rules.block_forbidden_tokens",
        F.coalesce("security_rules.hitl_triggers", F.array().cast("array<string>")).alias("hitl_triggers"),
        F.coalesce("security_rules.enforce_pii_masking", F.lit(True)).alias("enforce_pii_masking"),
        "security_rules.minimum_safety_threshold",
        "fallbacks",
    )


def policy_structs(policies: DataFrame) -> DataFrame:
    """``(tenant_id, policy)`` with what the guards need, prepared once per policy."""
    profiles = term_profiles(F.col("block_forbidden_tokens"))
    longest = F.coalesce(
        F.array_max(F.transform("block_forbidden_tokens", lambda term: F.length(term))), F.lit(0)
    )
    rules = policies.select(
        "tenant_id",
        F.struct(
            F.col("block_forbidden_tokens").alias("forbidden"),
            profiles.alias("profiles"),
            longest.alias("longest"),
            F.col("hitl_triggers").alias("triggers"),
            F.col("enforce_pii_masking").alias("mask_pii"),
            F.col("minimum_safety_threshold").alias("threshold"),
            "fallbacks",
        ).alias("policy"),
    )
    return rules


def bias_lexicon(spark: SparkSession, path: str = config.BIAS_LEXICON) -> DataFrame:
    """Distinct ``(category, term)`` rows of a lexicon file; a missing file gives none.

    Terms are lower-cased and lose a qualifier in brackets. The metadata entry is an object,
    not a list, so values are taken as text first and parsed after it is left out.
    """
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "category string, term string")
    by_category = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("category", "terms"))
    return (
        by_category.filter(F.col("category") != LEXICON_METADATA)
        .select("category", F.explode(F.from_json("terms", "array<string>")).alias("term"))
        .select("category", F.lower(F.split_part("term", F.lit(" ("), F.lit(1))).alias("term"))
        .distinct()
    )


def lexicon_terms(lexicon: DataFrame) -> Column:
    """All terms as one sorted list, the same for every row."""
    terms = lexicon.agg(F.array_sort(F.collect_set("term"))).scalar()
    return F.coalesce(terms, F.array().cast("array<string>"))

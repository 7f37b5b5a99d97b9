"""The kill-switch flag: the current state and its history."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import config
from wardline.plans.asof import HELD, flag_at
from wardline.schemas import CONTROL_FILE


def control_state(spark: SparkSession, path: str = config.CONTROL_STATE) -> DataFrame:
    """One row ``kill_switch_active``; a missing or unreadable file means off."""
    try:
        state = spark.read.schema(CONTROL_FILE).option("multiLine", True).json(path)
    except AnalysisException:
        state = spark.createDataFrame([], CONTROL_FILE)
    return state.agg(F.coalesce(F.bool_or("kill_switch_active"), F.lit(False)).alias("kill_switch_active"))


def is_active(state: DataFrame) -> Column:
    """The flag as a constant of the plan that uses it."""
    return state.select("kill_switch_active").scalar()


def latest_state(control_log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The state after the last change, per key; of changes at one instant, on counts."""
    last = F.max(F.struct("ts", "active"))["active"]
    return control_log.groupBy(*(keys or [])).agg(F.coalesce(last, F.lit(False)).alias("kill_switch_active"))


def flag_as_of(requests: DataFrame, control_log: DataFrame, held: int = HELD) -> DataFrame:
    """Add ``kill_switch_active``: the state of the switch when each request came in.

    A change holds until the next one. A log of up to ``held`` changes is looked up by binary search, a longer one
    merged with the requests in order of time.
    """
    return flag_at(requests, control_log, "ts", "ts", "active", "kill_switch_active", held)

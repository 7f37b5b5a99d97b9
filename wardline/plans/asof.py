"""The value that holds at an instant, out of a log of changes.

A short log is sorted once and sent to every task, which looks instants up by binary search: the rows stay where
they are, and only their instants reach Python. A longer log is merged with the rows: both are range-partitioned
on the instant, each partition is passed through once in order, and what held at the end of a partition is
carried over to the next ones. Neither way has a window over the log, and a hot instant spreads over partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.session import stage

#: The most changes that are sent to every task: 9 bytes each.
HELD = 1_000_000


def instant(at: str) -> Column:
    """A timestamp as whole microseconds."""
    return F.unix_micros(F.col(f"`{at}`").cast("timestamp"))


def _looked_up(changes: DataFrame):
    """A function of an instant over the changes, which are collected: their number has been checked."""
    table = changes.orderBy("at").toArrow()
    # The last place, also known as -1, stands for the time before the first change.
    flags = np.append(table.column("flag").to_numpy(zero_copy_only=False).astype(bool), False)
    log = changes.sparkSession.sparkContext.broadcast((table.column("at").to_numpy(), flags))

    @F.pandas_udf(T.BooleanType())
    def holds(at: pd.Series) -> pd.Series:
        instants, flags = log.value
        known = at.notna().to_numpy()
        place = np.searchsorted(instants, at[known].to_numpy(np.int64), side="right") - 1
        out = np.zeros(len(at), bool)
        out[known] = flags[place]
        return pd.Series(out)

    return holds


def _passed_through(n_columns: int):
    """A function that gives each row what held before it in its partition, and ends with a row of what holds at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, schema = TaskContext.get().partitionId(), None, None
        for batch in batches:
            schema = batch.schema
            flags = batch.column(n_columns + 1)
            is_change = flags.is_valid().to_numpy(zero_copy_only=False)
            # The place of the last change up to each row; -1 stands for what held before the batch.
            last = np.maximum.accumulate(np.where(is_change, np.arange(len(is_change)), -1)) if len(is_change) else np.zeros(0, int)
            values = [*flags.to_pylist(), held]
            states = [values[k] for k in last.tolist()]
            held = states[-1] if states else held
            rows = pa.array(~is_change)
            added = [pa.array([part] * len(states), pa.int32()), pa.array(states, pa.bool_()), pa.array([False] * len(states), pa.bool_())]
            whole = pa.RecordBatch.from_arrays([*batch.columns[:n_columns], *added], names=[*schema.names[:n_columns], "__part", "__flag", "__end"])
            yield whole.filter(rows)
        if schema is not None:
            nulls = [pa.nulls(1, schema.field(k).type) for k in range(n_columns)]
            end = [pa.array([part], pa.int32()), pa.array([held], pa.bool_()), pa.array([True], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*nulls, *end], names=[*schema.names[:n_columns], "__part", "__flag", "__end"])

    return run


def _merged(rows: DataFrame, changes: DataFrame, at: str, flag: str) -> DataFrame:
    columns = rows.columns
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns]
    # A change holds for the rows of its own instant: it comes before them. Rows without an instant come first of all.
    both = rows.select("*", instant(at).alias("__at"), F.lit(None).cast("boolean").alias("__change")).unionAll(
        changes.select(*nothing, F.col("at").alias("__at"), F.col("flag").alias("__change"))
    )
    keys = [F.col("__at").asc_nulls_first(), F.col("__change").isNull(), F.col("__tie")]
    ranged = both.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    fields = [T.StructField(f.name, f.dataType, True) for f in rows.schema.fields]
    added = [T.StructField("__part", T.IntegerType()), T.StructField("__flag", T.BooleanType()), T.StructField("__end", T.BooleanType())]
    # Range bounds are sampled anew each time a plan runs, and the partitions are read twice.
    passed = stage(ranged.mapInArrow(_passed_through(len(columns)), T.StructType([*fields, *added])), "as-of")
    # One row per partition: a few thousand.
    before = Window.orderBy("__before").rowsBetween(Window.unboundedPreceding, -1)
    ends = passed.where("__end").select(F.col("__part").alias("__before"), F.col("__flag").alias("__last"))
    carried = ends.select("__before", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    joined = passed.where("NOT __end").join(carried, F.col("__part") == F.col("__before"), "left")
    state = F.coalesce("__flag", "__carried", F.lit(False))
    return joined.select(*[F.col(f"`{c}`") for c in columns], state.alias(flag))


def flag_at(rows: DataFrame, log: DataFrame, at: str, log_at: str, log_flag: str, flag: str, held: int = HELD) -> DataFrame:
    """``rows`` with ``flag``: that of the last change at or before each row's instant ``at``, false before the first one.

    Of changes at one instant, on counts; changes without an instant or a flag count for nothing, and a row without an
    instant has a false flag. A log of more than ``held`` different instants is merged instead of sent. Rows have no
    columns beginning with two bars.
    """
    told = log.select(instant(log_at).alias("at"), F.col(f"`{log_flag}`").alias("flag")).dropna()
    changes = stage(told.groupBy("at").agg(F.bool_or("flag").alias("flag")), "changes")
    if changes.count() > held:
        return _merged(rows, changes, at, flag)
    return rows.withColumn(flag, _looked_up(changes)(instant(at)))

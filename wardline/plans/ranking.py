"""Exact row numbers over a whole table, without a global or per-key window.

``row_number`` over a key puts that key's rows into one task. Here the rows are
range-partitioned on a unique sort key, which splits any key, and each row's number is its
position in its partition plus the rows in the partitions before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.session import stage


def _counted(groups: list[str]):
    """A function that adds each row's partition, its place there, and its place among its group's rows there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, seen = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            n, local = batch.num_rows, []
            for key in zip(*(batch.column(g).to_pylist() for g in groups), strict=True):
                seen[key] = seen.get(key, 0) + 1
                local.append(seen[key])
            added = [pa.array([part] * n, pa.int32()), pa.array(range(place + 1, place + n + 1), pa.int64()), pa.array(local, pa.int64())]
            place += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "__part", "__place", "__local"])

    return run


def number_rows(
    df: DataFrame,
    order: list[str],
    groups: list[str],
    index: str,
    group_index: str,
    group_ends: DataFrame | None = None,
) -> DataFrame:
    """Add ``index``, the position over the whole table, and ``group_index``, that within ``groups``.

    Both start at 1 and follow ``order``; rows alike in it come in any order, and a last sort column of distinct
    values lets them spread over partitions too. ``group_ends`` has the groups and an ``end``: numbers taken before,
    from which a group goes on. The rows are shuffled once. Places within a partition are counted while its sorted
    rows are staged, as range bounds are sampled anew each time a plan runs; the rows before each partition and
    group, one small table, are added by a join.
    """
    keys = [*order, "__tie"]
    added = [T.StructField("__part", T.IntegerType()), T.StructField("__place", T.LongType()), T.StructField("__local", T.LongType())]
    ranged = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    placed = stage(ranged.mapInArrow(_counted(groups), T.StructType([*df.schema.fields, *added])), "ranked")
    # One key for all group columns: never null, so that nulls form a group too.
    group = F.struct(*groups)

    # One row per partition and group. A hot group spans many partitions, one row in each.
    counts = stage(placed.groupBy("__part", group.alias("__group")).agg(F.count(F.lit(1)).alias("n")), "rank-counts")
    group_before = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", "__group", F.coalesce(F.sum("n").over(group_before), F.lit(0)).alias("__group_start"))
    if group_ends is not None:
        ends = group_ends.select(F.struct(*groups).alias("__group"), "end")
        starts = starts.join(ends, "__group", "left").withColumn("__group_start", F.col("__group_start") + F.coalesce("end", F.lit(0))).drop("end")
    # One row per partition: a few thousand.
    rows_before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    part_starts = counts.groupBy("__part").agg(F.sum("n").alias("n")).select("__part", F.coalesce(F.sum("n").over(rows_before), F.lit(0)).alias("__start"))
    starts = stage(starts.join(part_starts, "__part"), "rank-starts")

    # Spark broadcasts the starts where their file is small.
    return (
        placed.withColumn("__group", group)
        .join(starts, ["__part", "__group"])
        .withColumns({index: F.col("__start") + F.col("__place"), group_index: F.col("__group_start") + F.col("__local")})
        .drop("__part", "__place", "__local", "__group", "__start", "__group_start")
    )

"""Ids for requests that come without one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign_request_ids(requests: DataFrame, key: list[str], request_id: str = "request_id") -> DataFrame:
    """``requests`` with an id in every row; ids that are there stay.

    ``key`` names the columns that tell rows apart where they come from (a primary key, or a file and a
    position). The id is a digest of them in the form of a UUID: a row has the same id in every run,
    replay and engine, and no shuffle is needed. Rows alike in the whole key share an id.
    """
    # Each value has its length in front, so that different keys have different texts.
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col(k).cast("string") for k in key)]
    digest = F.sha2(F.concat(*parts), 256)
    spans = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    made = F.concat_ws("-", *[F.substring(digest, start, n) for start, n in spans])
    return requests.withColumn(request_id, F.coalesce(F.col(request_id), made))

"""Global row numbers without a one-task window.

A `row_number` over one hot group sorts that whole group in one task.  Here
rows are sorted by range over all tasks and written once; a second pass over
the written rows counts each (range, group), carries those few counts across
the ranges, and adds them to the place that a row has in its own range.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewise.session import shared_path

_PLACE_BITS = 33  # monotonically_increasing_id keeps the place inside a partition in its low bits


def numbered(df: DataFrame, order: Sequence[Column], name: str = "n", groups: Sequence[str] = ()) -> DataFrame:
    """df with the column `name`: 1, 2, ... inside each group, by `order`.

    Rows that tie in `order` get consecutive numbers in no set order, so end it
    with a tie-breaker.  Null group values form a group.  An empty df gives none."""
    spark, keys = df.sparkSession, list(groups)
    low = {c.lower() for c in df.columns}
    part, place, first, rows, carried = (_free(n, low) for n in ("part", "place", "first", "rows", "carried"))
    ranged = (df.orderBy(*[F.col(f"`{k}`").asc_nulls_first() for k in keys], *order)
              .withColumn(part, F.spark_partition_id())
              .withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << _PLACE_BITS) - 1)))
    path = shared_path(spark, f"numbering-{uuid.uuid4().hex[:12]}")
    ranged.write.parquet(path)
    laid = spark.read.schema(ranged.schema).parquet(path)
    w = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ends = (laid.groupBy(part, *keys).agg(F.min(place).alias(first), F.count("*").alias(rows))
            .withColumn(carried, F.coalesce(F.sum(rows).over(w), F.lit(0))))
    right = {c: _free("r_" + c, low) for c in (part, *keys)}
    ends = ends.select(*[F.col(c).alias(right[c]) for c in right], first, carried)
    on = F.lit(True)
    for c in right:
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(right[c]))
    return (laid.join(ends, on)
            .withColumn(name, (F.col(place) - F.col(first) + F.col(carried) + 1).cast("long"))
            .select(*[F.col(f"`{c}`") for c in df.columns], name))


def _free(name: str, low: set[str]) -> str:
    while name.lower() in low:
        name = "_" + name
    low.add(name.lower())
    return name

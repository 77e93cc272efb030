"""Places of rows in an order, without a window that brings a whole part to one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.plans.scratch import cut, free


def numbered(rows: DataFrame, part: list[str], order: list[Column], at: str, name: str = "numbered") -> DataFrame:
    """``rows`` with ``at``, their place from 0 on within their part in ``order``, as a written table. Equal rows stand in any order.

    A range exchange by part and order gives sorted runs; each run's own counts, added up before it, give its first place. Rows
    that are alike in part and order are spread by a hash of their place.
    """
    rows = cut(rows, name)
    keys = [*map(F.col, part), *order]
    runs = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*keys, F.col("_salt"))
    runs = cut(runs.sortWithinPartitions(*keys, "_salt").drop("_salt").withColumn("_mark", F.monotonically_increasing_id()), name)
    run = F.shiftright("_mark", 33)
    counts = runs.groupBy(*part, run.alias("_run")).agg(F.min("_mark").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*part).orderBy("_run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")
    starts = counts.select(*[F.col(p).alias(f"_{p}") for p in part], "_run", (before - F.col("_first")).alias("_shift"))
    same = reduce(Column.__and__, [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in part], run == F.col("_run"))
    out = cut(runs.join(starts, same).withColumn(at, F.col("_mark") + F.col("_shift")).drop("_run", "_shift", "_mark", *[f"_{p}" for p in part]), name)
    free(rows, runs)
    return out

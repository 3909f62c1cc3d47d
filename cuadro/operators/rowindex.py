"""Dense 0-based row position from a declared order key, without a global window.

A window ``row_number() OVER (ORDER BY k)`` without a partition moves every row into one task.
Instead, for any size and any key types:

1. the order key alone goes through ``repartitionByRange`` (Spark samples the boundaries itself; NULL,
   NaN and infinities are ordered like any value), sized to about ``rows_per_bucket`` keys a
   partition; each key keeps the id of its partition;
2. the keys are written once in the shared scratch folder, so the partition ids that the
   later steps read are the ones that were written, not those of another sampling run;
3. keys per partition id, and their running offsets: a window over the partition ids only;
4. ``row_number()`` inside each partition id, plus the offset, gives the key's position; written too;
5. the table's rows, shuffled once, get the position by a join on the key.

What is written is proportional to the keys, however wide the rows are.

The full order key must be unique for the result to be deterministic, and the same in every evaluation
of the table. If it repeats, whole rows take the place of the keys in steps 1 to 4. A leading value shared
by many rows is split when the key has more columns.
"""

from __future__ import annotations

import functools
import math
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import named
from ..session import materialise

ROWS_PER_BUCKET = 2_000_000
#: File position of a scanned row: file, byte offset of its split, row inside the split.
FILE_ORDER = ["_file", "_block", "_pos"]
_BUCKET = "__bucket"
_OFFSET = "__offset"


def number_within(df: DataFrame, bucket: list[str], order_by: list[str], name: str = "row_idx") -> DataFrame:
    """Position of each row where ``bucket`` columns (ascending) already order groups of rows.

    One count per group, a running offset over the groups, a rank inside each group. The
    offsets are one row per group; Spark joins them as their size allows.
    """
    counts = df.groupBy(*bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(bucket)],
                            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(_OFFSET))
    same = [df[c].eqNullSafe(offsets[f"__o{i}"]) for i, c in enumerate(bucket)]
    inside = Window.partitionBy(*bucket).orderBy(*[named(c).asc_nulls_first() for c in order_by])
    joined = df.join(offsets, same).drop(*[f"__o{i}" for i in range(len(bucket))])
    return joined.withColumn(name, (F.col(_OFFSET) + F.row_number().over(inside) - 1).cast("bigint")).drop(_OFFSET)


def with_row_index(df: DataFrame, order_by: list[str], name: str = "row_idx",
                   rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``name`` = 0-based dense position of each row in ``order_by`` order (ascending,
    NULLs first, NaN last).

    Rows that carry their file position need no boundaries: the splits are the buckets. Otherwise only the
    key is ranged, written and numbered; the rows get their position by a join on the key. If keys
    repeat, which that join could not tell apart, whole rows are ranged and written instead.
    """
    if order_by == FILE_ORDER:
        return number_within(df, FILE_ORDER[:2], FILE_ORDER[2:], name)
    keys = [f"__k{i}" for i in range(len(order_by))]
    slots = df.sparkSession.sparkContext.defaultParallelism
    buckets = max(math.ceil(df.count() / rows_per_bucket), slots)

    def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
        spread = rows.repartitionByRange(buckets, *[named(c).asc_nulls_first() for c in order])
        return materialise(spread.withColumn(_BUCKET, F.spark_partition_id()), "row-index")

    # equal keys share a bucket, so a key that repeats is found where the keys are numbered
    inside = Window.partitionBy(_BUCKET).orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    only = ranged(df.select(*[named(c).alias(k) for c, k in zip(order_by, keys)]), keys)
    again = F.lag(F.struct(*keys)).over(inside).eqNullSafe(F.struct(*keys))
    placed = materialise(number_within(only.withColumn("__again", again), [_BUCKET], keys, "__at").drop(_BUCKET), "row-index")
    if placed.where("__again").isEmpty():
        same = functools.reduce(and_, [named(c).eqNullSafe(F.col(k)) for c, k in zip(order_by, keys)])
        return df.join(placed.drop("__again"), same, "left").drop(*keys).withColumnRenamed("__at", name)
    return number_within(ranged(df, order_by), [_BUCKET], order_by, name).drop(_BUCKET)

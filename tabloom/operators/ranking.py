"""Ordered choices inside groups that may be of any size.

``first_rows`` and ``top_rows`` filter a ranking function by a constant, so Spark keeps at most
``n`` rows per group on the map side before it shuffles (WindowGroupLimit).  ``hash_ranked`` numbers
*every* row of a group: the group is cut into order-preserving slices that are numbered separately
and shifted by the sizes of the slices before them, so no task sorts a whole hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.sampling import unit_interval

SLICES = 4096


def top_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rn") -> DataFrame:
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def first_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return top_rows(df, group, order, 1, "_first").drop("_first")


def hash_ranked(
    df: DataFrame,
    group: Sequence[str],
    digest_col: str,
    tie: Sequence[str],
    rank: str = "rn",
    size: str = "group_rows",
    slices: int = SLICES,
) -> DataFrame:
    """Number every row of a group in digest order and add the group size.

    Digests are uniform, so equal slices of [0, 1) hold equal shares of a group.  One small histogram
    per group gives its size and the offset of every slice; rows are then numbered per slice.
    ``slices=1`` is for groups that are small by construction and needs a single shuffle.
    """
    whole = Window.partitionBy(*group)
    if slices == 1:
        return df.withColumn(rank, F.row_number().over(whole.orderBy(digest_col, *tie)).cast("long")).withColumn(
            size, F.count(F.lit(1)).over(whole)
        )
    sliced = df.withColumn("_slice", F.floor(unit_interval(F.col(digest_col)) * slices))
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    histogram = (
        sliced.groupBy(*group, "_slice")
        .agg(F.count(F.lit(1)).alias("_in_slice"))
        .withColumn(size, F.sum("_in_slice").over(whole))
        .withColumn("_before", F.coalesce(F.sum("_in_slice").over(before), F.lit(0)))
        .drop("_in_slice")
    )
    inside = Window.partitionBy(*group, "_slice").orderBy(digest_col, *tie)
    return (
        sliced.join(histogram, [*group, "_slice"])
        .withColumn(rank, F.col("_before") + F.row_number().over(inside))
        .drop("_before", "_slice")
    )


def ordered_positions(
    df: DataFrame, group: Sequence[str], order: str, digest_col: str, position: str = "position"
) -> DataFrame:
    """Positions 0.. inside a group by ``order``; equal order values follow their digest.

    Rows are numbered per (group, order value) and shifted by the number of rows before.
    """
    counts = df.groupBy(*group, order).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = hash_ranked(df, [*group, order], digest_col, [], "_rank", "_rows")
    return (
        ranked.join(offsets, [*group, order])
        .withColumn(position, F.col("_shift") + F.col("_rank") - 1)
        .drop("_shift", "_rank", "_rows")
    )

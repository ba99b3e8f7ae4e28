"""Column sets and value tuples that identify rows uniquely."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.sampling import digest, uniform
from tabloom.operators.ranking import first_rows
from tabloom.session import materialise

SUBSET_SIZES = (2, 3, 4)


def unique_combinations(df: DataFrame, columns: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Value tuples that occur exactly once, with the carried values of their only row."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return (
        df.filter(present)
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in carry])
        .filter("_n = 1")
        .drop("_n")
    )


def column_subsets(columns: Sequence[str], sizes: Sequence[int] = SUBSET_SIZES, must: str | None = None):
    """Subsets in the order they are tried: by size, then by position."""
    found = [list(c) for r in sizes for c in combinations(columns, r)]
    return [c for c in found if must is None or must in c]


def unique_key_search(
    df: DataFrame,
    columns: Sequence[str],
    group: Sequence[str] = (),
    all_columns: bool = False,
    keep: tuple[str, object] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Unique tuples of the first column subset that has any (per group).

    One pass: all subsets are grouping sets of a single aggregate, and the winning subset is an
    aggregate over its output.  ``carry`` adds the values of the only row behind each tuple, which
    saves the scan that would look them up again.
    """
    must = keep[0] if keep else None
    subsets = column_subsets(columns, (len(columns),) if all_columns else SUBSET_SIZES, must)
    keys = [*group, *columns]

    def level(subset):
        return sum(1 << (len(keys) - 1 - keys.index(c)) for c in columns if c not in subset)

    ordinal: Column = F.lit(None).cast("int")
    complete: Column = F.lit(False)
    for i, subset in enumerate(subsets):
        here = F.col("_level") == level(subset)
        ordinal = F.when(here, F.lit(i)).otherwise(ordinal)
        complete = complete | (here & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in subset]))
    unique = (
        df.groupingSets([[*group, *s] for s in subsets], *keys)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.grouping_id().alias("_level"),
            *[F.max(c).alias(c) for c in carry],
        )
        .filter((F.col("_n") == 1) & complete)
        .withColumn("subset", ordinal)
        .drop("_n", "_level")
    )
    if keep:
        unique = unique.filter(F.col(keep[0]) == F.lit(keep[1]))
    winner = unique.groupBy(*group).agg(F.min("subset").alias("subset"))
    return unique.join(winner, [*group, "subset"])


def single_values(df: DataFrame, group: Sequence[str], row_id: str, columns: Sequence[str]) -> DataFrame:
    """``(column, value)`` nodes whose value occurs in exactly one row of its group."""
    nodes = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(*group, F.col(row_id).alias("row_id"), F.explode(nodes).alias("node"))
        .groupBy(*group, F.col("node.col").alias("col"), F.col("node.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("row_id").alias("row_id"))
        .filter("_n = 1")
        .drop("_n")
    )


def bijective_pairs(singles: DataFrame, group: Sequence[str]) -> DataFrame:
    """Value pairs that determine each other.

    A value is grouped to one row in both directions only if both values occur once, in the same
    row; so the pairs are the singles of one row taken two at a time.
    """
    key = [*group, "row_id"]
    left = singles.select(*key, F.col("col").alias("col1"), F.col("value").alias("value1"))
    right = singles.select(*key, F.col("col").alias("col2"), F.col("value").alias("value2"))
    return left.join(right, key).filter("col1 < col2")


def value_clusters(singles: DataFrame, group: Sequence[str]) -> DataFrame:
    """Connected components of the bijective pairs, with their size.

    Every edge joins two singles of the same row and all singles of a row are joined, so the
    component of a node *is* its row: no iteration is needed.  A row has at most one node per
    column, which bounds each component.
    """
    sizes = singles.groupBy(*group, "row_id").agg(F.count(F.lit(1)).alias("nodes")).filter("nodes > 1")
    return singles.join(sizes, [*group, "row_id"]).withColumnRenamed("row_id", "cluster_id")


def sample_cluster(clusters: DataFrame, group: Sequence[str], seed: int) -> DataFrame:
    """One component per group, 2..size of its nodes, the first of which is asked for."""
    chosen = (
        clusters.select(*group, "cluster_id", "nodes")
        .distinct()
        .withColumn("_h", digest(seed, "cluster", *group, "cluster_id"))
    )
    chosen = first_rows(chosen, group, ["_h"]).drop("_h").withColumn(
        "wanted", F.lit(2) + F.floor(uniform(seed, "nodes", *group, "cluster_id") * (F.col("nodes") - 1))
    )
    nodes = clusters.drop("nodes").join(chosen, [*group, "cluster_id"])
    # a cluster has at most one node per column of its table
    order = Window.partitionBy(*group, "cluster_id").orderBy("_h")
    nodes = nodes.withColumn("_h", digest(seed, "node", *group, "cluster_id", "col"))
    ranked = nodes.withColumn("rn", F.row_number().over(order)).filter("rn <= wanted")
    return ranked.withColumn("is_target", F.col("rn") == 1).drop("_h", "nodes", "wanted", "rn")


def _places(columns: int, size: int) -> Column:
    """All sets of ``size`` of so many columns as places from 0, in the order of their places; one constant, however many."""
    return F.from_json(F.lit(json.dumps(list(combinations(range(columns), size)))), "array<array<int>>")


def smallest_keys(df: DataFrame, group: Sequence[str], row: str, columns: Sequence[str], least: int = 1, most: int | None = None) -> DataFrame:
    """Per group the first column set, by size and then position, that tells some row apart; for any number of columns.

    ``(group, places, row)``: one line per row with a unique tuple of that set (columns as places from 0), or one line
    with ``places`` and ``row`` NULL for a group in which no set of ``least`` to ``most`` columns has any. Tuples with a
    NULL do not count.

    Rows are counted once per distinct tuple of all columns; smaller tuples are sums over these. A size is one aggregate
    over the groups that have no key yet, which counts tuples and carries neither rows nor their names; a group leaves
    with its first key. The rows behind the keys are looked up once, at the end, for one set per group. All counts are
    pre-aggregated, so a value or a group that a third of the rows hold is nobody's whole work.
    """
    most = most or len(columns)
    key = F.struct(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.lit(0).alias("_g")).alias("_key")
    base = df.select(key, F.array(*[F.col(c).cast("string") for c in columns]).alias("_values"), F.col(row).alias("_row"))
    # a row of a tuple that others share is never shown, so any of them may stand for it
    tuples = materialise(base.groupBy("_key", "_values").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_row")), "tuples")
    left = materialise(tuples.select("_key").distinct(), "open-groups")
    values = F.transform("_places", lambda p: F.get("_values", p))
    found = []
    for size in range(least, most + 1):
        some = tuples if size == least else tuples.join(left, "_key", "left_semi")
        spread = some.select("_key", "_values", "_n", F.posexplode(_places(len(columns), size)).alias("_at", "_places"))
        spread = spread.select("_key", "_at", values.alias("_values"), "_n").where(~F.exists("_values", lambda x: x.isNull()))
        unique = spread.groupBy("_key", "_at", "_values").agg(F.sum("_n").alias("_n")).where("_n = 1")
        first = unique.groupBy("_key").agg(F.min("_at").alias("_at"))
        first = materialise(first.select("_key", F.get(_places(len(columns), size), F.col("_at")).alias("_places")), "keys")
        found.append(first)
        left = materialise(left.join(first, "_key", "left_anti"), "open-groups")
        if size == most or left.isEmpty():
            break
    every = left.select("_key", F.lit(None).cast("array<int>").alias("_places"), F.lit(None).cast(df.schema[row].dataType).alias("_row"))
    if found:
        told = tuples.join(reduce(DataFrame.unionByName, found), "_key").select("_key", "_places", values.alias("_values"), "_n", "_row")
        told = told.where(~F.exists("_values", lambda x: x.isNull())).groupBy("_key", "_places", "_values")
        told = told.agg(F.sum("_n").alias("_n"), F.min("_row").alias("_row")).where("_n = 1")
        every = told.select("_key", "_places", "_row").unionByName(every)
    return every.select(*[F.col(f"_key._g{i}").alias(c) for i, c in enumerate(group)], F.col("_places").alias("places"), F.col("_row").alias(row))

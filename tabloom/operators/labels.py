"""Gold answers of questions over uniquely identified cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.numbers import exact_avg, exact_sum, money, plain
from tabloom.functions.sampling import digest, pick, pick_int
from tabloom.operators.keys import unique_combinations
from tabloom.operators.ranking import top_rows

# Comparison operators and answer words.
COMPARISONS = [">", "<", "=", ">=", "<="]
EXTREMES = ["MAX", "MIN"]
MAX_TUPLES = 4
MULTI_METHODS = ["comparative", "superlative", "sum", "average", "percentage_change"]


def sampled_cells(
    rel: DataFrame, table: str, columns: Sequence[str], value: str, k: int, op: str, seed: int = 42
) -> DataFrame:
    """Up to ``k`` uniquely identified cells per table, numbered in their sampled order."""
    unique = unique_combinations(rel, [table, *columns], [value, "row_id"])
    unique = unique.withColumn("_h", digest(seed, op, table, *columns))
    return top_rows(unique, [table], ["_h", *columns], k).drop("_h")


def nth(value: Column | str, n: int) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.max(F.when(F.col("rn") == n, value))


def compare(op: Column, a: Column, b: Column) -> Column:
    """Three-valued: NULL when a side is missing."""
    return (
        F.when(op == ">", a > b)
        .when(op == "<", a < b)
        .when(op.isin("=", "=="), a == b)
        .when(op == ">=", a >= b)
        .when(op == "<=", a <= b)
    )


def yes_no(condition: Column) -> Column:
    return F.when(condition, "yes").when(~condition, "no")


def percentage_change(a: Column, b: Column) -> Column:
    """Change from the second to the first value; NULL on a zero base."""
    return (a - b) * F.lit(100.0) / F.nullif(b, F.lit(0.0))


def extractive(cells: DataFrame, table: str, value: str) -> DataFrame:
    return cells.filter("rn = 1").select(table, plain(F.col(value)).alias("label"))


def pair_of(cells: DataFrame, table: str, value: str) -> DataFrame:
    """First and second sampled value of a table, from one pass over the cells."""
    return (
        cells.groupBy(table)
        .agg(nth(value, 1).alias("v1"), nth(value, 2).alias("v2"), F.count(F.lit(1)).alias("_n"))
        .filter("_n >= 2")
        .drop("_n")
    )


def comparative(cells: DataFrame, table: str, value: str, seed: int = 42) -> DataFrame:
    op = pick(seed, "comparison", COMPARISONS, table)
    pairs = pair_of(cells, table, value).withColumn("op", op)
    return pairs.select(table, "op", yes_no(compare(F.col("op"), F.col("v1"), F.col("v2"))).alias("label")).filter(
        "label IS NOT NULL"
    )


def change(cells: DataFrame, table: str, value: str) -> DataFrame:
    label = plain(percentage_change(F.col("v1"), F.col("v2")))
    return pair_of(cells, table, value).select(table, label.alias("label")).filter("label IS NOT NULL")


def reduced(cells: DataFrame, table: str, value: str, method: str, seed: int = 42) -> DataFrame:
    """MAX/MIN, SUM or AVG over a random number of cells; tables with too few cells give no label."""
    low = 3 if method == "superlative" else 2
    wanted = pick_int(seed, f"{method}-size", low, MAX_TUPLES, table)
    kept = cells.withColumn("wanted", wanted).filter("rn <= wanted")
    if method == "superlative":
        aggr = pick(seed, "extreme", EXTREMES, table)
        label = F.when(aggr == "MAX", F.max(money(F.col(value)))).otherwise(F.min(money(F.col(value))))
        label = label.cast("double")
    elif method == "sum":
        label = exact_sum(F.col(value))
    else:
        label = exact_avg(F.col(value))
    return (
        kept.groupBy(table, "wanted")
        .agg(F.count(F.lit(1)).alias("_n"), label.alias("_label"))
        .filter("_n = wanted")
        .select(table, F.col("wanted").cast("long").alias("cells"), plain(F.col("_label")).alias("label"))
    )


def multitable(labels: DataFrame, sample: str, position: str, value: str, methods=MULTI_METHODS, seed: int = 42) -> DataFrame:
    """One label per sample and method from the labels of its tables.

    ``value`` is the label text; a sample with a label that is not a number is dropped, and so is
    a percentage with a zero base.  Each sample draws its comparison and its extreme, given in ``op``.
    """
    number = F.regexp_replace(F.col(value), ",", "").try_cast("double")
    numbered = labels.withColumn("_x", number)
    agg = numbered.groupBy(sample).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("_x").isNotNull()).alias("numeric"),
        F.max(F.when(F.col(position) == 0, F.col("_x"))).alias("a"),
        F.max(F.when(F.col(position) == 1, F.col("_x"))).alias("b"),
        F.max("_x").alias("hi"),
        F.min("_x").alias("lo"),
        F.sum(F.col("_x").cast("decimal(18,6)")).cast("double").alias("total"),
    )
    method = F.col("method")
    pair = F.col("n") == 2
    op = (
        F.when(method == "comparative", pick(seed, "multi-comparison", COMPARISONS, sample))
        .when(method == "superlative", pick(seed, "multi-extreme", EXTREMES, sample))
    )
    label = (
        F.when((method == "comparative") & pair, yes_no(compare(F.col("op"), F.col("a"), F.col("b"))))
        .when(method == "superlative", plain(F.when(F.col("op") == "MAX", F.col("hi")).otherwise(F.col("lo"))))
        .when(method == "sum", plain(F.col("total")))
        .when(method == "average", plain(F.col("total") / F.col("n")))
        .when((method == "percentage_change") & pair, plain(percentage_change(F.col("a"), F.col("b"))))
    )
    return (
        agg.filter("numeric")
        .withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
        .withColumn("op", op)
        .select(sample, "method", "op", label.alias("label"))
        .filter("label IS NOT NULL")
    )


def predicates(cells: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Sampled tuples as rows ``(table, branch, col, value)``."""
    parts = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns])
    return cells.select(table, F.col("rn").alias("branch"), F.explode(parts).alias("p")).select(
        table, "branch", "p.col", "p.value"
    )


def needed_mask(rel: DataFrame, preds: DataFrame, table: str, row_id: str, columns: Sequence[str]) -> DataFrame:
    """Rows that satisfy all predicates of at least one branch.

    The predicates of a branch are folded into one map so that a row meets each branch of its
    table once; a table has at most four branches.
    """
    folded = preds.groupBy(table, "branch").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("want"))
    branches = folded.groupBy(table).agg(F.collect_list("want").alias("wants"))
    have = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])
    meets = F.exists(
        "wants", lambda want: F.forall(F.map_keys(want), lambda k: F.element_at(have, k) == F.element_at(want, k))
    )
    return rel.join(branches, table, "left").withColumn("needed", F.coalesce(meets, F.lit(False))).drop("wants")

"""Views over table specs, predicate reductions and size limits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.sampling import digest
from tabloom.operators.ranking import top_rows
from tabloom.sources.tables import BLOCK_ROWS, load

# Fixed values.
PLACEHOLDER = "this value depends on the previous instruction"
MAX_TABLE_CELLS = 100


def rename_display(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns but {len(names)} display names")
    return df.toDF(*names)


def sanitize_identifiers(df: DataFrame) -> DataFrame:
    """Column names without blanks and parentheses."""
    return df.toDF(*[c.translate({ord(x): None for x in " ()"}) for c in df.columns])


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def part_specs(spark, sf_dir: str) -> DataFrame:
    """One spec row per block of parts: attributes, kinds and domains."""
    part = load(spark, sf_dir, "part")
    domain = lambda c: F.array_sort(F.collect_set(c))  # noqa: E731  a block has at most 20 rows
    return part.groupBy(F.expr(f"p_partkey div {BLOCK_ROWS}").alias("table_id")).agg(
        F.array(*[F.lit(x) for x in ("name", "brand", "type", "size", "price")]).alias("attributes"),
        F.array(*[F.lit(x) for x in ("categorical", "categorical", "categorical", "int", "float")]).alias("kinds"),
        F.lit("price").alias("value_col"),
        F.lit("name").alias("id_col"),
        F.array(F.lit("USD")).alias("units"),
        F.create_map(F.lit("USD"), F.lit(2)).alias("decimals"),
        domain("p_name").alias("name_domain"),
        domain("p_brand").alias("brand_domain"),
        domain("p_type").alias("type_domain"),
        F.min("p_size").alias("size_lo"),
        F.max("p_size").alias("size_hi"),
        F.min("p_retailprice").alias("price_lo"),
        F.max("p_retailprice").alias("price_hi"),
    )


def random_subset(values: Column, size: Column | int, seed: int, op: str, key: str) -> Column:
    """``size`` elements of an array in digest order, returned sorted."""
    tagged = F.transform(values, lambda v: F.struct(digest(seed, op, key, v).alias("h"), v.alias("v")))
    size = F.lit(size) if isinstance(size, int) else size
    kept = F.slice(F.array_sort(tagged), F.lit(1), size)
    return F.array_sort(F.transform(kept, lambda s: s["v"]))


def random_view(specs: DataFrame, width: int, seed: int) -> DataFrame:
    """``width`` attributes: value and id column, then random others; the value column is last."""
    chosen = F.filter("attributes", lambda a: ~a.isin("") & (a != F.col("value_col")) & (a != F.col("id_col")))
    added = random_subset(chosen, width - 2, seed, "view", "table_id")
    keep = lambda a: F.array_contains(added, a) | (a == F.col("id_col"))
    view = F.concat(F.filter("attributes", lambda a: keep(a) & (a != F.col("value_col"))), F.array("value_col"))
    return specs.withColumn("view_columns", view)


def fk_view(specs: DataFrame, join_col: str, used: Sequence[str], width: int, seed: int, last: bool = False) -> DataFrame:
    """Join column plus random unused non-float columns; the value column only if ``last``."""
    pairs = F.arrays_zip("attributes", "kinds")
    free = F.filter(
        pairs,
        lambda p: ~p["attributes"].isin(join_col, *used)
        & (p["attributes"] != F.col("value_col"))
        & (p["kinds"] != "float"),
    )
    names = F.transform(free, lambda p: p["attributes"])
    added = random_subset(names, width - (2 if last else 1), seed, "fk-view", "table_id")
    keep = lambda a: (
        F.array_contains(added, a) | (a == join_col) | (F.lit(last) & (a == F.col("value_col")))
    )
    return specs.withColumn("view_columns", F.filter("attributes", keep))


def sane(specs: DataFrame) -> Column:
    """Structural checks of a spec row."""
    clean = lambda c: ~F.col(c).contains(" ") & ~F.col(c).contains(",")
    return (
        (F.size("attributes") == F.size("kinds"))
        & F.array_contains("attributes", F.col("value_col"))
        & F.forall(
            F.filter("units", lambda u: u.isNotNull() & (u != "None")),
            lambda u: F.map_contains_key("decimals", u),
        )
        & clean("value_col")
        & clean("id_col")
    )


def domains_vary() -> Column:
    lists = [F.size(f"{c}_domain") > 1 for c in ("name", "brand", "type")]
    ranges = [F.col(f"{c}_lo") < F.col(f"{c}_hi") for c in ("size", "price")]
    return reduce(lambda a, b: a & b, lists + ranges)


def applicable_rules(views: DataFrame, rules: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Rules whose columns all occur in ``view_columns``; the rule list is a literal of the plan."""
    listed = F.array(
        *[F.struct(F.lit(r).alias("rule_id"), F.array(*[F.lit(c) for c in cols]).alias("cols")) for r, cols in rules]
    )
    return (
        views.withColumn("rule", F.explode(listed))
        .filter(F.size(F.array_except("rule.cols", "view_columns")) == 0)
        .withColumn("rule_id", F.col("rule.rule_id"))
        .drop("rule")
    )


def minimal_predicate(rel: DataFrame, cells: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """First subset (by size, then position) of a tuple's columns that selects one row of its table.

    Subset counts come from grouping sets; each sampled tuple then looks up its own subsets.
    """
    subsets = [list(c) for r in range(1, len(columns) + 1) for c in combinations(columns, r)]
    keys = [table, *columns]

    def tag(subset):
        parts = [F.when(F.lit(c in subset), F.col(c).cast("string")).otherwise(F.lit("\u0000")) for c in columns]
        return F.concat_ws("\u0001", *parts)

    def level(subset):
        return sum(1 << (len(keys) - 1 - keys.index(c)) for c in columns if c not in subset)

    ordinal = reduce(
        lambda acc, i: F.when(F.col("_level") == level(subsets[i]), F.lit(i)).otherwise(acc),
        range(len(subsets)),
        F.lit(None).cast("int"),
    )
    single = (
        rel.groupingSets([[table, *s] for s in subsets], *keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.grouping_id().alias("_level"))
        .filter("_n = 1")
        .withColumn("_ord", ordinal)
        .select(
            table, "_ord",
            F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]).alias("_key"),
        )
    )
    options = F.array(
        *[
            F.struct(F.lit(i).alias("_ord"), tag(s).alias("_key"), F.lit(",".join(s)).alias("columns"))
            for i, s in enumerate(subsets)
        ]
    )
    tried = cells.select(table, "row_id", F.explode(options).alias("o")).select(table, "row_id", "o.*")
    found = tried.join(single, [table, "_ord", "_key"], "left_semi")
    best = found.groupBy(table, "row_id").agg(F.min_by("columns", "_ord").alias("columns"))
    return (
        cells.select(table, "row_id")
        .join(best, [table, "row_id"], "left")
        .withColumn("columns", F.coalesce("columns", F.lit(",".join(columns))))
    )


def cap_rows(df: DataFrame, table: str, row_id: str, columns: int, cells: int = MAX_TABLE_CELLS) -> DataFrame:
    """All needed rows, filled up with others in order to ``cells / columns`` rows.

    Only the fill is ranked, and its rank is limited by a constant, so a hot table is cut on the
    map side.
    """
    limit = max(1, cells // columns)
    needed = df.filter("needed")
    fill = top_rows(df.filter(~F.col("needed")), [table], [row_id], limit, "_rn")
    must = needed.groupBy(table).agg(F.count(F.lit(1)).alias("_must"))
    fill = fill.join(must, table, "left").filter(F.col("_rn") <= limit - F.coalesce("_must", F.lit(0)))
    return needed.unionByName(fill.drop("_rn", "_must"))


def mask_dependencies(preds: DataFrame, target: str) -> DataFrame:
    """Hide the value of predicates whose column the previous step asked for."""
    depends = (F.col("branch") > 1) & (F.col("col") == target)
    return preds.withColumn("value", F.when(depends, PLACEHOLDER).otherwise(F.col("value")))

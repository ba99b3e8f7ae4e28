"""Joins between tables, between rows, and with question parts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.numbers import exact_avg, plain
from tabloom.functions.sampling import digest
from tabloom.sources.tables import load

# Fixed values.
BUNDLE_SIZES = [2, 3, 5, 10, 20]


def sales_enriched(spark, sf_dir: str) -> DataFrame:
    """Order lines with all their dimensions.  Join strategies are left to the optimizer, which
    broadcasts a dimension only while its measured size allows it."""
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    customers = (
        load(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_mktsegment", F.col("n_name").alias("customer_nation"), F.col("r_name").alias("customer_region"))
    )
    suppliers = load(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", "s_name", F.col("n_name").alias("supplier_nation")
    )
    orders = load(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return (
        load(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "o_orderstatus",
            F.date_format("o_orderdate", "yyyy-MM").alias("order_month"), "c_mktsegment", "customer_nation",
            "customer_region", "s_name", "supplier_nation", "p_name", "p_brand", "p_type",
        )
    )


def column_to_vary(rel: DataFrame, fixed: DataFrame, table: str, columns: Sequence[str], least_values: int) -> DataFrame:
    wanted = fixed.select(table, *[F.col(c).alias(f"_f_{c}") for c in columns])
    joined = rel.join(wanted, table)
    measures = [
        F.struct(
            F.lit(i).alias("pos"),
            F.lit(c).alias("col"),
            F.countDistinct(c).alias("values"),
            F.count(F.when(F.col(c) == F.col(f"_f_{c}"), 1)).alias("covered"),
        )
        for i, c in enumerate(columns)
    ]
    per_column = joined.groupBy(table).agg(F.array(*measures).alias("m")).select(table, F.explode("m").alias("m"))
    return (
        per_column.select(table, "m.*")
        .filter(F.col("values") >= least_values)
        .groupBy(table)
        .agg(F.min_by("col", F.struct(-F.col("covered"), "pos")).alias("col"), F.max("covered").alias("covered"))
    )


def inter_row_links(df: DataFrame, keys: Sequence[str], row_key: str, left: Column, right: Column) -> DataFrame:
    """Left rows linked to the first right row with equal keys; other right rows of such keys are ambiguous.

    Null keys are equal to each other. A condition that is null does not hold. One aggregate finds the first right row
    of each key, and whether any left row needs it; the selected rows meet it in one join.
    """
    sides = df.select(*keys, F.col(row_key).alias("_row"), F.coalesce(left, F.lit(False)).alias("_left"), F.coalesce(right, F.lit(False)).alias("_right"))
    sides = sides.filter("_left or _right")
    firsts = (
        sides.groupBy(*keys)
        .agg(F.min(F.when(F.col("_right"), F.col("_row"))).alias("_first"), F.bool_or("_left").alias("_wanted"))
        .filter("_wanted and _first is not null")
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first")
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    none = F.lit(None).cast(df.schema[row_key].dataType)
    roles = F.array(
        F.when(F.col("_left"), F.struct(F.col("_row").alias("left_key"), F.col("_first").alias("right_key"), F.lit("link").alias("state"))),
        F.when(
            F.col("_right") & (F.col("_row") != F.col("_first")),
            F.struct(none.alias("left_key"), F.col("_row").alias("right_key"), F.lit("ambiguous").alias("state")),
        ),
    )
    found = sides.join(firsts, same).select(F.explode(F.filter(roles, lambda r: r.isNotNull())).alias("r"))
    return found.select("r.left_key", "r.right_key", "r.state")


def fk_chain(spark, sf_dir: str, seed: int) -> DataFrame:
    """A question per region: pick a nation, then one of its customers, then average their orders."""
    regions = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nations = load(spark, sf_dir, "nation").withColumn("_h", digest(seed, "nation", "n_nationkey"))
    step1 = (
        regions.join(nations, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name")
        .agg(F.min_by(F.struct("n_nationkey", "n_name"), "_h").alias("n"))
        .select("r_name", "n.n_nationkey", "n.n_name")
    )
    customers = load(spark, sf_dir, "customer").withColumn("_h", digest(seed, "customer", "c_custkey"))
    step2 = (
        customers.join(step1, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("r_name", "n_name")
        .agg(F.min_by("c_custkey", "_h").alias("custkey"))
    )
    return (
        load(spark, sf_dir, "orders")
        .join(step2, F.col("o_custkey") == F.col("custkey"))
        .groupBy("r_name", "n_name", "custkey")
        .agg(F.count(F.lit(1)).alias("orders"), plain(exact_avg(F.col("o_totalprice"))).alias("label"))
    )


def restore_needed(cells: DataFrame, needed: DataFrame, table: str, value: str, order: str) -> DataFrame:
    original = needed.groupBy(table, "row_path", "col_path").agg(F.max_by(value, order).alias("_original"))
    return (
        cells.join(original, [table, "row_path", "col_path"], "left")
        .withColumn("value", F.coalesce("_original", "value"))
        .withColumn("needed", F.col("_original").isNotNull())
        .drop("_original")
    )


def bundles(tables: DataFrame, place: str) -> DataFrame:
    """One row per table and bundle it belongs to; the ladder is a literal, so nothing is joined."""
    sizes = F.array(*[F.lit(s) for s in BUNDLE_SIZES])
    return tables.withColumn("bundle", F.explode(F.filter(sizes, lambda s: s > F.col(place))))


def wrong_predictions(samples: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    wrong = predictions.filter(F.col("prediction") != F.col("label"))
    return samples.join(wrong, key)


def fanout(df: DataFrame, **grid: Sequence[str]) -> DataFrame:
    """Every row with every combination of the listed settings."""
    for name, values in grid.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def product_size(domains: dict[str, str]) -> Column:
    return reduce(lambda a, b: a * b, [F.size(c).cast("long") for c in domains.values()], F.lit(1))


def refused_products(specs: DataFrame, domains: dict[str, str], limit: int) -> DataFrame:
    """The specs that ``domain_product`` leaves out for a limit, with the size that is too large."""
    return specs.withColumn("combinations", product_size(domains)).filter(F.col("combinations") > limit)


def domain_product(specs: DataFrame, domains: dict[str, str], limit: int | None = None) -> DataFrame:
    """All combinations of the listed domains per spec; with a ``limit``, only of specs whose product is within it.

    ``refused_products`` lists the others.
    """
    out = specs if limit is None else specs.filter(product_size(domains) <= limit)
    for name, column in domains.items():
        out = out.withColumn(name, F.explode(column))
    return out

"""Pivot queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.functions.sampling import digest, sql_digest, sql_uniform, uniform
from tabloom.operators import pivot
from tabloom.operators.ranking import first_rows, top_rows
from tabloom.plans.catalogue import SQL_PIVOTS, full_catalog
from tabloom.plans.registry import query
from tabloom.sources.tables import SQL_ORDER_TABLES, SQL_SUPPLIER_LINES, load, order_tables, supplier_lines

ROWS = ["flag", "line_status"]
COLS = ["line"]


def text_paths(df):
    """Paths as text, for output."""
    return df.withColumn("row_path", F.array_join("row_path", "; ")).withColumn("col_path", F.array_join("col_path", "; "))


@query("pivot_first", f"""
WITH {SQL_SUPPLIER_LINES}
SELECT table_id, flag || '; ' || line_status AS row_path, CAST(line AS VARCHAR) AS col_path, min_by(price, row_key) AS value
FROM lines GROUP BY ALL
""")
def pivot_first(spark, sf_dir):
    return text_paths(
        pivot.pivot_cells(supplier_lines(spark, sf_dir), ["table_id"], ROWS, COLS, "price", "first", "row_key")
    )


@query("pivot_mean", f"""
WITH {SQL_SUPPLIER_LINES}
SELECT table_id, flag || '; ' || line_status AS row_path, CAST(line AS VARCHAR) AS col_path,
  CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(price) AS value
FROM lines GROUP BY table_id, flag, line_status, line
""")
def pivot_mean(spark, sf_dir):
    return text_paths(pivot.pivot_cells(supplier_lines(spark, sf_dir), ["table_id"], ROWS, COLS, "price", "mean"))


SQL_NEEDED = f"{sql_uniform(5, 'needed', 'row_key')} < 0.005"


def with_needed(lines):
    return lines.withColumn("needed", uniform(5, "needed", "row_key") < 0.005)


@query("pivot_max_mask", f"""
WITH {SQL_SUPPLIER_LINES}
SELECT table_id, flag || '; ' || line_status AS row_path, CAST(line AS VARCHAR) AS col_path, bool_or({SQL_NEEDED}) AS needed
FROM lines GROUP BY table_id, flag, line_status, line
""")
def pivot_max_mask(spark, sf_dir):
    marked = with_needed(supplier_lines(spark, sf_dir)).withColumn("needed", F.col("needed").cast("int"))
    cells = pivot.pivot_cells(marked, ["table_id"], ROWS, COLS, "needed", "max")
    return text_paths(cells).select("table_id", "row_path", "col_path", (F.col("value") == 1).alias("needed"))


@query("pivot_wide", """
SELECT l_returnflag AS flag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) AS f_total,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_linestatus = 'O') AS DOUBLE) AS o_total
FROM lineitem GROUP BY l_returnflag
""")
def pivot_wide(spark, sf_dir):
    """The wide form, with the header values given so that no extra pass looks them up."""
    wide = (
        load(spark, sf_dir, "lineitem")
        .withColumn("amount", F.col("l_extendedprice").cast("decimal(18,2)"))
        .groupBy(F.col("l_returnflag").alias("flag"))
        .pivot("l_linestatus", ["F", "O"])
        .agg(F.sum("amount"))
    )
    return wide.select("flag", F.col("F").cast("double").alias("f_total"), F.col("O").cast("double").alias("o_total"))


@query("pivot_reindex", f"""
WITH {SQL_SUPPLIER_LINES},
r AS (SELECT DISTINCT table_id, quantity FROM lines QUALIFY dense_rank() OVER (PARTITION BY table_id ORDER BY quantity) <= 5),
c AS (SELECT DISTINCT table_id, discount FROM lines QUALIFY dense_rank() OVER (PARTITION BY table_id ORDER BY discount) <= 5),
v AS (SELECT table_id, quantity, discount, max(price) AS value FROM lines GROUP BY ALL)
SELECT r.table_id, r.quantity, c.discount, v.value FROM r JOIN c ON r.table_id = c.table_id
LEFT JOIN v ON v.table_id = r.table_id AND v.quantity = r.quantity AND v.discount = c.discount
""")
def pivot_reindex(spark, sf_dir):
    """Selected row and column keys in full, empty where no cell exists."""
    values = supplier_lines(spark, sf_dir).groupBy("table_id", "quantity", "discount").agg(F.max("price").alias("value"))

    def smallest(key):
        kept = top_rows(values.select("table_id", key).distinct(), ["table_id"], [key], 5)
        return kept.groupBy("table_id").agg(F.collect_list(key).alias(f"{key}_keys"))

    grid = (
        smallest("quantity")
        .join(smallest("discount"), "table_id")
        .select("table_id", F.explode("quantity_keys").alias("quantity"), "discount_keys")
        .select("table_id", "quantity", F.explode("discount_keys").alias("discount"))
    )
    return grid.join(values, ["table_id", "quantity", "discount"], "left")


@query("pivot_density", f"""
WITH {SQL_SUPPLIER_LINES}
SELECT table_id, count(DISTINCT (quantity)) AS pivot_rows, count(DISTINCT (discount, flag)) AS pivot_columns,
  count(DISTINCT (quantity, discount, flag)) AS filled,
  count(DISTINCT (quantity, discount, flag)) / CAST(count(DISTINCT (quantity)) * count(DISTINCT (discount, flag)) AS DOUBLE) AS density
FROM lines GROUP BY table_id
""")
def pivot_density(spark, sf_dir):
    return pivot.density(supplier_lines(spark, sf_dir), ["table_id"], ["quantity"], ["discount", "flag"])


def sql_density(table, group, rows, cols):
    g = "".join(f"{c}, " for c in group)
    by = f"GROUP BY {', '.join(group)}" if group else ""
    r, c = ", ".join(rows), ", ".join(cols)
    return f"""SELECT {g}'{"; ".join(rows)}' AS r, '{"; ".join(cols)}' AS c, {len(rows)} AS nr, {len(cols)} AS nc,
    count(DISTINCT ({r})) AS pivot_rows, count(DISTINCT ({c})) AS pivot_columns, count(DISTINCT ({r}, {c})) AS filled
    FROM {table} {by}"""


SPLIT_ATTRIBUTES = ["status", "priority", "year"]


@query("pivot_split_search", f"""
WITH {SQL_ORDER_TABLES}, s AS ({" UNION ALL ".join(sql_density("rel", ["table_id"], r, c) for r, c in pivot.splits_of(SPLIT_ATTRIBUTES))}),
d AS (SELECT table_id, r || ' | ' || c AS layout, pivot_rows, pivot_columns, filled,
    filled / CAST(pivot_rows * pivot_columns AS DOUBLE) AS density FROM s WHERE pivot_rows > 1 AND pivot_columns > 1)
SELECT table_id, layout, pivot_rows, pivot_columns, density FROM d QUALIFY row_number() OVER (PARTITION BY table_id
  ORDER BY (filled = pivot_rows * pivot_columns) DESC, density DESC, {sql_digest(11, "split", "table_id", "layout")}) = 1
""")
def pivot_split_search(spark, sf_dir):
    return pivot.split_search(order_tables(spark, sf_dir), ["table_id"], SPLIT_ATTRIBUTES, 11)


SQL_AXES = """ax AS (SELECT l_returnflag AS flag, l_linestatus AS line_status, l_linenumber AS line,
  CAST(l_quantity AS INTEGER) AS quantity, l_tax AS tax, l_discount AS discount, l_extendedprice AS price FROM lineitem)"""

def _axes(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line_status"),
        F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"), F.col("l_extendedprice").alias("price"),
    )


SQL_ORDER = """non_nan_density DESC, total_header_levels DESC, min_header_side_levels DESC, pivot_cells DESC,
  pivot_rows DESC, pivot_columns DESC, dataset, relation, value_attribute, row_attributes, column_attributes"""


@query("sort_catalog", f"""
WITH {SQL_PIVOTS} SELECT *, row_number() OVER (ORDER BY {SQL_ORDER}) AS place FROM fullcat
""")
def sort_catalog(spark, sf_dir):
    """The 11-key order, with the place written out.

    The catalogue holds at most one row per attribute set, value and relation, a number fixed by
    the search limits and not by the data.
    """
    window = Window.orderBy(*pivot.catalog_order())
    return full_catalog(spark, sf_dir).withColumn("place", F.row_number().over(window).cast("long"))


@query("top1_per_relation", f"""
WITH {SQL_PIVOTS} SELECT dataset, relation, row_attributes, column_attributes, value_attribute, pivot_cells FROM fullcat
QUALIFY row_number() OVER (PARTITION BY dataset, relation ORDER BY {SQL_ORDER}) = 1
""")
def top1_per_relation(spark, sf_dir):
    best = first_rows(full_catalog(spark, sf_dir), ["dataset", "relation"], pivot.catalog_order())
    return best.select("dataset", "relation", "row_attributes", "column_attributes", "value_attribute", "pivot_cells")


@query("best_per_key", f"""
WITH {SQL_PIVOTS} SELECT dataset, relation, value_attribute, max((non_nan_density, total_header_levels,
  min_header_side_levels, pivot_cells, pivot_rows, pivot_columns)).pivot_cells AS pivot_cells
FROM (SELECT dataset, relation, value_attribute, non_nan_density, total_header_levels, min_header_side_levels,
  pivot_cells, pivot_rows, pivot_columns FROM fullcat) GROUP BY ALL
""".replace("max((non_nan_density, total_header_levels,\n  min_header_side_levels, pivot_cells, pivot_rows, pivot_columns)).pivot_cells",
"max({'a': non_nan_density, 'b': total_header_levels, 'c': min_header_side_levels, 'pivot_cells': pivot_cells}).pivot_cells"))
def best_per_key(spark, sf_dir):
    """The result with the highest score tuple per key."""
    score = F.struct("non_nan_density", "total_header_levels", "min_header_side_levels", "pivot_cells")
    return full_catalog(spark, sf_dir).groupBy("dataset", "relation", "value_attribute").agg(
        F.max(score)["pivot_cells"].alias("pivot_cells")
    )


@query("catalog_summary", f"""
WITH {SQL_PIVOTS} SELECT count(DISTINCT dataset) AS datasets, count(DISTINCT (dataset, relation)) AS relations,
  count(*) AS pivots FROM fullcat
""")
def catalog_summary(spark, sf_dir):
    return full_catalog(spark, sf_dir).agg(
        F.countDistinct("dataset").alias("datasets"),
        F.countDistinct("dataset", "relation").alias("relations"),
        F.count(F.lit(1)).alias("pivots"),
    )


@query("stratified_sample", f"""
WITH {SQL_SUPPLIER_LINES}
SELECT table_id, flag, row_key FROM lines QUALIFY row_number() OVER (PARTITION BY table_id, flag
  ORDER BY {sql_digest(42, "stratum", "row_key")}) <= 10
""")
def stratified_sample(spark, sf_dir):
    lines = supplier_lines(spark, sf_dir).select("table_id", "flag", "row_key")
    sampled = lines.withColumn("_h", digest(42, "stratum", "row_key"))
    return top_rows(sampled, ["table_id", "flag"], ["_h"], 10).select("table_id", "flag", "row_key")


def two_tier(catalog):
    """Large pivots of the catalogue: a strict and a loose sample per relation; a pivot may be in both."""
    keys = ["relation", "row_attributes", "column_attributes", "value_attribute"]
    catalog = catalog.withColumn("_h", digest(42, "tier", *keys))
    large = catalog.filter("pivot_rows >= 10 OR pivot_columns >= 10")
    strict = large.filter(
        "(num_row_attributes > 1 OR num_column_attributes > 1) AND pivot_rows > 3 AND pivot_columns > 3"
    )
    loose = large.filter("pivot_rows > 2 AND pivot_columns > 2")
    group = ["dataset", "relation"]
    return top_rows(strict, group, ["_h"], 10).select(keys).unionByName(top_rows(loose, group, ["_h"], 5).select(keys))


SQL_TIERS = f"""{SQL_PIVOTS}, h AS (SELECT *, {sql_digest(42, "tier", "relation", "row_attributes", "column_attributes", "value_attribute")} AS hh FROM fullcat),
tiers AS (
  SELECT relation, row_attributes, column_attributes, value_attribute FROM h
  WHERE (pivot_rows >= 10 OR pivot_columns >= 10) AND (num_row_attributes > 1 OR num_column_attributes > 1)
    AND pivot_rows > 3 AND pivot_columns > 3
  QUALIFY row_number() OVER (PARTITION BY dataset, relation ORDER BY hh) <= 10
  UNION ALL
  SELECT relation, row_attributes, column_attributes, value_attribute FROM h
  WHERE (pivot_rows >= 10 OR pivot_columns >= 10) AND pivot_rows > 2 AND pivot_columns > 2
  QUALIFY row_number() OVER (PARTITION BY dataset, relation ORDER BY hh) <= 5)"""


@query("catalog_two_tier_union", f"WITH {SQL_TIERS} SELECT * FROM tiers")
def catalog_two_tier_union(spark, sf_dir):
    return two_tier(full_catalog(spark, sf_dir))


SQL_WIDE_CELLS = f"""{SQL_SUPPLIER_LINES}, cells AS (
  SELECT table_id, CAST(quantity AS VARCHAR) AS row_path, CAST(discount AS VARCHAR) AS col_path, min_by(price, row_key) AS value,
    bool_or({SQL_NEEDED}) AS needed FROM lines GROUP BY table_id, quantity, discount)"""


def wide_cells(spark, sf_dir):
    """Pivots too large for display: 50 quantities by the discounts, with needed cells marked."""
    lines = with_needed(supplier_lines(spark, sf_dir))
    return (
        pivot.paths(lines, ["quantity"], ["discount"])
        .groupBy("table_id", "row_path", "col_path")
        .agg(F.min_by("price", "row_key").alias("value"), F.bool_or("needed").alias("needed"))
    )


def sql_side(path, source, before, seed=42):
    h = sql_digest(seed, path, "table_id", path)
    return f"""m_{path} AS (SELECT table_id, {path}, bool_or(needed) AS must FROM {source} GROUP BY table_id, {path}),
good_{path} AS (SELECT table_id FROM m_{path} GROUP BY table_id
  HAVING count(*) >= 2 AND (count(*) FILTER (WHERE must) <= 10 OR count(*) < 10)),
k_{path} AS (SELECT table_id, {path} FROM m_{path} WHERE table_id IN (SELECT table_id FROM good_{path})
  QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY must DESC, {h}) <= 10),
after_{path} AS (SELECT s.* FROM {before} s JOIN k_{path} k ON s.table_id = k.table_id AND s.{path} = k.{path})"""


def sql_shrink(seed=42):
    return f"""{sql_side("row_path", "cells", "cells", seed)}, {sql_side("col_path", "cells", "after_row_path", seed)}"""


SQL_SHRINK = f"{SQL_WIDE_CELLS}, {sql_shrink()}"


@query("shrink_pivot", f"WITH {SQL_SHRINK} SELECT table_id, row_path, col_path, value, needed FROM after_col_path")
def shrink_pivot(spark, sf_dir):
    return text_paths(pivot.shrink(wide_cells(spark, sf_dir), "table_id", 42))


@query("set_difference_keys", f"""
WITH {SQL_WIDE_CELLS},
needed_keys AS (SELECT DISTINCT table_id, row_path FROM cells WHERE needed),
all_keys AS (SELECT DISTINCT table_id, row_path FROM cells),
kept AS (SELECT * FROM all_keys INTERSECT SELECT * FROM needed_keys),
candidates AS (SELECT * FROM all_keys EXCEPT SELECT * FROM kept)
SELECT 'kept' AS part, table_id, row_path FROM kept UNION ALL SELECT 'candidate', table_id, row_path FROM candidates
""")
def set_difference_keys(spark, sf_dir):
    cells = text_paths(wide_cells(spark, sf_dir))
    part = F.when(F.bool_or(F.coalesce("needed", F.lit(False))), "kept").otherwise("candidate")
    return cells.groupBy("table_id", "row_path").agg(part.alias("part"))


@query("pair_presence", f"""
WITH {SQL_AXES}, t AS (SELECT DISTINCT flag, line_status, line, tax FROM ax WHERE price IS NOT NULL),
k AS (SELECT DISTINCT 'flag; line_status | line; tax' AS candidate, flag || '; ' || line_status AS r, line || '; ' || tax AS c FROM t
  UNION SELECT 'flag; line | line_status; tax', flag || '; ' || line, line_status || '; ' || tax FROM t
  UNION SELECT 'flag; tax | line_status; line', flag || '; ' || tax, line_status || '; ' || line FROM t)
SELECT candidate, r, c FROM k
""")
def pair_presence(spark, sf_dir):
    """Occupied (row pair, column pair) combinations of every way to split four columns."""
    axes = ["flag", "line_status", "line", "tax"]
    candidates = pivot.pair_candidates(axes)
    cells = pivot.candidate_presence(_axes(spark, sf_dir), candidates, "price")
    return cells.select(
        "candidate", F.regexp_replace("r", "\u0001", "; ").alias("r"), F.regexp_replace("c", "\u0001", "; ").alias("c")
    )


@query("dense_submatrix_trim")
def dense_submatrix_trim(spark, sf_dir):
    candidates = pivot.pair_candidates(["flag", "line", "discount", "tax"])
    cells = pivot.numbered(pivot.candidate_presence(_axes(spark, sf_dir), candidates, "price"))
    return pivot.trim_dense(cells.select("candidate", "row_id", "col_id"), "candidate", 3, 10)


SQL_CANDIDATES = " UNION ALL ".join(
    f"SELECT '{'; '.join(r)} | {'; '.join(c)}' AS candidate, count(DISTINCT ({', '.join(r)})) AS \"rows\", count(DISTINCT ({', '.join(c)})) AS cols FROM ax WHERE price IS NOT NULL"
    for r, c in pivot.pair_candidates(["flag", "line", "discount", "quantity"])
)


@query("trim_candidate_sizes", f"WITH {SQL_AXES} SELECT *, \"rows\" * cols <= {pivot.MAX_GRID_CELLS} AS fits FROM ({SQL_CANDIDATES})")
def trim_candidate_sizes(spark, sf_dir):
    """Grid of every candidate, and whether it is trimmed; those that do not fit are listed here instead of vanishing."""
    candidates = pivot.pair_candidates(["flag", "line", "discount", "quantity"])
    return pivot.candidate_sizes(pivot.candidate_presence(_axes(spark, sf_dir), candidates, "price"))


@query("densest_pivot")
def densest_pivot(spark, sf_dir):
    return pivot.densest_pivot(_axes(spark, sf_dir), ["flag", "line", "discount", "tax"], "price", 5, 10)


@query("needed_semi_join", f"""
WITH {SQL_SUPPLIER_LINES}, nl AS (SELECT *, {SQL_NEEDED} AS needed FROM lines)
SELECT row_key FROM lines l WHERE EXISTS (SELECT 1 FROM nl WHERE needed AND nl.table_id = l.table_id AND nl.quantity = l.quantity)
  AND EXISTS (SELECT 1 FROM nl WHERE needed AND nl.table_id = l.table_id AND nl.discount = l.discount)
""")
def needed_semi_join(spark, sf_dir):
    lines = with_needed(supplier_lines(spark, sf_dir))
    needed = lines.filter("needed")
    rows = needed.select("table_id", "quantity").distinct()
    cols = needed.select("table_id", "discount").distinct()
    return (
        lines.join(rows, ["table_id", "quantity"], "left_semi")
        .join(cols, ["table_id", "discount"], "left_semi")
        .select("row_key")
    )

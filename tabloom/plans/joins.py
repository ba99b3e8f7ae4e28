"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.numbers import exact_sum, money, sql_plain
from tabloom.functions.sampling import pick, sql_digest, sql_pick
from tabloom.operators import joins, labels, pivot
from tabloom.operators.views import part_specs
from tabloom.plans.labels import TUPLE, sql_cells
from tabloom.plans.pivots import COLS, ROWS, SQL_NEEDED, text_paths, with_needed
from tabloom.plans.registry import query
from tabloom.sources.tables import (
    SQL_LINE_KEY,
    SQL_ORDER_TABLES,
    SQL_SUPPLIER_LINES,
    line_key,
    load,
    order_tables,
    supplier_lines,
)


@query("star_join_enriched", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, o_orderstatus,
  strftime(o_orderdate, '%Y-%m') AS order_month, c_mktsegment, cn.n_name AS customer_nation, cr.r_name AS customer_region,
  s_name, sn.n_name AS supplier_nation, p_name, p_brand, p_type
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
JOIN region cr ON cn.n_regionkey = cr.r_regionkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation sn ON s_nationkey = sn.n_nationkey
""")
def star_join_enriched(spark, sf_dir):
    return joins.sales_enriched(spark, sf_dir)


@query("star_join_fact_dims", """
SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month, quarter(o_orderdate) AS quarter,
  dayofweek(o_orderdate) IN (0, 6) AS is_weekend, c_mktsegment, n_name, r_name, o_totalprice
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
""")
def star_join_fact_dims(spark, sf_dir):
    orders, customer = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    places = load(spark, sf_dir, "nation").join(
        load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "o_orderkey",
            F.year("o_orderdate").cast("long").alias("year"),
            F.month("o_orderdate").cast("long").alias("month"),
            F.quarter("o_orderdate").cast("long").alias("quarter"),
            F.dayofweek("o_orderdate").isin(1, 7).alias("is_weekend"),
            "c_mktsegment", "n_name", "r_name", "o_totalprice",
        )
    )


@query("left_join_view", """
SELECT n_name AS category, c_custkey, c_name, o_orderkey FROM nation
LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000
LEFT JOIN orders ON c_custkey = o_custkey JOIN region ON n_regionkey = r_regionkey
""")
def left_join_view(spark, sf_dir):
    rich = load(spark, sf_dir, "customer").filter("c_acctbal > 9000")
    return (
        load(spark, sf_dir, "nation")
        .join(rich, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .join(load(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_name").alias("category"), "c_custkey", "c_name", "o_orderkey")
    )


@query("sum_by_store", """
SELECT s_suppkey AS store_id, s_name || ',' || n_name AS store,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_sales
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL
""")
def sum_by_store(spark, sf_dir):
    """Totals per store; lines are summed per supplier before the names are joined."""
    totals = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(exact_sum(F.col("l_extendedprice")).alias("total_sales"))
    return (
        totals.join(load(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("store_id"), F.concat_ws(",", "s_name", "n_name").alias("store"), "total_sales")
    )


@query("sum_by_category", """
SELECT p_type AS category, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_sales
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type
""")
def sum_by_category(spark, sf_dir):
    """Lines are summed per part before the join, so a hot part is one row of it."""
    per_part = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum(money(F.col("l_extendedprice"))).alias("amount")
    )
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_type")
    return (
        per_part.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_type").alias("category"))
        .agg(F.sum("amount").cast("double").alias("total_sales"))
    )


@query("unused_value_anti_join", """
WITH a AS (SELECT DISTINCT p_brand AS brand FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity = 50 AND l_discount = 0.1),
b AS (SELECT DISTINCT p_brand AS brand FROM part)
SELECT brand, 'unused' AS state FROM b WHERE brand NOT IN (SELECT brand FROM a)
UNION ALL SELECT brand, 'used' FROM b WHERE brand IN (SELECT brand FROM a)
""")
def unused_value_anti_join(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    lines = load(spark, sf_dir, "lineitem").filter("l_quantity = 50 AND l_discount = 0.1")
    used = part.join(lines, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select(F.col("p_brand").alias("brand")).distinct()
    brands = part.select(F.col("p_brand").alias("brand")).distinct()
    return brands.join(used, "brand", "left_anti").withColumn("state", F.lit("unused")).unionByName(
        brands.join(used, "brand", "left_semi").withColumn("state", F.lit("used"))
    )


@query("most_frequent_new_value", f"""
WITH {SQL_ORDER_TABLES}, old AS (SELECT table_id + 1 AS table_id, status FROM rel GROUP BY ALL),
vc AS (SELECT table_id, priority, count(*) AS n FROM rel GROUP BY ALL),
prev AS (SELECT table_id + 1 AS table_id, min(priority) AS priority FROM rel GROUP BY table_id)
SELECT vc.table_id, max_by(vc.priority, (n, vc.priority)) AS priority, max(n) AS n FROM vc
WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE p.table_id = vc.table_id AND p.priority = vc.priority) GROUP BY vc.table_id
""")
def most_frequent_new_value(spark, sf_dir):
    """Most frequent value not used by the table before; ties go to the larger text."""
    rel = order_tables(spark, sf_dir)
    used = rel.groupBy((F.col("table_id") + 1).alias("table_id")).agg(F.min("priority").alias("priority"))
    counts = rel.groupBy("table_id", "priority").agg(F.count(F.lit(1)).alias("n"))
    fresh = counts.join(used, ["table_id", "priority"], "left_anti")
    return fresh.groupBy("table_id").agg(
        F.max_by("priority", F.struct("n", "priority")).alias("priority"), F.max("n").alias("n")
    )


@query("column_to_vary", f"""
WITH {sql_cells("vary", 1)}, n AS (
  SELECT r.table_id, x.col, count(DISTINCT x.v) AS d, count(*) FILTER (WHERE x.v = x.fixed) AS covered
  FROM rel r JOIN cells c ON r.table_id = c.table_id,
    LATERAL (VALUES ('status', r.status, c.status, 0), ('priority', r.priority, c.priority, 1), ('year', r.year, c.year, 2)) x(col, v, fixed, pos)
  GROUP BY r.table_id, x.col)
SELECT table_id, min_by(col, (-covered, list_position(['status','priority','year'], col))) AS col, max(covered) AS covered
FROM n WHERE d >= 3 GROUP BY table_id
""")
def column_to_vary(spark, sf_dir):
    """Column with enough values whose fixed value covers most rows."""
    rel = order_tables(spark, sf_dir)
    fixed = labels.sampled_cells(rel, "table_id", TUPLE, "price", 1, "vary")
    return joins.column_to_vary(rel, fixed, "table_id", TUPLE, least_values=3)


@query("inter_row_link", f"""
WITH lines AS (SELECT {SQL_LINE_KEY} AS row_key, l_orderkey AS k, l_linenumber AS line FROM lineitem),
m AS (SELECT row_key, k, row_number() OVER (PARTITION BY k ORDER BY row_key) AS rn FROM lines WHERE line = 2)
SELECT l.row_key AS left_key, m.row_key AS right_key, CASE WHEN m.rn = 1 THEN 'link' ELSE 'ambiguous' END AS state
FROM lines l JOIN m ON l.k = m.k WHERE l.line = 1 AND m.rn = 1
UNION ALL
SELECT NULL, m.row_key, 'ambiguous' FROM m WHERE rn > 1 AND EXISTS (SELECT 1 FROM lines l WHERE l.k = m.k AND l.line = 1)
""")
def inter_row_link(spark, sf_dir):
    """Line 1 of an order linked to its first line 2; further lines 2 are ambiguous."""
    lines = load(spark, sf_dir, "lineitem").select(
        line_key().alias("row_key"), "l_orderkey", "l_linenumber"
    )
    return joins.inter_row_links(
        lines, ["l_orderkey"], "row_key", F.col("l_linenumber") == 1, F.col("l_linenumber") == 2
    )


@query("fk_chain", f"""
WITH q AS (SELECT r_regionkey, r_name FROM region),
t1 AS (SELECT q.r_name, min_by(n_nationkey, {sql_digest(31, "nation", "n_nationkey")}) AS nationkey FROM q JOIN nation ON n_regionkey = r_regionkey GROUP BY q.r_name),
t2 AS (SELECT t1.r_name, t1.nationkey, min_by(c_custkey, {sql_digest(31, "customer", "c_custkey")}) AS custkey
  FROM t1 JOIN customer ON c_nationkey = nationkey GROUP BY ALL)
SELECT t2.r_name, n_name, custkey, count(*) AS orders,
  {sql_plain("CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*)")} AS label
FROM t2 JOIN nation ON n_nationkey = nationkey JOIN orders ON o_custkey = custkey GROUP BY ALL
""")
def fk_chain(spark, sf_dir):
    """Region -> nation -> customer -> orders: each answer is the key of the next question."""
    return joins.fk_chain(spark, sf_dir, 31)


@query("restore_cells", f"""
WITH {SQL_SUPPLIER_LINES}, piv AS (SELECT table_id, flag || '; ' || line_status AS row_path, CAST(line AS VARCHAR) AS col_path,
    min_by(price, row_key) AS value FROM lines GROUP BY table_id, flag, line_status, line),
need AS (SELECT table_id, flag || '; ' || line_status AS row_path, CAST(line AS VARCHAR) AS col_path, max_by(price, row_key) AS value
  FROM lines WHERE {SQL_NEEDED} GROUP BY table_id, flag, line_status, line)
SELECT p.table_id, p.row_path, p.col_path, coalesce(n.value, p.value) AS value, n.value IS NOT NULL AS needed
FROM piv p LEFT JOIN need n ON p.table_id = n.table_id AND p.row_path = n.row_path AND p.col_path = n.col_path
""")
def restore_cells(spark, sf_dir):
    """Needed cells get their value before pivoting back; the last needed row of a cell wins."""
    lines = with_needed(supplier_lines(spark, sf_dir))
    cells = pivot.pivot_cells(lines, ["table_id"], ROWS, COLS, "price", "first", "row_key")
    needed = pivot.paths(lines.filter("needed"), ROWS, COLS)
    return text_paths(joins.restore_needed(cells, needed, "table_id", "price", "row_key"))


@query("bundle_range_join", f"""
WITH {SQL_ORDER_TABLES}, t AS (SELECT table_id, table_id % 20 AS place, table_id // 20 AS sample_id, count(*) AS n FROM rel GROUP BY ALL)
SELECT sample_id, b.size AS bundle, count(*) AS tables, CAST(sum(n) AS BIGINT) AS rows_
FROM t JOIN (VALUES (2),(3),(5),(10),(20)) b(size) ON t.place < b.size GROUP BY ALL
""")
def bundle_range_join(spark, sf_dir):
    """Table i belongs to every bundle of more than i tables."""
    tables = order_tables(spark, sf_dir).groupBy("table_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.expr("table_id % 20").alias("place"), F.expr("table_id div 20").alias("sample_id"), "n"
    )
    return (
        joins.bundles(tables, "place")
        .groupBy("sample_id", "bundle")
        .agg(F.count(F.lit(1)).alias("tables"), F.sum("n").alias("rows_"))
    )


@query("error_analysis_join", """
WITH p AS (SELECT doc_id AS sample_id, quality AS label, CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS prediction FROM labels)
SELECT p.sample_id, d.source, d.n_chars, p.prediction, p.label FROM p JOIN documents d ON d.doc_id = p.sample_id
WHERE p.prediction <> p.label
""")
def error_analysis_join(spark, sf_dir):
    """Wrong predictions with the sample they belong to."""
    predictions = load(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("sample_id"),
        F.col("quality").alias("label"),
        F.when(F.col("toxic") == 1, 0).otherwise(1).alias("prediction"),
    )
    samples = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "source", "n_chars")
    return joins.wrong_predictions(samples, predictions, "sample_id").select(
        "sample_id", "source", "n_chars", "prediction", "label"
    )


@query("ablation_fanout", f"""
WITH {SQL_ORDER_TABLES}, t AS (SELECT table_id, count(*) AS n FROM rel GROUP BY ALL),
g AS (SELECT table_id, n, m.method, p.perturbation FROM t, (VALUES ('extractive'),('sum'),('average')) m(method),
  (VALUES ('null'),('typos'),('notes'),('blank_rows')) p(perturbation))
SELECT table_id, method, perturbation, n FROM g
WHERE NOT (method = 'extractive' AND perturbation = 'null') AND NOT ({sql_pick(13, "skip", ["keep", "keep", "skip"], "table_id", "method", "perturbation")} = 'skip')
""")
def ablation_fanout(spark, sf_dir):
    """Every table with every method and perturbation, without the pairs that failed."""
    tables = order_tables(spark, sf_dir).groupBy("table_id").agg(F.count(F.lit(1)).alias("n"))
    grid = joins.fanout(
        tables, method=["extractive", "sum", "average"], perturbation=["null", "typos", "notes", "blank_rows"]
    )
    failed = pick(13, "skip", ["keep", "keep", "skip"], "table_id", "method", "perturbation") == "skip"
    skipped = (F.col("method") == "extractive") & (F.col("perturbation") == "null")
    return grid.filter(~skipped & ~failed).select("table_id", "method", "perturbation", "n")


@query("domain_cross_product", """
WITH t AS (SELECT p_partkey // 20 AS table_id, p_brand, p_type FROM part)
SELECT b.table_id, b.p_brand AS brand, y.p_type AS type FROM (SELECT DISTINCT table_id, p_brand FROM t) b
JOIN (SELECT DISTINCT table_id, p_type FROM t) y ON b.table_id = y.table_id
""")
def domain_cross_product(spark, sf_dir):
    """Every combination of the domain values of a table."""
    specs = part_specs(spark, sf_dir).select("table_id", "brand_domain", "type_domain")
    return joins.domain_product(specs, {"brand": "brand_domain", "type": "type_domain"}).select("table_id", "brand", "type")

"""Projections, filters and views over table specs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.sampling import pick_int, sql_digest, sql_pick_int
from tabloom.operators import labels, views
from tabloom.plans.labels import TUPLE, sql_cells
from tabloom.plans.registry import query
from tabloom.sources.tables import load, order_tables

DISPLAY = {"p_partkey": "Part key", "p_name": "Part name", "p_brand": "Brand (label)", "p_retailprice": "Retail price"}


@query("rename_display", """
SELECT p_partkey AS "Part key", p_name AS "Part name", p_brand AS "Brand (label)", p_retailprice AS "Retail price" FROM part
""")
def rename_display(spark, sf_dir):
    return views.rename_display(load(spark, sf_dir, "part").select(*DISPLAY), list(DISPLAY.values()))


@query("sanitize_identifiers", """
SELECT p_partkey AS "Partkey", p_name AS "Partname", p_brand AS "Brandlabel", p_retailprice AS "Retailprice" FROM part
""")
def sanitize_identifiers(spark, sf_dir):
    return views.sanitize_identifiers(rename_display(spark, sf_dir))


# every block of parts is a table; its spec lists the attributes and their domains
SQL_SPECS = """specs AS (
  SELECT p_partkey // 20 AS table_id, ['name','brand','type','size','price'] AS attributes,
    ['categorical','categorical','categorical','int','float'] AS kinds,
    'price' AS value_col, 'name' AS id_col, list_sort(list(DISTINCT p_name)) AS name_domain,
    list_sort(list(DISTINCT p_brand)) AS brand_domain, list_sort(list(DISTINCT p_type)) AS type_domain,
    min(p_size) AS size_lo, max(p_size) AS size_hi, min(p_retailprice) AS price_lo, max(p_retailprice) AS price_hi
  FROM part GROUP BY table_id)"""


@query("view_random_columns", f"""
WITH {SQL_SPECS}, a AS (SELECT table_id, unnest(attributes) AS attr, generate_subscripts(attributes, 1) AS pos, value_col, id_col FROM specs),
r AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY (attr IN (value_col, id_col)) DESC,
  {sql_digest(21, "view", "table_id", "attr")}) AS rn FROM a)
SELECT table_id, string_agg(attr, ',' ORDER BY (attr = value_col), pos) AS view_columns FROM r WHERE rn <= 4 GROUP BY table_id
""")
def view_random_columns(spark, sf_dir):
    """Value and id column plus random others; the value column is last."""
    specs = views.part_specs(spark, sf_dir)
    return views.random_view(specs, width=4, seed=21).select(
        "table_id", F.array_join("view_columns", ",").alias("view_columns")
    )


@query("view_shrunk_domains", f"""
WITH {SQL_SPECS}, d AS (SELECT table_id, unnest(brand_domain) AS v FROM specs),
k AS (SELECT table_id, v, row_number() OVER (PARTITION BY table_id ORDER BY {sql_digest(22, "domain", "table_id", "v")}) AS rn,
  {sql_pick_int(22, "domain-size", 2, 3, "table_id")} AS k FROM d)
SELECT table_id, string_agg(v, ',' ORDER BY v) AS brand_domain FROM k WHERE rn <= k GROUP BY table_id
""")
def view_shrunk_domains(spark, sf_dir):
    """Domains of added columns cut to two or three random values."""
    specs = views.part_specs(spark, sf_dir)
    size = pick_int(22, "domain-size", 2, 3, "table_id")
    return specs.select(
        "table_id",
        F.array_join(views.random_subset(F.col("brand_domain"), size, 22, "domain", "table_id"), ",").alias("brand_domain"),
    )


@query("view_fk_columns", f"""
WITH {SQL_SPECS}, a AS (SELECT table_id, unnest(attributes) AS attr, unnest(kinds) AS kind, generate_subscripts(attributes, 1) AS pos FROM specs),
o AS (SELECT * FROM a WHERE attr NOT IN ('type', 'brand', 'price') AND kind <> 'float'),
r AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY {sql_digest(23, "fk-view", "table_id", "attr")}) AS rn FROM o),
u AS (SELECT table_id, attr, pos FROM r WHERE rn <= 3 UNION ALL SELECT table_id, attr, pos FROM a WHERE attr = 'brand')
SELECT table_id, string_agg(attr, ',' ORDER BY pos) AS view_columns FROM u GROUP BY table_id
""")
def view_fk_columns(spark, sf_dir):
    """The join column plus unused non-float columns; the value column only in a last table."""
    specs = views.part_specs(spark, sf_dir)
    return views.fk_view(specs, join_col="brand", used=["type"], width=4, seed=23).select(
        "table_id", F.array_join("view_columns", ",").alias("view_columns")
    )


@query("spec_sanity", f"""
WITH {SQL_SPECS} SELECT table_id, len(name_domain) > 1 AND len(brand_domain) > 1 AND len(type_domain) > 1
  AND size_lo < size_hi AND price_lo < price_hi AS sane FROM specs
""")
def spec_sanity(spark, sf_dir):
    specs = views.part_specs(spark, sf_dir)
    return specs.select("table_id", (views.sane(specs) & views.domains_vary()).alias("sane"))


RULES = [
    ("r1", ["flag", "quantity"]), ("r2", ["flag", "discount"]), ("r3", ["line", "tax"]), ("r4", ["quantity"]),
    ("r5", ["name", "brand"]), ("r6", ["size", "price"]),
]


@query("rules_applicable_to_view", f"""
WITH {SQL_SPECS}, a AS (SELECT table_id, unnest(attributes) AS attr, value_col, id_col FROM specs),
r AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY (attr IN (value_col, id_col)) DESC,
  {sql_digest(21, "view", "table_id", "attr")}) AS rn FROM a),
v AS (SELECT table_id, list(attr) AS cols FROM r WHERE rn <= 4 GROUP BY table_id),
rules AS (SELECT * FROM (VALUES ('r1', ['flag','quantity']), ('r2', ['flag','discount']), ('r3', ['line','tax']),
  ('r4', ['quantity']), ('r5', ['name','brand']), ('r6', ['size','price'])) t(rule_id, cols))
SELECT table_id, rule_id FROM v JOIN rules ON list_has_all(v.cols, rules.cols)
""")
def rules_applicable_to_view(spark, sf_dir):
    """Rules all of whose columns are in the view of a table."""
    view = views.random_view(views.part_specs(spark, sf_dir), width=4, seed=21)
    return views.applicable_rules(view, RULES).select("table_id", "rule_id")


@query("minimal_unique_predicate", f"""
WITH {sql_cells("minimal", 2)},
s AS (SELECT c.table_id, c.row_id, x.ord, x.cols, (SELECT count(*) FROM rel r WHERE r.table_id = c.table_id
    AND (x.s = 0 OR r.status = c.status) AND (x.p = 0 OR r.priority = c.priority) AND (x.y = 0 OR r.year = c.year)) AS n
  FROM cells c, (VALUES (0,'status',1,0,0),(1,'priority',0,1,0),(2,'year',0,0,1),(3,'status,priority',1,1,0),
    (4,'status,year',1,0,1),(5,'priority,year',0,1,1),(6,'status,priority,year',1,1,1)) x(ord,cols,s,p,y))
SELECT table_id, row_id, min_by(cols, ord) AS columns FROM s WHERE n = 1 GROUP BY table_id, row_id
""")
def minimal_unique_predicate(spark, sf_dir):
    """Smallest part of each sampled predicate that still selects one row."""
    rel = order_tables(spark, sf_dir)
    cells = labels.sampled_cells(rel, "table_id", TUPLE, "price", 2, "minimal")
    return views.minimal_predicate(rel, cells, "table_id", TUPLE).select("table_id", "row_id", "columns")


@query("fill_null_keys", """
SELECT coalesce(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END, 'None') AS priority,
  o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_totalprice IS NOT NULL
""")
def fill_null_keys(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
    )
    return orders.na.fill("None", subset=["priority", "status"]).na.drop(subset=["price"])


SQL_CAP = """cust AS (SELECT o_custkey AS table_id, o_orderkey AS row_id, {needed} AS needed FROM orders),
sized AS (SELECT *, count(*) FILTER (WHERE needed) OVER (PARTITION BY table_id) AS must,
  row_number() OVER (PARTITION BY table_id ORDER BY needed DESC, row_id) AS rn FROM cust)"""
NEEDED_ORDER = sql_pick_int(9, "needed-order", 1, 8, "o_orderkey") + " = 1"


@query("cap_cells_keep_needed", f"""
WITH {SQL_CAP.format(needed=NEEDED_ORDER)}
SELECT table_id, row_id, needed FROM sized WHERE rn <= greatest(must, 5)
""")
def cap_cells_keep_needed(spark, sf_dir):
    """At most 100 cells per table (5 rows of 20 columns); needed rows always stay."""
    orders = load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("table_id"),
        F.col("o_orderkey").alias("row_id"),
        (pick_int(9, "needed-order", 1, 8, "o_orderkey") == 1).alias("needed"),
    )
    return views.cap_rows(orders, "table_id", "row_id", columns=20)


@query("sequential_dependency_mask", f"""
WITH {sql_cells("chain", 2)}, p AS (
  SELECT table_id, rn AS step, unnest(['status','priority','year']) AS col, unnest([status, priority, year]) AS value FROM cells)
SELECT table_id, step, col, CASE WHEN step = 2 AND col = 'status' THEN 'this value depends on the previous instruction' ELSE value END AS value
FROM p
""")
def sequential_dependency_mask(spark, sf_dir):
    """A predicate on the column the previous query asked for hides its value."""
    preds = labels.predicates(_chain(spark, sf_dir), "table_id", TUPLE)
    return views.mask_dependencies(preds, target="status").select(
        "table_id", F.col("branch").cast("long").alias("step"), "col", "value"
    )


@query("sequential_dependency_drop", f"""
WITH {sql_cells("chain", 2)}, p AS (
  SELECT table_id, rn AS step, unnest(['status','priority','year']) AS col, unnest([status, priority, year]) AS value FROM cells)
SELECT table_id, step, col, value FROM p WHERE NOT (step = 2 AND col = 'status')
""")
def sequential_dependency_drop(spark, sf_dir):
    preds = labels.predicates(_chain(spark, sf_dir), "table_id", TUPLE)
    masked = views.mask_dependencies(preds, target="status")
    return masked.filter(F.col("value") != views.PLACEHOLDER).select(
        "table_id", F.col("branch").cast("long").alias("step"), "col", "value"
    )


def _chain(spark, sf_dir):
    return labels.sampled_cells(order_tables(spark, sf_dir), "table_id", TUPLE, "price", 2, "chain")


@query("required_columns_check", "SELECT o_orderkey, o_totalprice FROM orders")
def required_columns_check(spark, sf_dir):
    """The schema decides before anything runs; missing columns raise."""
    return views.require(load(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"]).select("o_orderkey", "o_totalprice")


@query("month_bucket", """
SELECT strftime(o_orderdate, '%Y-%m') AS order_month, count(*) AS orders FROM orders GROUP BY 1
""")
def month_bucket(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("order_month")).agg(
        F.count(F.lit(1)).alias("orders")
    )


@query("string_concat_case", """
SELECT c_custkey AS id, c_name || ' ' || c_mktsegment AS name, CASE WHEN c_acctbal > 0 THEN 'active' ELSE '' END AS notes,
  n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def string_concat_case(spark, sf_dir):
    customer, nation = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"),
        F.concat_ws(" ", "c_name", "c_mktsegment").alias("name"),
        F.when(F.col("c_acctbal") > 0, "active").otherwise("").alias("notes"),
        F.col("n_name").alias("country"),
    )

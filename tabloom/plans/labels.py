"""Keys, clusters and gold answers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tabloom.functions.numbers import exact_avg, plain, sql_plain
from tabloom.functions.sampling import digest, sql_digest, sql_pick, sql_pick_int, sql_uniform
from tabloom.operators import keys, labels
from tabloom.operators.ranking import hash_ranked
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

TUPLE = ["status", "priority", "year"]


def _cells(spark, sf_dir, op, k=labels.MAX_TUPLES):
    return labels.sampled_cells(order_tables(spark, sf_dir), "table_id", TUPLE, "price", k, op)


def sql_cells(op, k=labels.MAX_TUPLES):
    h = sql_digest(42, op, "table_id", "status", "priority", "year")
    return f"""{SQL_ORDER_TABLES}, uniq AS (
      SELECT table_id, status, priority, year, max(price) AS price, max(row_id) AS row_id
      FROM rel WHERE status IS NOT NULL AND priority IS NOT NULL AND year IS NOT NULL
      GROUP BY table_id, status, priority, year HAVING count(*) = 1),
    cells AS (SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY {h}, status, priority, year) AS rn
      FROM uniq) WHERE rn <= {k})"""


@query("flagship_average", f"""
WITH sets AS (
  SELECT p_name, p_brand, p_type, p_size, count(*) AS n, GROUPING(p_name, p_brand, p_type, p_size) AS g
  FROM part GROUP BY GROUPING SETS (
    (p_name,p_brand),(p_name,p_type),(p_name,p_size),(p_brand,p_type),(p_brand,p_size),(p_type,p_size),
    (p_name,p_brand,p_type),(p_name,p_brand,p_size),(p_name,p_type,p_size),(p_brand,p_type,p_size),
    (p_name,p_brand,p_type,p_size))),
ranked AS (
  SELECT *, list_position([3,5,6,9,10,12,1,2,4,8,0], g) - 1 AS subset FROM sets WHERE n = 1),
chosen AS (
  SELECT * FROM ranked WHERE subset = (SELECT min(subset) FROM ranked)
  ORDER BY {sql_digest(42, "flagship", "p_name", "p_brand", "p_type", "p_size")} LIMIT 3)
SELECT count(*) AS matched,
       {sql_plain("CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(*)")} AS label
FROM part p WHERE EXISTS (SELECT 1 FROM chosen c
  WHERE (c.p_name IS NULL OR c.p_name = p.p_name) AND (c.p_brand IS NULL OR c.p_brand = p.p_brand)
    AND (c.p_type IS NULL OR c.p_type = p.p_type) AND (c.p_size IS NULL OR c.p_size = p.p_size))
""")
def flagship_average(spark, sf_dir):
    columns = ["p_name", "p_brand", "p_type", "p_size"]
    unique = keys.unique_key_search(load(spark, sf_dir, "part"), columns, carry=["p_retailprice"])
    chosen = unique.withColumn("_h", digest(42, "flagship", *columns)).orderBy("_h").limit(3)
    return chosen.agg(
        F.count(F.lit(1)).alias("matched"), plain(exact_avg(F.col("p_retailprice"))).alias("label")
    )


@query("label_extractive", f"""
WITH {sql_cells("extractive", 1)}
SELECT table_id, {sql_plain("price")} AS label FROM cells WHERE rn = 1
""")
def label_extractive(spark, sf_dir):
    return labels.extractive(_cells(spark, sf_dir, "extractive", 1), "table_id", "price")


SQL_PAIRS = """pairs AS (
      SELECT table_id, max(price) FILTER (WHERE rn = 1) AS v1, max(price) FILTER (WHERE rn = 2) AS v2
      FROM cells GROUP BY table_id HAVING count(*) >= 2)"""


@query("label_comparative", f"""
WITH {sql_cells("comparative", 2)}, {SQL_PAIRS},
ops AS (SELECT *, {sql_pick(42, "comparison", labels.COMPARISONS, "table_id")} AS op FROM pairs)
SELECT table_id, op, CASE WHEN CASE op WHEN '>' THEN v1 > v2 WHEN '<' THEN v1 < v2 WHEN '=' THEN v1 = v2
  WHEN '>=' THEN v1 >= v2 ELSE v1 <= v2 END THEN 'yes' ELSE 'no' END AS label FROM ops
""")
def label_comparative(spark, sf_dir):
    return labels.comparative(_cells(spark, sf_dir, "comparative", 2), "table_id", "price")


def sql_reduced(method, aggregate):
    low = 3 if method == "superlative" else 2
    wanted = sql_pick_int(42, f"{method}-size", low, 4, "table_id")
    return f"""
WITH {sql_cells(method)}, kept AS (
  SELECT *, {wanted} AS wanted FROM cells),
agg AS (SELECT table_id, wanted, count(*) AS n, {aggregate} AS x
  FROM kept WHERE rn <= wanted GROUP BY table_id, wanted)
SELECT table_id, CAST(wanted AS BIGINT) AS cells, {sql_plain("x")} AS label FROM agg WHERE n = wanted
"""


EXTREME = sql_pick(42, "extreme", labels.EXTREMES, "table_id")


@query("label_superlative", sql_reduced(
    "superlative", f"CASE WHEN {EXTREME} = 'MAX' THEN max(price) ELSE min(price) END"))
def label_superlative(spark, sf_dir):
    return labels.reduced(_cells(spark, sf_dir, "superlative"), "table_id", "price", "superlative")


@query("label_sum", sql_reduced("sum", "CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE)"))
def label_sum(spark, sf_dir):
    return labels.reduced(_cells(spark, sf_dir, "sum"), "table_id", "price", "sum")


@query("label_average", sql_reduced("average", "CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(*)"))
def label_average(spark, sf_dir):
    return labels.reduced(_cells(spark, sf_dir, "average"), "table_id", "price", "average")


@query("label_percentage_change", f"""
WITH {sql_cells("percentage_change", 2)}, {SQL_PAIRS}
SELECT table_id, {sql_plain("(v1 - v2) * 100.0::DOUBLE / nullif(v2, 0.0)")} AS label FROM pairs
WHERE v2 <> 0
""")
def label_percentage_change(spark, sf_dir):
    return labels.change(_cells(spark, sf_dir, "percentage_change", 2), "table_id", "price")


@query("label_rounding", f"""
SELECT l_returnflag AS flag, l_linenumber AS line,
       {sql_plain("CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(l_extendedprice)")} AS label
FROM lineitem GROUP BY ALL
""")
def label_rounding(spark, sf_dir):
    return (
        load(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"))
        .agg(plain(exact_avg(F.col("l_extendedprice"))).alias("label"))
    )


@query("label_multitable", f"""
WITH {sql_cells("extractive", 1)}, lab AS (
  SELECT table_id // 2 AS sample_id, table_id % 2 AS pos, CAST({sql_plain("price")} AS DOUBLE) AS x
  FROM cells WHERE rn = 1),
agg AS (SELECT sample_id, count(*) AS n, max(x) FILTER (WHERE pos = 0) AS a, max(x) FILTER (WHERE pos = 1) AS b,
  max(x) AS hi, min(x) AS lo, CAST(sum(CAST(x AS DECIMAL(18,6))) AS DOUBLE) AS total FROM lab GROUP BY sample_id),
ops AS (SELECT *, {sql_pick(42, "multi-comparison", labels.COMPARISONS, "sample_id")} AS cmp,
  {sql_pick(42, "multi-extreme", labels.EXTREMES, "sample_id")} AS ext FROM agg)
SELECT * FROM (
  SELECT sample_id, 'comparative' AS method, cmp AS op, CASE WHEN n = 2 THEN CASE WHEN CASE cmp WHEN '>' THEN a > b
    WHEN '<' THEN a < b WHEN '=' THEN a = b WHEN '>=' THEN a >= b ELSE a <= b END THEN 'yes' ELSE 'no' END END AS label
  FROM ops
  UNION ALL SELECT sample_id, 'superlative', ext, CASE WHEN ext = 'MAX' THEN {sql_plain("hi")} ELSE {sql_plain("lo")} END FROM ops
  UNION ALL SELECT sample_id, 'sum', NULL, {sql_plain("total")} FROM ops
  UNION ALL SELECT sample_id, 'average', NULL, {sql_plain("total / n")} FROM ops
  UNION ALL SELECT sample_id, 'percentage_change', NULL,
    CASE WHEN n = 2 THEN {sql_plain("(a - b) * 100.0::DOUBLE / nullif(b, 0.0)")} END FROM ops)
WHERE label IS NOT NULL
""")
def label_multitable(spark, sf_dir):
    single = labels.extractive(_cells(spark, sf_dir, "extractive", 1), "table_id", "price")
    bundled = single.select(
        F.expr("table_id div 2").alias("sample_id"), F.expr("table_id % 2").alias("pos"), "label"
    )
    return labels.multitable(bundled, "sample_id", "pos", "label")


@query("unique_combinations", """
SELECT p_brand, p_type, p_size FROM part GROUP BY ALL HAVING count(*) = 1
""")
def unique_combinations(spark, sf_dir):
    return keys.unique_combinations(load(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


SQL_KEY_SETS = """sets AS (
  SELECT table_id, status, priority, year, count(*) AS n, GROUPING(status, priority, year) AS g
  FROM rel GROUP BY GROUPING SETS ((table_id,status,priority),(table_id,status,year),(table_id,priority,year),
    (table_id,status,priority,year))),
ranked AS (SELECT *, CAST(list_position([1,2,4,0], g) - 1 AS INTEGER) AS subset FROM sets WHERE n = 1)"""


@query("unique_key_search", f"""
WITH {SQL_ORDER_TABLES}, {SQL_KEY_SETS}
SELECT table_id, subset, status, priority, year FROM ranked r
WHERE subset = (SELECT min(subset) FROM ranked m WHERE m.table_id = r.table_id)
""")
def unique_key_search(spark, sf_dir):
    rel = order_tables(spark, sf_dir)
    return keys.unique_key_search(rel, TUPLE, ["table_id"]).select("table_id", "subset", *TUPLE)


@query("unique_key_search_keep", f"""
WITH {SQL_ORDER_TABLES}, sets AS (
  SELECT table_id, status, priority, year, count(*) AS n, GROUPING(status, priority, year) AS g
  FROM rel GROUP BY GROUPING SETS ((table_id,status,priority),(table_id,status,year),(table_id,status,priority,year))),
ranked AS (SELECT *, CAST(list_position([1,2,0], g) - 1 AS INTEGER) AS subset FROM sets
  WHERE n = 1 AND status = 'F')
SELECT table_id, subset, status, priority, year FROM ranked r
WHERE subset = (SELECT min(subset) FROM ranked m WHERE m.table_id = r.table_id)
""")
def unique_key_search_keep(spark, sf_dir):
    rel = order_tables(spark, sf_dir)
    found = keys.unique_key_search(rel, TUPLE, ["table_id"], keep=("status", "F"))
    return found.select("table_id", "subset", *TUPLE)


KEY_COLUMNS = ["flag", "line_status", "line", "taxed", "quarter"]
SQL_KEY_TABLES = f"""kt AS (SELECT l_suppkey AS table_id, {SQL_LINE_KEY} AS row_key, l_returnflag AS flag, l_linestatus AS line_status,
  l_linenumber AS line, CASE WHEN l_tax > 0.04 THEN 'yes' ELSE 'no' END AS taxed, CASE WHEN l_quantity > 10 THEN quarter(l_shipdate) END AS quarter FROM lineitem)"""


def _sql_smallest() -> str:
    sets = [list(c) for r in range(1, len(KEY_COLUMNS) + 1) for c in combinations(range(len(KEY_COLUMNS)), r)]
    parts = []
    for i, s in enumerate(sets):
        names = [KEY_COLUMNS[p] for p in s]
        whole = " AND ".join(f"{n} IS NOT NULL" for n in names)
        parts.append(f"SELECT table_id, {i} AS ord, '{' '.join(map(str, s))}' AS places, min(row_key) AS row_key FROM kt WHERE {whole} GROUP BY table_id, {', '.join(names)} HAVING count(*) = 1")
    return " UNION ALL ".join(parts)


@query("unique_key_any_size", f"""
WITH {SQL_KEY_TABLES}, u AS MATERIALIZED ({_sql_smallest()}), w AS (SELECT table_id, min(ord) AS ord FROM u GROUP BY table_id)
SELECT table_id, places, row_key FROM u JOIN w USING (table_id, ord)
UNION ALL SELECT DISTINCT table_id, NULL, NULL FROM kt WHERE table_id NOT IN (SELECT table_id FROM w)
""")
def unique_key_any_size(spark, sf_dir):
    """Rows that the smallest set of one to five columns tells apart, per supplier; suppliers without one are listed."""
    lines = load(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("table_id"), line_key().alias("row_key"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line_status"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_tax") > 0.04, "yes").otherwise("no").alias("taxed"),
        F.when(F.col("l_quantity") > 10, F.quarter("l_shipdate")).alias("quarter"),
    )
    found = keys.smallest_keys(lines, ["table_id"], "row_key", KEY_COLUMNS)
    return found.select("table_id", F.concat_ws(" ", F.col("places").cast("array<string>")).alias("places"), "row_key").withColumn(
        "places", F.when(F.col("row_key").isNotNull(), F.col("places"))
    )


SQL_SINGLES = """nodes AS (
  SELECT table_id, row_id, 'status' AS col, status AS value FROM rel
  UNION ALL SELECT table_id, row_id, 'priority', priority FROM rel
  UNION ALL SELECT table_id, row_id, 'year', year FROM rel),
singles AS (SELECT table_id, col, value, min(row_id) AS row_id FROM nodes
  GROUP BY table_id, col, value HAVING count(*) = 1)"""


def _singles(spark, sf_dir):
    return keys.single_values(order_tables(spark, sf_dir), ["table_id"], "row_id", TUPLE)


@query("bijective_pairs", f"""
WITH {SQL_ORDER_TABLES}, {SQL_SINGLES}, fwd AS (
  SELECT a.table_id, a.col AS col1, b.col AS col2, a.value AS value1, min(b.value) AS value2
  FROM nodes a JOIN nodes b ON a.table_id = b.table_id AND a.row_id = b.row_id AND a.col < b.col
  GROUP BY a.table_id, a.col, b.col, a.value HAVING count(*) = 1),
bwd AS (
  SELECT a.table_id, a.col AS col1, b.col AS col2, min(a.value) AS value1, b.value AS value2
  FROM nodes a JOIN nodes b ON a.table_id = b.table_id AND a.row_id = b.row_id AND a.col < b.col
  GROUP BY a.table_id, a.col, b.col, b.value HAVING count(*) = 1)
SELECT * FROM fwd INTERSECT SELECT * FROM bwd
""")
def bijective_pairs(spark, sf_dir):
    return keys.bijective_pairs(_singles(spark, sf_dir), ["table_id"]).select(
        "table_id", "col1", "col2", "value1", "value2"
    )


@query("value_clusters", f"""
WITH {SQL_ORDER_TABLES}, {SQL_SINGLES}
SELECT table_id, row_id AS cluster_id, col, value, nodes FROM (
  SELECT *, count(*) OVER (PARTITION BY table_id, row_id) AS nodes FROM singles) WHERE nodes > 1
""")
def value_clusters(spark, sf_dir):
    return keys.value_clusters(_singles(spark, sf_dir), ["table_id"]).select(
        "table_id", "cluster_id", "col", "value", "nodes"
    )


@query("cluster_question_sample", f"""
WITH {SQL_ORDER_TABLES}, {SQL_SINGLES}, cl AS (
  SELECT table_id, row_id AS cluster_id, col, value, nodes FROM (
    SELECT *, count(*) OVER (PARTITION BY table_id, row_id) AS nodes FROM singles) WHERE nodes > 1),
pickd AS (SELECT * FROM (SELECT DISTINCT table_id, cluster_id, nodes FROM cl)
  QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY {sql_digest(7, "cluster", "table_id", "cluster_id")}) = 1),
wanted AS (SELECT *, 2 + floor({sql_uniform(7, "nodes", "table_id", "cluster_id")} * (nodes - 1)) AS wanted FROM pickd),
r AS (SELECT cl.table_id, cl.cluster_id, cl.col, cl.value, w.wanted, row_number() OVER (
    PARTITION BY cl.table_id, cl.cluster_id ORDER BY {sql_digest(7, "node", "cl.table_id", "cl.cluster_id", "cl.col")}) AS rn
  FROM cl JOIN wanted w ON cl.table_id = w.table_id AND cl.cluster_id = w.cluster_id)
SELECT table_id, cluster_id, col, value, rn = 1 AS is_target FROM r WHERE rn <= wanted
""")
def cluster_question_sample(spark, sf_dir):
    clusters = keys.value_clusters(_singles(spark, sf_dir), ["table_id"])
    return keys.sample_cluster(clusters, ["table_id"], 7).select(
        "table_id", "cluster_id", "col", "value", "is_target"
    )


@query("sample_k_constraints", f"""
WITH {sql_cells("constraints", 2)} SELECT table_id, status, priority, year, CAST(rn AS BIGINT) AS rn FROM cells
""")
def sample_k_constraints(spark, sf_dir):
    return _cells(spark, sf_dir, "constraints", 2).select("table_id", *TUPLE, F.col("rn").cast("long").alias("rn"))


@query("needed_mask", f"""
WITH {sql_cells("mask", 3)}
SELECT r.table_id, r.row_id, bool_or(c.rn IS NOT NULL) AS needed
FROM rel r LEFT JOIN cells c ON r.table_id = c.table_id AND r.status = c.status
  AND r.priority = c.priority AND r.year = c.year
GROUP BY r.table_id, r.row_id
""")
def needed_mask(spark, sf_dir):
    rel = order_tables(spark, sf_dir)
    preds = labels.predicates(_cells(spark, sf_dir, "mask", 3), "table_id", TUPLE)
    return labels.needed_mask(rel, preds, "table_id", "row_id", TUPLE).select("table_id", "row_id", "needed")


@query("union_all_selects", f"""
WITH {sql_cells("union", 3)}
SELECT r.table_id, c.rn AS branch, r.price FROM rel r JOIN cells c ON r.table_id = c.table_id
  AND r.status = c.status AND r.priority = c.priority AND r.year = c.year
""")
def union_all_selects(spark, sf_dir):
    """All branches of a UNION ALL from one scan: a join with the branch tuples keeps multiplicity."""
    branches = _cells(spark, sf_dir, "union", 3).select("table_id", *TUPLE, F.col("rn").cast("long").alias("branch"))
    return order_tables(spark, sf_dir).join(branches, ["table_id", *TUPLE]).select("table_id", "branch", "price")


@query("scalar_lookup_pair", f"""
WITH {sql_cells("pair", 2)}, {SQL_PAIRS}
SELECT table_id, v1, v2, v1 > v2 AS larger FROM pairs
""")
def scalar_lookup_pair(spark, sf_dir):
    return labels.pair_of(_cells(spark, sf_dir, "pair", 2), "table_id", "price").withColumn(
        "larger", F.col("v1") > F.col("v2")
    )


@query("conjunctive_filter", """
SELECT p_partkey, p_retailprice FROM part WHERE p_brand = 'Brand#12' AND p_type = 'PROMO'
""")
def conjunctive_filter(spark, sf_dir):
    return (
        load(spark, sf_dir, "part")
        .filter((F.col("p_brand") == "Brand#12") & (F.col("p_type") == "PROMO"))
        .select("p_partkey", "p_retailprice")
    )


@query("shuffle_rows", f"""
WITH {SQL_SUPPLIER_LINES}
SELECT table_id, row_key, row_number() OVER (PARTITION BY table_id ORDER BY {sql_digest(3, "shuffle", "row_key")}) AS pos FROM lines
""")
def shuffle_rows(spark, sf_dir):
    """A random position for every row of every table, however large a table is."""
    lines = supplier_lines(spark, sf_dir).select("table_id", "row_key", digest(3, "shuffle", "row_key").alias("_h"))
    return hash_ranked(lines, ["table_id"], "_h", ["row_key"], "pos").select("table_id", "row_key", "pos")

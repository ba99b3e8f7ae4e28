"""Catalogue and column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import profile
from tabloom.plans.registry import query
from tabloom.sources.catalog import relation_schema, row_counts
from tabloom.sources.tables import TABLES, load

LINE_COLUMNS = [
    "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


def sql_counts(table, columns):
    return "\n UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {table} GROUP BY {c}" for c in columns
    )


SQL_PROFILE = f"""counts AS ({sql_counts("lineitem", LINE_COLUMNS)}),
prof AS (SELECT col, CAST(sum(n) AS BIGINT) AS row_count, count(value) AS distinct_values,
    CAST(sum(CASE WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN n ELSE 0 END) AS DOUBLE) / sum(n) AS coverage,
    coalesce(bool_or(TRY_CAST(value AS DOUBLE) % 1 <> 0), false) AS frac
  FROM counts GROUP BY col),
kinds AS (SELECT col, row_count AS "rows", distinct_values, coverage,
    CASE WHEN coverage >= 0.95 AND frac THEN 'float' WHEN coverage >= 0.95 THEN 'integer' ELSE 'text' END AS kind
  FROM prof)"""


@query("numeric_coverage", f"""WITH {SQL_PROFILE} SELECT col, "rows", coverage, kind FROM kinds""")
def numeric_coverage(spark, sf_dir):
    return profile.quick_profile(load(spark, sf_dir, "lineitem"), LINE_COLUMNS).drop("least_values")


SQL_AXIS_PROFILE = f"""{SQL_PROFILE}, axis AS (
  SELECT col, distinct_values, kind FROM kinds WHERE distinct_values BETWEEN 3 AND 60 AND kind <> 'float')"""


@query("axis_candidates", f"WITH {SQL_AXIS_PROFILE} SELECT * FROM axis")
def axis_candidates(spark, sf_dir):
    return profile.axis_candidates(load(spark, sf_dir, "lineitem"), LINE_COLUMNS)


@query("cartesian_estimate", f"""
WITH {SQL_AXIS_PROFILE}
SELECT r.col AS row_attribute, c.col AS column_attribute, r.distinct_values * c.distinct_values AS cells,
       r.distinct_values * c.distinct_values <= 20000 AS within_guard
FROM axis r JOIN axis c ON r.col < c.col
""")
def cartesian_estimate(spark, sf_dir):
    """Estimated pivot size of every pair of axis columns; a relation's profile has one row per column."""
    stats = profile.axis_candidates(load(spark, sf_dir, "lineitem"), LINE_COLUMNS)
    listed = stats.agg(F.collect_list(F.struct("col", "distinct_values")).alias("axes"))
    rows = listed.select("axes", F.explode("axes").alias("r"))
    pairs = rows.select("r", F.explode(F.filter("axes", lambda c: c["col"] > F.col("r")["col"])).alias("c"))
    cells = F.col("r.distinct_values") * F.col("c.distinct_values")
    return pairs.select(
        F.col("r.col").alias("row_attribute"), F.col("c.col").alias("column_attribute"), cells.alias("cells"),
        (cells <= 20000).alias("within_guard"),
    )


@query("categorical_rank", f"""
WITH counts AS ({sql_counts("part", ["p_name", "p_brand", "p_type", "p_size", "p_partkey"])}),
top AS (SELECT col, sum(n) AS top FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS rn
  FROM counts WHERE value IS NOT NULL) WHERE rn <= 10 GROUP BY col),
tot AS (SELECT col, sum(n) AS rows_, count(value) AS d FROM counts GROUP BY col)
SELECT t.col, CAST(rows_ AS BIGINT) AS "rows", d AS distinct_values,
  (CASE WHEN d <= 50 THEN 2.0::DOUBLE ELSE greatest(0.0::DOUBLE, 2.0::DOUBLE - d / 200.0::DOUBLE) END)
   + CAST(top AS DOUBLE) / rows_ + 1.0::DOUBLE AS score
FROM tot t JOIN top USING (col) WHERE d >= 3 ORDER BY score DESC, distinct_values, col LIMIT 4
""")
def categorical_rank(spark, sf_dir):
    counts = profile.value_counts(
        load(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type", "p_size", "p_partkey"]
    )
    return profile.categorical_rank(counts, top_k=4)


def _all(spark, sf_dir):
    return {name: load(spark, sf_dir, name) for name in TABLES}


SQL_SCHEMA = "\n UNION ALL ".join(
    f"SELECT '{t}' AS relation, column_name AS col, replace(column_type, 'FLOAT[]', 'ARRAY<FLOAT>') AS type_name "
    f"FROM (DESCRIBE {t})" for t in TABLES
)
SQL_ROWS = "\n UNION ALL ".join(f"SELECT '{t}' AS relation, count(*) AS row_count FROM {t}" for t in TABLES)


@query("schema_probe", f"""
WITH s AS ({SQL_SCHEMA}), r AS ({SQL_ROWS}) SELECT s.relation, col, type_name, row_count FROM s JOIN r USING (relation)
""")
def schema_probe(spark, sf_dir):
    tables = _all(spark, sf_dir)
    return relation_schema(spark, tables).join(row_counts(tables), "relation")


SQL_CLASS = """CASE WHEN regexp_matches(type_name, 'REAL|FLOAT|DOUBLE|DECIMAL|NUMERIC') THEN 'float'
  WHEN regexp_matches(type_name, 'CHAR|CLOB|TEXT|STRING|BOOL|DATE|TIME') THEN 'categorical' ELSE 'other' END"""


@query("classify_declared_types", f"""
WITH s AS ({SQL_SCHEMA}), r AS ({SQL_ROWS})
SELECT relation, {SQL_CLASS} AS type_class, count(*) AS columns, max(row_count) AS row_count
FROM s JOIN r USING (relation) GROUP BY ALL
""")
def classify_declared_types(spark, sf_dir):
    tables = _all(spark, sf_dir)
    return (
        relation_schema(spark, tables)
        .join(row_counts(tables), "relation")
        .groupBy("relation", profile.type_class(F.col("type_name")).alias("type_class"))
        .agg(F.count(F.lit(1)).alias("columns"), F.max("row_count").alias("row_count"))
    )


SQL_DISTINCT_ROWS = "\n UNION ALL ".join(
    f"SELECT '{t}' AS relation, count(*) AS row_count FROM (SELECT DISTINCT * FROM {t})" for t in TABLES
)


@query("qualify_tables", f"""
WITH s AS ({SQL_SCHEMA}), k AS (SELECT relation, count(*) FILTER (WHERE {SQL_CLASS} = 'float') AS float_columns,
    count(*) FILTER (WHERE {SQL_CLASS} = 'categorical') AS categorical_columns FROM s GROUP BY relation),
r AS ({SQL_DISTINCT_ROWS})
SELECT relation, row_count, float_columns, categorical_columns FROM k JOIN r USING (relation)
WHERE row_count >= 200 AND float_columns >= 1 AND categorical_columns >= 2 ORDER BY relation LIMIT 4
""")
def qualify_tables(spark, sf_dir):
    return profile.qualified(_all(spark, sf_dir), target=4, least_rows=200, least_float=1, least_categorical=2)


@query("catalog_relations", f"""
WITH r AS ({SQL_ROWS}) SELECT 'table' AS type, relation, row_count FROM r
UNION ALL SELECT 'view', 'orders_enriched', count(*) FROM orders JOIN customer ON o_custkey = c_custkey
ORDER BY 1, 2
""")
def catalog_relations(spark, sf_dir):
    """Tables and views in order of type and name, with their sizes."""
    tables = _all(spark, sf_dir)
    enriched = tables["orders"].join(tables["customer"], F.col("o_custkey") == F.col("c_custkey"))
    counted = row_counts(tables).withColumn("type", F.lit("table"))
    view = row_counts({"orders_enriched": enriched}).withColumn("type", F.lit("view"))
    return counted.unionByName(view).select("type", "relation", "row_count").orderBy("type", "relation")

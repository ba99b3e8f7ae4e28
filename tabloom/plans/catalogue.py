"""The catalogue of dense pivots over all given tables and a view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import catalogue
from tabloom.plans.registry import query
from tabloom.session import materialise
from tabloom.sources.tables import TABLES, load

VIEW = "orders_enriched"
#: Columns by kind: n number, s text, t time, o other.
SCHEMA = {
    "region": "r_regionkey:n r_name:s",
    "nation": "n_nationkey:n n_name:s n_regionkey:n",
    "customer": "c_custkey:n c_name:s c_nationkey:n c_acctbal:n c_mktsegment:s",
    "supplier": "s_suppkey:n s_name:s s_nationkey:n s_acctbal:n",
    "part": "p_partkey:n p_name:s p_brand:s p_type:s p_size:n p_retailprice:n",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus:s o_totalprice:n o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:n l_extendedprice:n l_discount:n l_tax:n "
    "l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:n ts:t user_id:n event_type:s value:n props:s",
    "documents": "doc_id:n text:s lang:s source:s n_chars:n",
    "embeddings": "vec_id:n embedding:o label:n",
    "pages": "page_id:n url:s html:s",
    "benchmark": "item_id:n text:s",
    "labels": "doc_id:n quality:n toxic:n",
    "conversations": "conv_id:n turn:n role:s text:s",
    VIEW: "o_orderkey:n o_orderstatus:s o_orderpriority:s year:s segment:s region:s o_totalprice:n c_acctbal:n",
}
SQL_VIEW = f"""{VIEW} AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y') AS year, c_mktsegment AS segment,
  r_name AS region, o_totalprice, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def relations(spark, sf_dir) -> dict:
    """All given tables, and orders with their customers and regions as a view."""
    tables = {name: load(spark, sf_dir, name) for name in TABLES}
    view = (
        tables["orders"]
        .join(tables["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(tables["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .join(tables["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "o_orderkey", "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy").alias("year"),
            F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"), "o_totalprice", "c_acctbal",
        )
    )
    return {**tables, VIEW: view}


def searched(spark, sf_dir) -> catalogue.Catalogue:
    return catalogue.dense_pivots(spark, "sales", relations(spark, sf_dir), {VIEW: "view"})


def _sql_profile() -> str:
    parts = []
    for table, columns in SCHEMA.items():
        listed = [c.split(":") for c in columns.split()]
        for i, (c, kind) in enumerate(listed):
            number = {"n": f"CAST({c} AS DOUBLE)", "s": f"TRY_CAST({c} AS DOUBLE)"}.get(kind, "NULL::DOUBLE")
            values = "0" if kind == "o" else f"count(DISTINCT {c})"
            parts.append(
                f"SELECT '{table}' AS relation, {i + 1} AS pos, '{c}' AS col, {len(listed)} AS source_columns, count(*) AS n, {values} AS d, "
                f"count({number}) >= 0.95 * count(*) AS numeric, coalesce(bool_or({number} % 1 <> 0), false) AS frac, {kind in 'st'} AS txt FROM {table}"
            )
    return " UNION ALL ".join(parts)


def _sql_rows() -> str:
    parts = []
    for table, columns in SCHEMA.items():
        listed = [c.split(":") for c in columns.split()]
        parts.append(f"SELECT '{table}' AS relation, [{', '.join('NULL' if k == 'o' else f'CAST({c} AS VARCHAR)' for c, k in listed)}] AS vals FROM {table}")
    return " UNION ALL ".join(parts)


#: The same search over long rows: sets of axes are bit masks of their places, tuples are lists of texts.
SQL_PIVOTS = f"""{SQL_VIEW},
prof AS MATERIALIZED (SELECT * FROM ({_sql_profile()}) WHERE n >= 9 AND source_columns >= 3),
ax AS (SELECT relation, list(pos ORDER BY pos) AS ps, list(col ORDER BY pos) AS names, list(d ORDER BY pos) AS ds FROM prof
  WHERE d BETWEEN 3 AND 60 AND ((numeric AND NOT frac) OR (NOT numeric AND txt)) GROUP BY relation HAVING count(*) >= 2),
vx AS (SELECT relation, list(pos ORDER BY pos) AS vps, list(col ORDER BY pos) AS vnames, any_value(n) AS source_rows,
  any_value(source_columns) AS source_columns FROM prof WHERE d >= 3 AND numeric AND frac GROUP BY relation),
tup AS MATERIALIZED (SELECT DISTINCT relation, list_transform(ps, lambda p: vals[p]) AS t, list_transform(vps, lambda p: vals[p] IS NOT NULL) AS pr
  FROM ({_sql_rows()}) JOIN ax USING (relation) JOIN vx USING (relation)),
sub AS (SELECT relation, m, names, list_filter(range(1, len(ps) + 1), lambda i: (m >> (i - 1)) & 1 = 1) AS idx, ds
  FROM (SELECT *, unnest(range(1, (1::BIGINT << len(ps)))) AS m FROM ax)),
sz AS (SELECT relation, m, idx, len(idx) AS k, list_reduce(list_transform(idx, lambda i: ds[i]), lambda a, b: a * b) AS est,
  array_to_string(list_transform(idx, lambda i: names[i]), '; ') AS label, list_min(list_transform(idx, lambda i: ds[i])) AS small FROM sub),
cnt AS MATERIALIZED (SELECT relation, m, v, count(DISTINCT list_transform(idx, lambda i: t[i])) AS d
  FROM (SELECT sz.relation, m, idx, t, pr, unnest(range(1, len(pr) + 1)) AS v FROM sz JOIN tup ON sz.relation = tup.relation WHERE est <= 20000 AND k <= 8)
  WHERE pr[v] AND len(list_filter(idx, lambda i: t[i] IS NULL)) = 0 GROUP BY ALL),
fullcat AS (
  SELECT 'sales' AS dataset, r.relation, CASE WHEN r.relation = '{VIEW}' THEN 'view' ELSE 'table' END AS relation_type,
    r.label AS row_attributes, c.label AS column_attributes, vnames[a.v] AS value_attribute, r.k::INT AS num_row_attributes,
    c.k::INT AS num_column_attributes, rc.d AS pivot_rows, cc.d AS pivot_columns, rc.d * cc.d AS pivot_cells,
    a.d / CAST(rc.d * cc.d AS DOUBLE) AS non_nan_density, source_rows, source_columns::INT AS source_columns,
    (r.k + c.k)::INT AS total_header_levels, least(r.k, c.k)::INT AS min_header_side_levels
  FROM sz r JOIN sz c ON r.relation = c.relation AND r.m & c.m = 0 AND r.k <= 4 AND c.k <= 4 AND r.est * c.est <= 20000
  JOIN cnt a ON a.relation = r.relation AND a.m = r.m | c.m
  JOIN cnt rc ON rc.relation = r.relation AND rc.m = r.m AND rc.v = a.v
  JOIN cnt cc ON cc.relation = r.relation AND cc.m = c.m AND cc.v = a.v
  JOIN vx ON vx.relation = r.relation
  WHERE rc.d >= 3 AND cc.d >= 3 AND a.d / CAST(rc.d * cc.d AS DOUBLE) >= 0.95)"""


@query("valid_pivot_catalog", f"WITH {SQL_PIVOTS} SELECT * FROM fullcat")
def valid_pivot_catalog(spark, sf_dir):
    return searched(spark, sf_dir).pivots


@query("refused_axis_sets", f"""
WITH {SQL_PIVOTS} SELECT relation, label AS attributes, est AS estimated_cells FROM sz SEMI JOIN vx USING (relation)
WHERE k <= 8 AND est > 500 AND est // small <= 500
""")
def refused_axis_sets(spark, sf_dir):
    """Smallest sets of axis attributes that a guard of 500 cells keeps out of the search."""
    return catalogue.dense_pivots(spark, "sales", relations(spark, sf_dir), {VIEW: "view"}, guard=500).refused


def full_catalog(spark, sf_dir):
    """The catalogue, kept for its several readers."""
    return materialise(searched(spark, sf_dir).pivots, "catalogue")

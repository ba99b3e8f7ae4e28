"""Duplicates, top-k, set operations and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.sampling import digest, sql_digest, sql_uniform, uniform
from tabloom.operators.ranking import first_rows
from tabloom.plans.registry import query
from tabloom.sources.tables import SQL_ORDER_TABLES, SQL_SUPPLIER_LINES, load, order_tables, supplier_lines


@query("dedup_keep_first", f"""
WITH {SQL_SUPPLIER_LINES} SELECT table_id, quantity, discount, row_key, price FROM lines
QUALIFY row_number() OVER (PARTITION BY table_id, quantity, discount ORDER BY row_key) = 1
""")
def dedup_keep_first(spark, sf_dir):
    lines = supplier_lines(spark, sf_dir).select("table_id", "quantity", "discount", "row_key", "price")
    return first_rows(lines, ["table_id", "quantity", "discount"], ["row_key"])


@query("dedup_full_row", """
SELECT DISTINCT l_suppkey, l_quantity, l_discount, l_returnflag FROM lineitem
""")
def dedup_full_row(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_returnflag").dropDuplicates()


@query("dedup_after_shuffle", f"""
WITH {SQL_SUPPLIER_LINES} SELECT table_id, flag, line, row_key FROM lines
QUALIFY row_number() OVER (PARTITION BY table_id, flag, line ORDER BY {sql_digest(4, "shuffle", "row_key")}) = 1
""")
def dedup_after_shuffle(spark, sf_dir):
    lines = supplier_lines(spark, sf_dir).select("table_id", "flag", "line", "row_key")
    shuffled = lines.withColumn("_h", digest(4, "shuffle", "row_key"))
    return first_rows(shuffled, ["table_id", "flag", "line"], ["_h"]).drop("_h")


@query("dedup_matching_only", f"""
WITH {SQL_ORDER_TABLES} SELECT table_id, row_id, status, priority FROM rel WHERE status <> 'F'
UNION ALL SELECT table_id, min(row_id), status, priority FROM rel WHERE status = 'F' GROUP BY table_id, status, priority
""")
def dedup_matching_only(spark, sf_dir):
    """Rows that match keep one per key; all others stay."""
    rel = order_tables(spark, sf_dir).select("table_id", "row_id", "status", "priority")
    matching = F.col("status") == "F"
    once = first_rows(rel.filter(matching), ["table_id", "status", "priority"], ["row_id"])
    return rel.filter(~matching).unionByName(once)


@query("fk_single_match", f"""
WITH {SQL_ORDER_TABLES} SELECT table_id, row_id, status FROM rel WHERE status <> 'P'
UNION ALL SELECT table_id, min(row_id), 'P' FROM rel WHERE status = 'P' GROUP BY table_id
""")
def fk_single_match(spark, sf_dir):
    """Only the first row with the key value stays, rows with other values are untouched."""
    rel = order_tables(spark, sf_dir).select("table_id", "row_id", "status")
    matching = F.col("status") == "P"
    return rel.filter(~matching).unionByName(first_rows(rel.filter(matching), ["table_id"], ["row_id"]))


@query("top_k", """
SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey LIMIT 100
""")
def top_k(spark, sf_dir):
    return (
        load(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey", "l_extendedprice")
        .orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_partkey")
        .limit(100)
    )


@query("intersect_pairs", """
SELECT l_partkey AS part, l_suppkey AS supplier FROM lineitem WHERE l_returnflag = 'A'
INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'
""")
def intersect_pairs(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    pairs = lambda flag: lines.filter(F.col("l_returnflag") == flag).select(
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")
    )
    return pairs("A").intersect(pairs("R"))


@query("train_valid_split", f"""
SELECT conv_id, turn, role, CASE WHEN {sql_uniform(0, "split", "conv_id", "turn", "text")} < 0.05 THEN 'valid' ELSE 'train' END AS part
FROM conversations
""")
def train_valid_split(spark, sf_dir):
    """95/5 split by the digest of a sample; copies of a sample fall on the same side."""
    part = F.when(uniform(0, "split", "conv_id", "turn", "text") < 0.05, "valid").otherwise("train")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", part.alias("part"))

"""The given tables and the table corpora derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem "
    "events documents embeddings pages benchmark labels conversations"
).split()

BLOCK_ROWS = 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute an input that has fewer splits than tasks can run at once.

    For scans with heavy work per row; an input of many files is left as it is.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, *keys)


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of small relational tables: every block of 20 order keys is one table.

    The order key is the primary key, so no table has more than 20 rows however skewed the
    customers are.
    """
    return load(spark, sf_dir, "orders").select(
        F.expr(f"o_orderkey div {BLOCK_ROWS}").alias("table_id"),
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.date_format("o_orderdate", "yyyy").alias("year"),
        F.col("o_totalprice").alias("price"),
    )


SQL_ORDER_TABLES = f"""rel AS (
  SELECT o_orderkey // {BLOCK_ROWS} AS table_id, o_orderkey AS row_id, o_orderstatus AS status,
         o_orderpriority AS priority, strftime(o_orderdate, '%Y') AS year, o_totalprice AS price
  FROM orders)"""


def line_key():
    """Text key of a line item; the table has no key column of its own."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents)


SQL_LINE_KEY = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))"
)


def supplier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as one table per supplier, with a unique text key per row."""
    return spread(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey", "l_linenumber").select(
        F.col("l_suppkey").alias("table_id"),
        line_key().alias("row_key"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line_status"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_extendedprice").alias("price"),
    )


SQL_SUPPLIER_LINES = f"""lines AS (
  SELECT l_suppkey AS table_id, {SQL_LINE_KEY} AS row_key,
         l_returnflag AS flag, l_linestatus AS line_status, l_linenumber AS line,
         CAST(l_quantity AS INTEGER) AS quantity, l_discount AS discount, l_extendedprice AS price
  FROM lineitem)"""

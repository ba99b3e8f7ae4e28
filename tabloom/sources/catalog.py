"""Relations known to a session: names, schemas and sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.profile import declared_type


def relation_schema(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``(relation, col, type_name)`` of every column."""
    rows = [(name, f.name, declared_type(f)) for name, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "relation string, col string, type_name string")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counted = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("relation"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counted)


def register(df: DataFrame, name: str) -> None:
    """Load a frame under a name, replacing an earlier one."""
    df.createOrReplaceTempView(name)


def forget(spark: SparkSession, name: str) -> None:
    spark.catalog.dropTempView(name)

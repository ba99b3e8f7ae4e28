"""CSV and JSON question-answering data, partitioned datasets, score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.numbers import as_number

PARTITIONS = ["num_tables", "domain", "method", "perturbation"]

#: An empty text stays one; a missing value is written as backslash N.
QUOTING = {"quote": '"', "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

NESTED_QA = (
    "struct<table:struct<table:array<array<string>>>,"
    "questions:array<struct<question:string,answer:string,answer_from:string>>>"
)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and quoted values that may span lines."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, **QUOTING)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, mode="errorifexists", **QUOTING)


def write_dataset(df: DataFrame, path: str) -> None:
    """One folder per number of tables, domain, method and perturbation.

    Every task writes its own share of each folder: a folder that holds a third of all rows has as
    many writers as the others together.
    """
    df.write.partitionBy(*PARTITIONS).parquet(path, mode="errorifexists")


def read_dataset(spark: SparkSession, path: str, **wanted: str) -> DataFrame:
    """Read a dataset back; only the folders of the wanted settings are listed and scanned."""
    df = spark.read.parquet(path)
    for name, value in wanted.items():
        df = df.filter(F.col(name) == value)
    return df


def nested_questions(df: DataFrame, key: str, document: Column) -> DataFrame:
    """Questions answered from the table by one number; the first table row is the header."""
    parsed = df.select(key, F.from_json(document, NESTED_QA).alias("d"))
    q = parsed.select(
        key, F.col("d.table.table").alias("rows"), F.explode("d.questions").alias("q")
    ).filter("q.answer_from = 'table'")
    listed = F.from_json("q.answer", "array<string>")
    is_list = F.col("q.answer").startswith("[")
    label = F.when(is_list, F.get(listed, F.lit(0))).otherwise(F.col("q.answer"))
    kept = q.withColumn("label", label).filter((~is_list | (F.size(listed) == 1)) & as_number(F.col("label")).isNotNull())
    return kept.select(
        key, F.col("q.question").alias("question"), "label",
        F.get("rows", F.lit(0)).alias("header"), F.slice("rows", F.lit(2), F.size("rows") - 1).alias("body"),
    )

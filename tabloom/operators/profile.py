"""Column profiles: types, coverage, axis candidates and rankings.

A profile is one aggregate over the long ``(relation, column, value)`` counts, so wide tables cost
one shuffle of pre-aggregated value counts instead of a pass per column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.session import materialise

# Limits of the profile.
MIN_COVERAGE = 0.95
MIN_AXIS_VALUES = 3
MAX_AXIS_VALUES = 60
MIN_ROWS, MIN_COLUMNS = 9, 3
TOP_VALUES = 10
#: Buckets of the hashes that bound a column's number of values from below.
BUCKETS = 32_768
FLOAT_TYPE_WORDS = ["REAL", "FLOAT", "DOUBLE", "DOUBLE PRECISION", "DECIMAL", "NUMERIC"]
TEXT_TYPE_WORDS = [
    "CHAR", "CLOB", "TEXT", "STRING", "VARCHAR", "BOOL", "BOOLEAN", "DATE", "DATETIME", "TIME", "TIMESTAMP",
]


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col, value, n)`` for the chosen columns; NULL values are counted as NULL."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.explode(cells).alias("cell"))
        .groupBy(F.col("cell.col").alias("col"), F.col("cell.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def text_number(text):
    """Number of a text; only texts that may be one are cast, as failed casts are expensive."""
    return F.when(text.rlike(r"^\s*([-+.\d]|(?i:inf|nan))"), text.try_cast("double"))


def bucket(column: str) -> Column:
    """Place of a value among BUCKETS, by hash; NULL for NULL."""
    return F.when(F.col(column).isNotNull(), F.pmod(F.xxhash64(column), F.lit(BUCKETS)))


def quick_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, numeric coverage, kind and a lower bound of the number of values of each column.

    A single aggregate without grouping: every task sends one row, whatever the columns hold. ``least_values`` counts the
    occupied buckets of a hash, so a column surely has at least so many values.
    """
    measures = []
    for c in columns:
        numeric_type = isinstance(df.schema[c].dataType, T.NumericType)
        number = F.col(c).cast("double") if numeric_type else text_number(F.col(c).cast("string"))
        measures.append(
            F.struct(
                F.lit(c).alias("col"),
                F.count(F.lit(1)).alias("rows"),
                F.count(number).alias("numeric_rows"),
                F.coalesce(F.bool_or(number % 1 != 0), F.lit(False)).alias("has_fraction"),
                F.bitmap_count(F.bitmap_construct_agg(bucket(c))).alias("least_values"),
            )
        )
    stats = df.agg(F.array(*measures).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    stats = stats.withColumn("coverage", F.col("numeric_rows") / F.col("rows"))
    numeric = F.col("coverage") >= MIN_COVERAGE
    kind = F.when(numeric & F.col("has_fraction"), "float").when(numeric, "integer").otherwise("text")
    return stats.select("col", "rows", "coverage", kind.alias("kind"), "least_values")


def cardinalities(counts: DataFrame) -> DataFrame:
    return counts.groupBy("col").agg(F.count("value").alias("distinct_values"))


def axis_candidates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that can label a pivot axis, with their exact number of values.

    Columns that surely have too many values are left out by their lower bound, so the exact count only meets columns
    with few. A relation with fewer than MIN_ROWS rows or MIN_COLUMNS columns has none. The driver sees one row per column.
    """
    stats = quick_profile(df, columns).collect()
    low = [r for r in stats if r.kind != "float" and r.least_values <= MAX_AXIS_VALUES and r.rows >= MIN_ROWS]
    if not low or len(df.columns) < MIN_COLUMNS:
        return df.sparkSession.createDataFrame([], "col string, distinct_values long, kind string")
    kinds = F.create_map(*[x for r in low for x in (F.lit(r.col), F.lit(r.kind))])
    return (
        cardinalities(value_counts(df, [r.col for r in low]))
        .filter(F.col("distinct_values").between(MIN_AXIS_VALUES, MAX_AXIS_VALUES))
        .withColumn("kind", kinds[F.col("col")])
    )


def categorical_rank(counts: DataFrame, max_card: int = 50, top_k: int = 10) -> DataFrame:
    """Columns ordered by how well they suit a dense pivot."""
    present = counts.filter("value IS NOT NULL")
    window = Window.partitionBy("col").orderBy(F.col("n").desc(), "value")
    heavy = (
        present.withColumn("_rn", F.row_number().over(window))
        .filter(F.col("_rn") <= TOP_VALUES)
        .groupBy("col")
        .agg(F.sum("n").alias("top"))
    )
    totals = counts.groupBy("col").agg(F.sum("n").alias("rows"), F.count("value").alias("distinct_values"))
    spread = F.when(F.col("distinct_values") <= max_card, F.lit(2.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(2.0) - F.col("distinct_values") / F.lit(200.0))
    )
    scored = (
        totals.join(heavy, "col")
        .filter(F.col("distinct_values") >= MIN_AXIS_VALUES)
        .withColumn("score", spread + F.col("top") / F.col("rows") + F.lit(1.0))
    )
    return scored.orderBy(F.col("score").desc(), "distinct_values", "col").limit(top_k).drop("top")


def declared_type(field: T.StructField) -> str:
    """SQL name of a column type as a table definition would spell it."""
    names = {
        T.DoubleType: "DOUBLE", T.FloatType: "FLOAT", T.LongType: "BIGINT", T.IntegerType: "INTEGER",
        T.StringType: "VARCHAR", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP",
        T.DateType: "DATE", T.BooleanType: "BOOLEAN",
    }
    if isinstance(field.dataType, T.DecimalType):
        return "DECIMAL"
    return names.get(type(field.dataType), field.dataType.simpleString().upper())


def type_class(type_name):
    """Float-like, categorical-like or other, by the words of a declared type."""
    upper = F.upper(F.trim(type_name))

    def mentions(words):
        found = F.lit(False)
        for word in words:
            found = found | upper.contains(word)
        return found

    return (
        F.when(mentions(FLOAT_TYPE_WORDS), "float").when(mentions(TEXT_TYPE_WORDS), "categorical").otherwise("other")
    )


def qualified(tables: dict[str, DataFrame], target: int, least_rows: int, least_float: int, least_categorical: int) -> DataFrame:
    """The first ``target`` tables by name with enough distinct rows and columns of both declared kinds.

    The schema decides first, so only tables that can qualify are scanned for distinct rows. Raises if fewer qualify.
    """

    def count(df: DataFrame, words: Sequence[str]) -> int:
        return sum(any(w in declared_type(f) for w in words) for f in df.schema.fields)

    kinds = {n: (count(df, FLOAT_TYPE_WORDS), count(df, TEXT_TYPE_WORDS)) for n, df in sorted(tables.items())}
    eligible = [n for n, (floats, texts) in kinds.items() if floats >= least_float and texts >= least_categorical]
    counted = [
        tables[n].distinct().agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(n).alias("relation"),
            "row_count",
            F.lit(kinds[n][0]).cast("long").alias("float_columns"),
            F.lit(kinds[n][1]).cast("long").alias("categorical_columns"),
        )
        for n in eligible
    ]
    if len(counted) < target:
        raise ValueError(f"{len(counted)} tables have the columns, {target} are wanted")
    found = reduce(DataFrame.unionByName, counted).filter(F.col("row_count") >= least_rows).orderBy("relation").limit(target)
    found = materialise(found, "qualified")
    if (n := found.count()) < target:
        raise ValueError(f"{n} tables qualify, {target} are wanted")
    return found

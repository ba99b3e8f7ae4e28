"""Synthesis of table contents from column domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.sampling import pick_int, uniform
from tabloom.operators.joins import domain_product

# Fixed value: integer bounds of infinite domains.
INFINITE = 4_000_000_000


def finite(bound: Column) -> Column:
    """Infinite bounds of an integer domain become +-4 billion."""
    return F.when(F.abs(bound) == float("inf"), F.signum(bound) * F.lit(float(INFINITE))).otherwise(bound)


def uniform_long(lo: Column, hi: Column, u: Column) -> Column:
    """Integer in [lo, hi]."""
    lo, hi = lo.cast("long"), hi.cast("long")
    return F.least(lo + F.floor(u * (hi - lo + 1)), hi)


def choice(values: Column, u: Column) -> Column:
    return F.get(values, F.floor(u * F.size(values)).cast("int"))


def dense_fill(specs: DataFrame, domains: dict[str, str], lo: str, hi: str, seed: int, decimals: Column | int = 2) -> DataFrame:
    """All combinations of the key domains with a uniform value of so many decimals, a number or a column of the specs.

    Amounts are drawn in units of the last decimal, so the value has exactly its decimals.
    """
    keys = ["table_id", *domains]
    grid = domain_product(specs, domains)
    scale = F.pow(F.lit(10.0), F.lit(decimals) if isinstance(decimals, int) else decimals)
    steps = lambda c: F.round(F.col(c) * scale).cast("long")
    drawn = uniform_long(steps(lo), steps(hi), uniform(seed, "fill", *keys))
    return grid.withColumn("value", drawn / scale)


def fk_domain(key: Column, lo: Column, hi: Column, seed: int, *names: str) -> Column:
    """Integer key domain: the key to keep and four random values."""
    others = [uniform_long(lo, hi, uniform(seed, f"fk-{i}", *names)) for i in range(4)]
    return F.array_distinct(F.array(key.cast("long"), *others))


def random_fill(specs: DataFrame, columns: dict[str, Column], low: int, high: int, seed: int) -> DataFrame:
    """Between ``low`` and ``high`` random rows per spec; ``columns`` may use ``row_id``."""
    rows = specs.withColumn("row_id", F.explode(F.sequence(F.lit(1), pick_int(seed, "rows", low, high, "table_id"))))
    return rows.select("table_id", F.col("row_id").cast("long").alias("row_id"), *[c.alias(n) for n, c in columns.items()])

"""Dense pivots of many relations.

A pivot of rows R and columns C is dense if the distinct tuples of R and C together nearly fill the grid of the distinct
tuples of each. So a relation's catalogue follows from the number of distinct tuples of its sets of axis attributes. Sets
grow level by level while the product of their values stays within a guard; a set's tuples then have codes below the
guard, and the codes seen are bits of a few hundred words. All sets of all relations are rows of one aggregate over the
relations' distinct axis tuples: words merge map-side, and the counts are exact.

A relation is scanned twice: once for the profile of all its columns, once for the tuples of the few that can be axes.
What reaches the driver is one row per column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.pivot import MIN_DENSITY, MIN_SIDE
from tabloom.operators.profile import MAX_AXIS_VALUES, MIN_AXIS_VALUES, MIN_COLUMNS, MIN_COVERAGE, MIN_ROWS, bucket, text_number
from tabloom.session import materialise

# Limits of the search.
MAX_CELLS = 20_000
MOST_PER_SIDE = 4

TEXT_TYPES = (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


class Shape(NamedTuple):
    """What the search knows of a relation before it looks at tuples."""

    relation: str
    kind: str
    rows: int
    columns: int
    axes: tuple[str, ...]
    values: tuple[str, ...]


def column_profile(relation: str, df: DataFrame) -> DataFrame:
    """(relation, position, col, rows, kind, least_values): one aggregate without grouping.

    ``kind`` is float or integer where at least MIN_COVERAGE of the rows are numbers, else text for text-like types and
    other for the rest. ``least_values`` counts the occupied buckets of a hash: a column has at least so many values.
    """
    measures = []
    for i, field in enumerate(df.schema.fields):
        column = F.col(f"`{field.name}`")
        nothing = F.lit(None).cast("double")
        if isinstance(field.dataType, T.NumericType):
            number = column.cast("double")
        else:
            number = text_number(column) if isinstance(field.dataType, T.StringType) else nothing
        number = F.when(~F.isnan(number), number)
        flat = isinstance(field.dataType, (*TEXT_TYPES, T.NumericType))
        place = bucket(f"`{field.name}`") if flat else F.lit(None).cast("long")
        share = F.count(number) / F.count(F.lit(1)) >= MIN_COVERAGE
        fraction = F.coalesce(F.bool_or(number % 1 != 0), F.lit(False))
        other = F.lit("text" if isinstance(field.dataType, TEXT_TYPES) else "other")
        measures.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(field.name).alias("col"),
                F.count(F.lit(1)).alias("rows"),
                F.when(share & fraction, "float").when(share, "integer").otherwise(other).alias("kind"),
                F.bitmap_count(F.bitmap_construct_agg(place)).alias("least_values"),
            )
        )
    stats = df.agg(F.array(*measures).alias("m")).select(F.explode("m").alias("m"))
    return stats.select(F.lit(relation).alias("relation"), "m.*")


def _shapes(relations: dict[str, DataFrame], kinds: dict[str, str]) -> list[Shape]:
    """Relations that are large enough, with columns that may be axes and columns that are values."""
    profile = reduce(DataFrame.unionByName, [column_profile(name, df) for name, df in relations.items()]).collect()
    found = []
    for name in relations:
        columns = sorted((r for r in profile if r.relation == name), key=lambda r: r.position)
        rows = max((r.rows for r in columns), default=0)
        if rows < MIN_ROWS or len(columns) < MIN_COLUMNS:
            continue
        axes = [r.col for r in columns if r.kind in ("integer", "text") and r.least_values <= MAX_AXIS_VALUES]
        values = [r.col for r in columns if r.kind == "float"]
        doubtful = [r.col for r in columns if r.kind == "float" and r.least_values < MIN_AXIS_VALUES]
        if doubtful:  # few occupied buckets: only now a count of values is needed, and it is a small one
            exact = relations[name].agg(*[F.count_distinct(F.col(f"`{c}`")).alias(c) for c in doubtful]).first()
            values = [c for c in values if c not in doubtful or exact[c] >= MIN_AXIS_VALUES]
        if len(axes) >= 2 and values:
            found.append(Shape(name, kinds.get(name, "table"), rows, len(columns), tuple(axes), tuple(values)))
    return found


def _tuples(df: DataFrame, shape: Shape) -> DataFrame:
    """(relation, keys, present): distinct tuples of possible axes as text, and which values some row of each has."""
    present = [F.max(F.when(F.col(f"`{v}`").isNotNull() & ~F.isnan(F.col(f"`{v}`").try_cast("double")), True)).alias(f"_p{i}") for i, v in enumerate(shape.values)]
    grouped = df.groupBy(*[F.col(f"`{c}`").cast("string").alias(f"_k{i}") for i, c in enumerate(shape.axes)]).agg(*present)
    return grouped.select(
        F.lit(shape.relation).alias("relation"),
        F.array(*[f"_k{i}" for i in range(len(shape.axes))]).alias("keys"),
        F.array(*[f"_p{i}" for i in range(len(shape.values))]).alias("present"),
    )


def attribute_sets(sizes: dict[int, int], guard: int = MAX_CELLS, most: int = 2 * MOST_PER_SIDE) -> tuple[list, list]:
    """Sets of axes by level, and the smallest sets that the guard refuses.

    A set is allowed if the product of its numbers of values is within the guard; then so are all its subsets, and each
    level extends the one before. Refused sets are listed only where every smaller part of them is allowed.
    """
    level = [((p,), n) for p, n in sorted(sizes.items())]
    allowed = [x for x in level if x[1] <= guard]
    refused = [x for x in level if x[1] > guard]
    level = list(allowed)
    while level and len(level[0][0]) < most:
        grown = [((*s, p), n * m) for s, n in level for p, m in sorted(sizes.items()) if p > s[-1] and m <= guard]
        level = [x for x in grown if x[1] <= guard]
        refused += [(s, n) for s, n in grown if n > guard and n // min(sizes[p] for p in s) <= guard]
        allowed += level
    return allowed, refused


def _counted(spark: SparkSession, shapes: Sequence[Shape], tuples: DataFrame, guard: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(relation, mask, value_at, n) distinct tuples of every allowed set, those sets, and the refused ones."""
    values = tuples.select("relation", F.posexplode("keys").alias("at", "value")).where("value is not null")
    per_axis = values.groupBy("relation", "at").agg(F.array_sort(F.collect_set("value")).alias("words"))
    books = per_axis.groupBy("relation").agg(F.map_from_entries(F.collect_list(F.struct("at", "words"))).alias("book"))
    books = materialise(books, "axis-values")  # at most a few dozen values of each possible axis
    sizes: dict[str, dict[int, int]] = {}
    for r in books.select("relation", F.explode(F.transform_values("book", lambda _, w: F.size(w))).alias("at", "n")).collect():
        if MIN_AXIS_VALUES <= r.n <= MAX_AXIS_VALUES:
            sizes.setdefault(r.relation, {})[r.at] = r.n
    names = {s.relation: s.axes for s in shapes}
    allowed, refused = [], []
    for relation, some in sizes.items():
        fit, unfit = attribute_sets(some, guard)
        allowed += [(relation, sum(1 << p for p in s), list(s)) for s, _ in fit]
        refused += [(relation, "; ".join(names[relation][p] for p in s), n) for s, n in unfit]
    sets = spark.createDataFrame(allowed, "relation string, mask long, places array<int>")
    # one row per relation, so both sides that describe relations are broadcast
    plan = sets.groupBy("relation").agg(F.collect_list(F.struct("mask", "places")).alias("sets")).join(books, "relation")
    coded = tuples.join(F.broadcast(plan), "relation").withColumn(
        "codes", F.transform("keys", lambda key, i: F.array_position(F.element_at("book", i), key) - 1)
    )
    spread = coded.select("relation", "book", "codes", "present", F.explode("sets").alias("s"))
    code = F.aggregate(
        F.col("s.places"), F.lit(0).cast("long"), lambda a, p: a * F.size(F.element_at("book", p)) + F.get(F.col("codes"), p)
    )
    spread = spread.select("relation", F.col("s.mask").alias("mask"), "present", code.alias("code")).where("code is not null")
    bit = F.expr("shiftleft(1L, cast(code % 64 as int))")
    most = max(len(s.values) for s in shapes)
    words = spread.groupBy("relation", "mask", F.expr("code div 64").alias("word")).agg(
        *[F.bit_or(F.when(F.get("present", F.lit(i)), bit)).alias(f"w{i}") for i in range(most)]
    )
    counts = words.groupBy("relation", "mask").agg(F.array(*[F.sum(F.bit_count(f"w{i}")) for i in range(most)]).alias("n"))
    counts = counts.select("relation", "mask", F.posexplode("n").alias("value_at", "n")).where("n is not null")
    return counts, sets, spark.createDataFrame(refused, "relation string, attributes string, estimated_cells long")


def _named(mask: Column, places: Column, names: Column) -> Column:
    inside = F.filter(places, lambda p: mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p)) != 0)
    return F.array_join(F.transform(inside, lambda p: F.get(names, p)), "; ")


class Catalogue(NamedTuple):
    """``pivots`` and ``refused`` attribute sets as tables, and the shapes of the relations that were searched."""

    pivots: DataFrame
    refused: DataFrame
    shapes: list[Shape]


PIVOTS = (
    "dataset string, relation string, relation_type string, row_attributes string, column_attributes string, value_attribute string, "
    "num_row_attributes int, num_column_attributes int, pivot_rows long, pivot_columns long, pivot_cells long, non_nan_density double, "
    "source_rows long, source_columns int, total_header_levels int, min_header_side_levels int"
)


def dense_pivots(
    spark: SparkSession,
    dataset: str,
    relations: dict[str, DataFrame],
    kinds: dict[str, str] | None = None,
    guard: int = MAX_CELLS,
    most_per_side: int = MOST_PER_SIDE,
) -> Catalogue:
    """All dense pivots of the relations: at least MIN_SIDE lines on each side, MIN_DENSITY of the cells filled.

    Rows without an axis value or without the value take no part. Relations with fewer than MIN_ROWS rows or MIN_COLUMNS
    columns have no pivots, and neither have those without two axes and a value.
    """
    shapes = _shapes(relations, kinds or {})
    if not shapes:
        return Catalogue(spark.createDataFrame([], PIVOTS), spark.createDataFrame([], "relation string, attributes string, estimated_cells long"), [])
    tuples = materialise(reduce(DataFrame.unionByName, [_tuples(relations[s.relation], s) for s in shapes]), "axis-tuples")
    counts, sets, refused = _counted(spark, shapes, tuples, guard)
    counts = materialise(counts, "set-counts")
    about = spark.createDataFrame(
        [(s.relation, s.kind, s.rows, s.columns, list(s.axes), list(s.values)) for s in shapes],
        "relation string, relation_type string, source_rows long, source_columns int, axes array<string>, vals array<string>",
    )
    halves = sets.where("size(places) > 1").withColumn("half", F.expr("explode(sequence(1, (1 << size(places)) - 2))"))
    r_mask = F.expr("aggregate(sequence(0, size(places) - 1), 0L, (a, i) -> a + if((half >> i) & 1 = 1, shiftleft(1L, places[i]), 0L))")
    halves = halves.withColumn("r_mask", r_mask).withColumn("c_mask", F.col("mask") - F.col("r_mask"))
    halves = halves.where((F.bit_count("r_mask") <= most_per_side) & (F.bit_count("c_mask") <= most_per_side))

    def counted(name: str, mask: str) -> DataFrame:
        return counts.select("relation", F.col("mask").alias(mask), "value_at", F.col("n").alias(name))

    found = halves.join(counted("filled", "mask"), ["relation", "mask"])
    found = found.join(counted("pivot_rows", "r_mask"), ["relation", "r_mask", "value_at"])
    found = found.join(counted("pivot_columns", "c_mask"), ["relation", "c_mask", "value_at"])
    found = found.withColumn("pivot_cells", F.col("pivot_rows") * F.col("pivot_columns"))
    found = found.withColumn("non_nan_density", F.col("filled") / F.col("pivot_cells"))
    found = found.where((F.col("pivot_rows") >= MIN_SIDE) & (F.col("pivot_columns") >= MIN_SIDE) & (F.col("non_nan_density") >= MIN_DENSITY))
    levels = {"num_row_attributes": F.bit_count("r_mask"), "num_column_attributes": F.bit_count("c_mask")}
    found = found.join(F.broadcast(about), "relation").withColumns(levels)
    pivots = found.select(
        F.lit(dataset).alias("dataset"),
        "relation",
        "relation_type",
        _named(F.col("r_mask"), F.col("places"), F.col("axes")).alias("row_attributes"),
        _named(F.col("c_mask"), F.col("places"), F.col("axes")).alias("column_attributes"),
        F.get("vals", F.col("value_at")).alias("value_attribute"),
        *levels,
        "pivot_rows",
        "pivot_columns",
        "pivot_cells",
        "non_nan_density",
        "source_rows",
        "source_columns",
        F.size("places").alias("total_header_levels"),
        F.least(*levels).alias("min_header_side_levels"),
    )
    return Catalogue(pivots, refused, shapes)

"""Pivots in long form.

A pivot is a set of cells ``(row_path, col_path, value)``.  Density needs three distinct counts, so
searching over many attribute splits never materialises a wide table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.sampling import digest
from tabloom.operators.ranking import top_rows
from tabloom.session import materialise

# Limits of the searches.
MIN_SIDE = 3
MIN_DENSITY = 0.95
#: Cells of a candidate's whole grid, a byte each, up to which one task trims it.
MAX_GRID_CELLS = 50_000_000
SHRINK_RANGE = (2, 10)


def paths(df: DataFrame, rows: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Add ``row_path`` and ``col_path`` and drop rows with a NULL axis key."""
    keep = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*rows, *cols]])
    return (
        df.filter(keep)
        .withColumn("row_path", F.array(*[F.col(c).cast("string") for c in rows]))
        .withColumn("col_path", F.array(*[F.col(c).cast("string") for c in cols]))
    )


def pivot_cells(
    df: DataFrame, group: Sequence[str], rows: Sequence[str], cols: Sequence[str], value: str, how: str, order: str = ""
) -> DataFrame:
    """Long pivot: ``first`` in the given order, ``mean`` or ``max`` of the value per cell."""
    aggregate = {
        "first": lambda: F.min_by(value, order),
        "mean": lambda: F.sum(F.col(value).cast("decimal(18,2)")).cast("double") / F.count(value),
        "max": lambda: F.max(value),
    }[how]()
    # grouped by the plain columns, which sort and hash faster than the paths made of them
    cells = df.filter(F.col(value).isNotNull()).groupBy(*group, *rows, *cols).agg(aggregate.alias("_value"))
    return paths(cells, rows, cols).select(*group, "row_path", "col_path", F.col("_value").alias("value"))


def density(df: DataFrame, group: Sequence[str], rows: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Shape and share of filled cells of a pivot, without building it."""
    cells = df.select(*group, *rows, *cols).dropna(subset=[*rows, *cols])
    counted = cells.groupBy(*group, *rows, *cols).agg(F.lit(1).alias("_one"))
    shape = counted.groupBy(*group).agg(
        F.countDistinct(F.struct(*rows)).alias("pivot_rows"),
        F.countDistinct(F.struct(*cols)).alias("pivot_columns"),
        F.count(F.lit(1)).alias("filled"),
    )
    return shape.withColumn("density", F.col("filled") / (F.col("pivot_rows") * F.col("pivot_columns")))


def axis_key(columns: Sequence[str]):
    """One text key for an axis tuple; NULL when a part is NULL, as pivots leave such rows out."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return F.when(present, F.concat_ws("\u0001", *[F.col(c).cast("string") for c in columns]))


def splits_of(attributes: Sequence[str], most: int | None = None) -> list[tuple[list[str], list[str]]]:
    """All row/column splits, most column attributes first; with ``most`` only those with at most so many of these."""
    found = []
    for size in range(min(most or len(attributes), len(attributes)), 0, -1):
        for cols in combinations(attributes, size):
            rows = [c for c in attributes if c not in cols]
            if rows:
                found.append((rows, list(cols)))
    return found


def split_search(df: DataFrame, group: Sequence[str], attributes: Sequence[str], seed: int) -> DataFrame:
    """Per table a random full split, else a random one of the densest; one-wide pivots are out.

    A split uses all attributes, so every split has the same filled cells and its sides are
    distinct counts of attribute subsets: one aggregate gives all of them, and the choice is made
    inside the row of the table.
    """
    ordered = split_sides(attributes)
    tuples = df.select(*group, *attributes).dropna(subset=list(attributes)).distinct()
    counts = tuples.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_filled"),
        *[F.countDistinct(*[F.col(c) for c in s]).alias(name) for s, name in ordered.items()],
    )
    best = counts.withColumn("_best", best_split(group, attributes, seed)).filter(F.col("_best").isNotNull())
    return best.select(*group, "_best.layout", "_best.pivot_rows", "_best.pivot_columns", "_best.density")


def split_sides(attributes: Sequence[str]) -> dict[tuple[str, ...], str]:
    """The attribute subsets that are a side of some split, each with the name of its distinct count."""
    subsets = {tuple(s) for split in splits_of(attributes) for s in split}
    return {s: f"_n{i}" for i, s in enumerate(sorted(subsets))}


def best_split(group: Sequence[str], attributes: Sequence[str], seed: int) -> Column:
    """The split that ``split_search`` chooses, from the distinct counts ``_filled`` and those of ``split_sides``."""
    ordered, options = split_sides(attributes), []
    for rows, cols in splits_of(attributes):
        layout = F.lit("; ".join(rows) + " | " + "; ".join(cols))
        n_rows, n_cols = F.col(ordered[tuple(rows)]), F.col(ordered[tuple(cols)])
        share = F.col("_filled") / (n_rows * n_cols)
        usable = (n_rows > 1) & (n_cols > 1)
        options.append(
            F.when(
                usable,
                F.struct(
                    (F.col("_filled") != n_rows * n_cols).alias("holes"), (-share).alias("sparse"),
                    digest(seed, "split", *group, layout).alias("h"), layout.alias("layout"),
                    n_rows.alias("pivot_rows"), n_cols.alias("pivot_columns"), share.alias("density"),
                ),
            )
        )
    return F.array_min(F.array(*options))


CATALOG_ORDER = [
    ("non_nan_density", False), ("total_header_levels", False), ("min_header_side_levels", False),
    ("pivot_cells", False), ("pivot_rows", False), ("pivot_columns", False), ("dataset", True),
    ("relation", True), ("value_attribute", True), ("row_attributes", True), ("column_attributes", True),
]


def catalog_order() -> list:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in CATALOG_ORDER]


def shrink(cells: DataFrame, table: str, seed: int, low: int = SHRINK_RANGE[0], high: int = SHRINK_RANGE[1]) -> DataFrame:
    """Limit every pivot to ``high`` rows and columns; keys with a needed cell always stay.

    Tables with fewer than ``low`` keys on a side, or with more needed keys than fit, are rejected.
    Both sides are chosen from the full pivot, which is aggregated only once for that.
    """
    cells = out = materialise(cells, "pivot-cells")
    for path in ("row_path", "col_path"):
        marked = cells.groupBy(table, path).agg(F.max(F.col("needed").cast("int")).alias("must"))
        sizes = marked.groupBy(table).agg(F.count(F.lit(1)).alias("_n"), F.sum("must").alias("_must"))
        good = sizes.filter((F.col("_n") >= low) & ((F.col("_must") <= high) | (F.col("_n") < high))).select(table)
        ordered = marked.withColumn("_h", digest(seed, path, table, F.array_join(path, "|")))
        kept = top_rows(ordered, [table], [F.col("must").desc(), "_h"], high).select(table, path)
        out = out.join(kept.join(good, table, "left_semi"), [table, path], "left_semi")
    return out


def _trim(presence: np.ndarray, low: int, high: int):
    """Drop the sparsest line until both sides fit, then while that raises the density.

    Filled cells are counted per line once; a removed line is subtracted from the counts of the other side.
    """
    if min(presence.shape) < low:
        return None
    filled = [presence.sum(1, dtype=np.int64), presence.sum(0, dtype=np.int64)]
    alive = [np.arange(n) for n in presence.shape]
    total = int(filled[0].sum())

    def weakest(axis):
        """Place of the sparsest line of a side, and its filled cells."""
        at = int(filled[axis][alive[axis]].argmin())
        return at, int(filled[axis][alive[axis][at]])

    def drop(axis, at, cells):
        line = alive[axis][at]
        alive[axis] = np.delete(alive[axis], at)
        filled[1 - axis] -= presence[line] if axis == 0 else presence[:, line]
        return total - cells

    def density(cells, axis=None):
        rows, cols = (len(alive[side]) - (axis == side) for side in (0, 1))
        return cells / (rows * cols)

    while wide := [axis for axis in (0, 1) if len(alive[axis]) > high]:
        found = {axis: weakest(axis) for axis in wide}
        axis = min(wide, key=lambda x: (found[x][1] / len(alive[1 - x]), x))
        total = drop(axis, *found[axis])
    while free := [axis for axis in (0, 1) if len(alive[axis]) > low]:
        found = {axis: weakest(axis) for axis in free}
        axis = max(free, key=lambda x: (density(total - found[x][1], x), -x))
        if density(total - found[axis][1], axis) <= density(total):
            break
        total = drop(axis, *found[axis])
    return alive[0], alive[1]


TRIMMED = "candidate string, row_ids array<bigint>, col_ids array<bigint>, density double, filled bigint"


def trim_dense(numbered: DataFrame, group: str, low: int, high: int) -> DataFrame:
    """Dense sub-matrix per candidate of ``(group, row_id, col_id)`` with ids from 1, see ``numbered``."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((pdf.row_id.max(), pdf.col_id.max()), dtype=np.uint8)
        grid[pdf.row_id.to_numpy() - 1, pdf.col_id.to_numpy() - 1] = 1
        kept = _trim(grid, low, high)
        if kept is None:
            return pd.DataFrame(columns=["candidate", "row_ids", "col_ids", "density", "filled"])
        part = grid[np.ix_(*kept)]
        return pd.DataFrame(
            {
                "candidate": [key[0]],
                "row_ids": [(kept[0] + 1).tolist()],
                "col_ids": [(kept[1] + 1).tolist()],
                "density": [float(part.mean())],
                "filled": [int(part.sum())],
            }
        )

    return numbered.groupBy(group).applyInPandas(one, TRIMMED)


def pair_candidates(columns: Sequence[str]) -> list[tuple[list[str], list[str]]]:
    """Ways to put two of four columns on each axis, without mirrored repeats."""
    found = []
    for four in combinations(columns, 4):
        for rows in combinations(four, 2):
            cols = tuple(c for c in four if c not in rows)
            if rows <= cols:
                found.append((list(rows), list(cols)))
    return found


def candidate_presence(df: DataFrame, candidates, value: str) -> DataFrame:
    """Occupied cells ``(candidate, r, c)`` of all candidates in one frame."""
    attributes = sorted({c for rows, cols in candidates for c in [*rows, *cols]})
    tuples = df.filter(F.col(value).isNotNull()).select(*attributes).distinct()
    tagged = F.array(
        *[
            F.struct(
                F.lit("; ".join(r) + " | " + "; ".join(c)).alias("candidate"),
                axis_key(r).alias("r"),
                axis_key(c).alias("c"),
            )
            for r, c in candidates
        ]
    )
    return tuples.select(F.explode(tagged).alias("t")).select("t.*").dropna().distinct()


def candidate_sizes(presence: DataFrame) -> DataFrame:
    """(candidate, rows, cols, fits): whether the grid of a candidate is small enough to be trimmed in one task."""
    line = [F.struct(F.lit(side).alias("side"), F.col(side).alias("key")) for side in ("r", "c")]
    sides = presence.select("candidate", F.explode(F.array(*line)).alias("s"))
    keys = sides.select("candidate", "s.side", "s.key").distinct()
    sizes = keys.groupBy("candidate").agg(F.count(F.when(F.col("side") == "r", 1)).alias("rows"), F.count(F.when(F.col("side") == "c", 1)).alias("cols"))
    return sizes.withColumn("fits", F.col("rows") * F.col("cols") <= MAX_GRID_CELLS)


def numbered(presence: DataFrame) -> DataFrame:
    """Presence cells of the candidates that fit, with ids from 1 per candidate and side; ``candidate_sizes`` tells the others.

    Ids are only given where the grid is bounded, so a numbering window holds a bounded number of keys.
    """
    cells = presence.join(candidate_sizes(presence).filter("fits").select("candidate"), "candidate", "left_semi")

    def ids(side):
        window = Window.partitionBy("candidate").orderBy(side)
        return cells.select("candidate", side).distinct().withColumn(f"{side}_id", F.row_number().over(window))

    return (
        cells.join(ids("r"), ["candidate", "r"])
        .join(ids("c"), ["candidate", "c"])
        .select("candidate", "r", "c", F.col("r_id").alias("row_id"), F.col("c_id").alias("col_id"))
    )


def densest_pivot(df: DataFrame, columns: Sequence[str], value: str, low: int, high: int) -> DataFrame:
    """Cells of the best 2 x 2 attribute pivot by density + 0.01 * filled, empty cells included."""
    candidates = pair_candidates(columns)
    presence = materialise(numbered(candidate_presence(df, candidates, value)), "presence")
    trimmed = trim_dense(presence.select("candidate", "row_id", "col_id"), "candidate", low, high)
    score = F.col("density") + F.lit(0.01) * F.col("filled")
    best = trimmed.withColumn("score", score).orderBy(F.col("score").desc(), "candidate").limit(1)
    rows = presence.select("candidate", "r", "row_id").distinct()
    cols = presence.select("candidate", "c", "col_id").distinct()
    grid = (
        best.select("candidate", F.explode("row_ids").alias("row_id"), "col_ids")
        .select("candidate", "row_id", F.explode("col_ids").alias("col_id"))
        .join(rows, ["candidate", "row_id"])
        .join(cols, ["candidate", "col_id"])
        .select("candidate", "r", "c")
    )
    sums = [
        F.struct(
            F.lit("; ".join(r) + " | " + "; ".join(c)).alias("candidate"),
            axis_key(r).alias("r"),
            axis_key(c).alias("c"),
        )
        for r, c in candidates
    ]
    wanted = best.select("candidate")
    base = df.dropna(subset=[*columns, value]).groupBy(*columns).agg(
        F.sum(F.col(value).cast("decimal(18,2)")).alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    means = (
        base.select(F.explode(F.array(*sums)).alias("k"), "_s", "_n")
        .select("k.*", "_s", "_n")
        .join(wanted, "candidate", "left_semi")
        .groupBy("candidate", "r", "c")
        .agg((F.sum("_s").cast("double") / F.sum("_n")).alias("value"))
    )
    return grid.join(means, ["candidate", "r", "c"], "left").select(
        "candidate",
        F.regexp_replace("r", "\u0001", "; ").alias("row_key"),
        F.regexp_replace("c", "\u0001", "; ").alias("col_key"),
        "value",
    )

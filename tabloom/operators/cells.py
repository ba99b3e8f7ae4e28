"""Perturbations of samples whose few cells are held as an array.

A cell is a struct with the paths ``r`` and ``c`` as texts (levels joined by ``PATH_MARK``), ``value`` as text and
``needed``; cells of the relational form have ``row_id``, the attributes ``at`` and ``price`` as well. All choices are the
digests of ``perturb`` and ``pivot``, so a sample looks the same whichever way it was made.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.arrays import let, lone
from tabloom.functions.sampling import digest, pick_int, uniform
from tabloom.operators import perturb
from tabloom.operators.perturb import PATH_MARK

#: The path of a line whose label is null; real paths are never this text.
NO_PATH = "\u0000"


def joined(path: Column) -> Column:
    """The text that digests are taken of: levels joined by bars."""
    return F.when(path == NO_PATH, "").otherwise(F.replace(path, F.lit(PATH_MARK), F.lit("|")))


def fields(cells: Column, *more: str) -> Column:
    """The cells with the fields of a pivot and some more."""
    return F.transform(cells, lambda x: F.struct(*[x[n].alias(n) for n in (*more, "r", "c", "value", "needed")]))


def fitting(cells: Column, side: str, key: str, seed: int, draw: str, low: int, high: int) -> Column:
    """The lines of one side that stay: those with a needed cell, then those that the draw puts first.

    None if there are fewer than ``low`` lines or more needed ones than fit.
    """

    def kept(must: Column, lines: Column) -> Column:
        place = lambda x: F.struct(~F.array_contains(must, x), digest(seed, draw, key, joined(x)), x.alias("line"))
        first = F.transform(F.slice(F.sort_array(F.transform(lines, place)), 1, high), lambda x: x["line"])
        good = (F.size(lines) >= low) & ((F.size(must) <= high) | (F.size(lines) < high))
        return F.when(~good, F.array().cast("array<string>")).when(F.size(lines) <= high, lines).otherwise(first)

    must = F.array_distinct(F.transform(F.filter(cells, lambda x: x["needed"]), lambda x: x[side]))
    return let(must, lambda m: let(F.array_distinct(F.transform(cells, lambda x: x[side])), lambda lines: kept(m, lines)))


def shrunk(cells: Column, key: str, seed: int, low: int, high: int) -> Column:
    """The cells whose lines fit on both sides."""
    sides = [fitting(cells, side, key, seed, draw, low, high) for side, draw in (("r", "row_path"), ("c", "col_path"))]
    return let(
        F.struct(sides[0].alias("r"), sides[1].alias("c")),
        lambda kept: F.filter(cells, lambda x: F.array_contains(kept["r"], x["r"]) & F.array_contains(kept["c"], x["c"])),
    )


def entity_missing(cells: Column, table: str, seed: int) -> Column:
    """Without one needed row."""
    drawn = F.transform(
        F.filter(cells, lambda x: x["needed"]), lambda x: F.struct(digest(seed, "missing", table, x["row_id"]).alias("h"), x["row_id"].alias("row_id"))
    )
    return let(F.array_min(drawn)["row_id"], lambda gone: F.filter(cells, lambda x: F.coalesce(x["row_id"] != gone, F.lit(True))))


def contradicted(cells: Column, table: str, seed: int, digits: int) -> Column:
    return F.transform(cells, lambda x: x.withField("value", perturb.contradicted([F.col(table), x["row_id"]], x["price"], seed, digits)))


def nulled(cells: Column, table: str, seed: int) -> Column:
    def lost(token: Column) -> Column:
        return F.transform(cells, lambda x: x.withField("value", perturb.nulled(table, [x["row_id"]], x["value"], seed, x["needed"], token)))

    return let(perturb.null_token(table, seed), lost)


def pivoted(cells: Column) -> Column:
    """First value per cell; a needed row overrides the others, so its cell is restored."""

    def cell(key: Column) -> Column:
        def one(mine: Column) -> Column:
            known = F.filter(mine, lambda x: x["row_id"].isNotNull())
            pair = lambda x: F.struct(x["row_id"].alias("row_id"), x["value"].alias("value"))
            restored = F.array_max(F.transform(F.filter(known, lambda x: x["needed"]), pair))["value"]
            first = F.array_min(F.transform(known, pair))["value"]
            return F.struct(key["r"].alias("r"), key["c"].alias("c"), F.coalesce(restored, first).alias("value"), F.exists(mine, lambda x: x["needed"]).alias("needed"))

        return let(F.filter(cells, lambda x: (x["r"] == key["r"]) & (x["c"] == key["c"])), one)

    def of(keys: Column) -> Column:
        alone = lambda x: F.struct(x["r"].alias("r"), x["c"].alias("c"), F.when(x["row_id"].isNotNull(), x["value"]).alias("value"), x["needed"].alias("needed"))
        return F.when(lone(keys), F.transform(cells, alone)).otherwise(F.transform(F.array_distinct(keys), cell))

    return let(F.transform(cells, lambda x: F.struct(x["r"].alias("r"), x["c"].alias("c"))), of)


def merged(cells: Column, sample: Column, branches: Column, columns: Sequence[str], value: str, seed: int) -> Column:
    """The cells in the layout that two merged columns give, see ``perturb.merge_columns``; as they are if the merge is left out."""
    names = [*columns, value]
    drawn = F.array_sort(F.array(*[F.struct(digest(seed, "merge", sample, F.lit(n)).alias("h"), F.lit(n).alias("n")) for n in names]))

    def text(x: Column, name: Column) -> Column:
        return reduce(lambda a, c: F.when(name == c, x["at"][c].cast("string")).otherwise(a), columns, F.when(name == value, x["value"]))

    def collapses(name: Column) -> Column:
        def left_out(c: str) -> Column:
            rest = F.transform(branches, lambda b: F.struct(*[b[k].alias(k) for k in columns if k != c], F.lit(0).alias("_")))
            return F.size(F.array_distinct(rest)) < F.size(branches)

        flags = {c: left_out(c) for c in columns}
        return F.coalesce(reduce(lambda a, c: F.when(name == c, flags[c]).otherwise(a), columns, F.lit(False)), F.lit(False))

    def plan(order: Column) -> Column:
        c1, c2 = order[0]["n"], order[1]["n"]
        absorbed = F.when(c1 == value, c2).when(c2 == value, c1)
        rest = F.array_except(F.array(*[F.lit(c) for c in columns]), F.array(c1, c2))
        return F.struct(
            c1.alias("c1"), c2.alias("c2"), absorbed.isNotNull().alias("is_value"), F.get(rest, F.lit(0)).alias("rest0"),
            F.get(rest, F.lit(1)).alias("rest1"), (absorbed.isNotNull() & collapses(absorbed)).alias("skipped"),
        )

    def laid_out(how: Column, x: Column) -> Column:
        merged_value = F.concat(text(x, how["c1"]), F.lit(" ("), text(x, how["c2"]), F.lit(")"))
        rest = text(x, how["rest0"])
        path = lambda p: F.coalesce(p, F.lit(NO_PATH))
        r = path(F.when(how["is_value"], rest).otherwise(merged_value))
        c = path(F.when(how["is_value"], text(x, how["rest1"])).otherwise(rest))
        shown = F.when(how["is_value"], merged_value).otherwise(x["value"])
        return F.struct(x["row_id"].alias("row_id"), r.alias("r"), c.alias("c"), shown.alias("value"), x["needed"].alias("needed"))

    return let(
        let(drawn, plan),
        lambda how: F.when(how["skipped"], fields(cells, "row_id")).otherwise(F.transform(cells, lambda x: laid_out(how, x))),
    )

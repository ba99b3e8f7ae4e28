"""Question-answering samples over discovered pivots of many relations.

The distinct axis tuples of all relations lie in one store of cells, with the first row of each; catalogue entries are
rows that are joined to it. So neither the number of entries nor that of their attributes shows in the plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.numbers import plain
from tabloom.functions.sampling import digest
from tabloom.operators import pivot
from tabloom.operators.catalogue import Shape
from tabloom.operators.datasets import _cells_wanted, rendered, sample_labels
from tabloom.operators.labels import MAX_TUPLES
from tabloom.operators.ranking import top_rows
from tabloom.operators.views import MAX_TABLE_CELLS
from tabloom.session import materialise
from tabloom.sources.html import escape, join_all, tag

METHODS = ["average", "sum", "superlative"]


def cell_store(relations: dict[str, DataFrame], shapes: Sequence[Shape], keys: dict[str, Column]) -> DataFrame:
    """(relation, axes, firsts): the distinct axis tuples of the relations that have a key, as text.

    ``firsts`` holds per value column the first row of the tuple that has a value, by its key, and that value as decimal.
    The first row of a cell is then that of its tuples, so cells never look at rows again.
    """
    parts = []
    for s in shapes:
        if s.relation not in keys:
            continue
        axes = [F.col(f"`{c}`").cast("string").alias(f"_a{i}") for i, c in enumerate(s.axes)]
        vals = [F.col(f"`{c}`").cast("decimal(28,6)").alias(f"_v{i}") for i, c in enumerate(s.values)]
        rows = relations[s.relation].select(*axes, *vals, keys[s.relation].cast("string").alias("row"))
        firsts = [F.min(F.when(F.col(f"_v{i}").isNotNull(), F.struct("row", F.col(f"_v{i}").alias("value")))).alias(f"_f{i}") for i in range(len(vals))]
        tuples = rows.groupBy(*[f"_a{i}" for i in range(len(axes))]).agg(*firsts)

        def entries(columns: Sequence[str], prefix: str) -> Column:
            return F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(f"{prefix}{i}") for i in range(len(columns))]))

        parts.append(tuples.select(F.lit(s.relation).alias("relation"), entries(s.axes, "_a").alias("axes"), entries(s.values, "_f").alias("firsts")))
    return reduce(DataFrame.unionByName, parts)


def entry_cells(store: DataFrame, entries: DataFrame, broadcast_entries: int = 10_000) -> DataFrame:
    """(entry, relation, row_path, col_path, row, value): per entry and tuple of its attributes the first row's value.

    First is the smallest row key. Rows without one of the attributes or without the value take no part. Up to
    ``broadcast_entries`` entries are broadcast to the store; beyond, both are joined by relation.
    """
    names = ["relation", "row_attributes", "column_attributes", "value_attribute"]
    wanted = entries.select(*names).distinct()
    wanted = wanted.select(
        "relation",
        F.concat_ws("|", *names).alias("entry"),
        F.split("row_attributes", "; ").alias("_r"),
        F.split("column_attributes", "; ").alias("_c"),
        "value_attribute",
    )
    wanted = F.broadcast(wanted) if wanted.count() <= broadcast_entries else wanted
    path = lambda side: F.transform(side, lambda a: F.element_at("axes", a))
    whole = lambda side: F.forall(side, lambda x: x.isNotNull())
    tuples = store.join(wanted, "relation").select(
        "entry", "relation", path("_r").alias("row_path"), path("_c").alias("col_path"), F.element_at("firsts", F.col("value_attribute")).alias("first")
    )
    tuples = tuples.where(F.col("first").isNotNull() & whole("row_path") & whole("col_path"))
    firsts = tuples.groupBy("entry", "relation", "row_path", "col_path").agg(F.min("first").alias("first"))
    return firsts.select("entry", "relation", "row_path", "col_path", "first.row", "first.value")


class Discovered(NamedTuple):
    """``labels`` per (entry, method), and the tables a sample shows: ``rows`` as a relation, ``cells`` as a pivot."""

    labels: DataFrame
    rows: DataFrame
    cells: DataFrame


def discovered(store: DataFrame, entries: DataFrame, seed: int, methods: Sequence[str] = METHODS) -> Discovered:
    """Samples of every entry and method.

    The relational form is cut to MAX_TABLE_CELLS cells and the pivot to the display size; both keep what the answer needs.
    """
    cells = materialise(entry_cells(store, entries), "discovered")
    joined = lambda side: F.array_join(side, "|")
    spread = cells.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    asked = spread.withColumn("_h", digest(seed, "discovered", "entry", "method", joined("row_path"), joined("col_path")))
    asked = top_rows(asked, ["entry", "method"], ["_h", "row"], MAX_TUPLES).withColumn("wanted", _cells_wanted("entry", seed))
    asked = materialise(asked.where("rn <= wanted").drop("_h"), "asked")
    labels = sample_labels(asked.withColumn("value", F.col("value").cast("double")), "entry", "value", seed)
    needed = asked.select("entry", "method", "row_path", "col_path", F.lit(True).alias("needed"))
    marked = spread.join(labels.select("entry", "method"), ["entry", "method"], "left_semi")
    marked = marked.join(needed, ["entry", "method", "row_path", "col_path"], "left").withColumn("needed", F.coalesce("needed", F.lit(False)))
    marked = materialise(marked, "marked")
    wide = F.size("row_path") + F.size("col_path") + 1
    room = F.greatest(F.floor(F.lit(MAX_TABLE_CELLS) / wide), F.lit(1))
    rows = top_rows(marked, ["entry", "method"], [F.desc("needed"), "row", "row_path", "col_path"], MAX_TABLE_CELLS)
    rows = rows.where(F.col("needed") | (F.col("rn") <= room)).drop("rn")
    cells = pivot.shrink(marked.withColumn("variant", F.concat_ws("|", "entry", "method")), "variant", seed)
    return Discovered(labels, rows, cells)


def pages(found: Discovered, seed: int) -> DataFrame:
    """(entry, method, label, relational_html, pivot_html) of every sample; a table has at most a hundred cells or lines."""
    number = plain(F.col("value"), 4)
    cell = lambda side: join_all(F.transform(side, lambda x: tag("td", escape(x))))
    line = tag("tr", F.concat(cell("row_path"), cell("col_path"), tag("td", number)))
    head = F.split("entry", r"\|")
    titles = F.concat(F.split(head[1], "; "), F.split(head[2], "; "), F.array(head[3]))
    relational = found.rows.groupBy("entry", "method").agg(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))).alias("lines"))
    body = join_all(F.transform("lines", lambda x: x["line"]))
    thead = tag("thead", tag("tr", join_all(F.transform(titles, lambda x: tag("th", escape(x))))))
    relational = relational.select("entry", "method", tag("table", F.concat(thead, tag("tbody", body))).alias("relational_html"))
    # the renderer names a variant by three parts; the entry's own name holds bars
    keyed = found.cells.select(
        F.concat(F.md5("entry"), F.lit("|"), "method", F.lit("|none")).alias("variant"), "row_path", "col_path", number.alias("value"), F.lit(False).alias("header")
    )
    pivoted = rendered(keyed, "entry_digest", seed, "", "").select("entry_digest", "method", F.col("html").alias("pivot_html"))
    named = found.labels.withColumn("entry_digest", F.md5("entry"))
    return named.join(relational, ["entry", "method"]).join(pivoted, ["entry_digest", "method"], "left").drop("entry_digest")

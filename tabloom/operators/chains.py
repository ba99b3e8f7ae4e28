"""Questions chained over tables: the answer of one table is the key of the next.

A chain is rows, ``(chain, step, relation, key_column, answer_column)`` with steps from 1, and all rows of all relations
lie in one store ``(relation, row, cells)``. So every chain over any tables runs through the same joins on (chain, step,
key); only the number of steps of the longest chain shows in the plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.numbers import plain
from tabloom.functions.sampling import digest
from tabloom.operators.questions import templated
from tabloom.operators.ranking import top_rows
from tabloom.operators.views import MAX_TABLE_CELLS, PLACEHOLDER
from tabloom.session import materialise
from tabloom.sources.html import escape, join_all, tag

STEPS = "chain string, step int, relation string, key_column string, answer_column string, shown array<string>"


def row_store(relations: dict[str, DataFrame], keys: dict[str, Column]) -> DataFrame:
    """(relation, row, cells): every row as a map from column to text."""
    parts = []
    for name, df in relations.items():
        flat = [f.name for f in df.schema.fields]
        cells = F.map_from_arrays(F.array(*[F.lit(c) for c in flat]), F.array(*[F.col(f"`{c}`").cast("string") for c in flat]))
        parts.append(df.select(F.lit(name).alias("relation"), keys[name].cast("string").alias("row"), cells.alias("cells")))
    return reduce(DataFrame.unionByName, parts)


class Walked(NamedTuple):
    """``picked``: (chain, question, step, key, row, answer) of every step but the last; ``last``: the rows that the last
    step finds, (chain, question, key, row, value); ``rows``: the rows of the table that each step looks at."""

    picked: DataFrame
    last: DataFrame
    rows: DataFrame


def walk(store: DataFrame, steps: DataFrame, starts: DataFrame, seed: int, longest: int) -> Walked:
    """Follow all chains from ``starts`` (chain, question, key).

    At each step the table's rows with the key are found; one of them, drawn by the digest of its answer, gives the next
    key. The last step of a chain keeps all of its rows. A question whose step finds nothing ends there, without rows at
    the last step. Steps past ``longest``, the number of steps of the longest chain, are not walked.
    """
    last_step = steps.groupBy("chain").agg(F.max("step").alias("last_step"))
    wanted = F.broadcast(steps.join(last_step, "chain"))  # rows that describe chains, not data
    links = store.join(wanted, "relation").select(
        "chain",
        "step",
        "last_step",
        "relation",
        F.element_at("cells", F.col("key_column")).alias("key"),
        F.element_at("cells", F.col("answer_column")).alias("answer"),
        "row",
        F.transform("shown", lambda c: F.element_at("cells", c)).alias("shown"),
    )
    links = materialise(links.where("key is not null"), "chain-links")
    at = starts.select("chain", "question", F.col("key").cast("string").alias("key"), F.lit(1).alias("step"))
    picked, rows = [], []
    for step in range(1, longest + 1):
        here = materialise(at.join(links.where(F.col("step") == step), ["chain", "step", "key"]), "chain-rows")
        rows.append(here)
        inner = here.where("step < last_step and answer is not null")
        draw = F.struct(digest(seed, "chain", "chain", "step", "answer").alias("h"), F.col("row"), F.col("answer"))
        one = inner.groupBy("chain", "question", "step", "key").agg(F.min(draw).alias("p"))
        one = materialise(one.select("chain", "question", "step", "key", "p.row", "p.answer"), "chain-picks")
        picked.append(one)
        at = one.select("chain", "question", F.col("answer").alias("key"), (F.col("step") + 1).alias("step"))
    found = reduce(DataFrame.unionByName, rows)
    last = found.where("step = last_step").select("chain", "question", "key", "row", F.col("answer").alias("value"))
    return Walked(reduce(DataFrame.unionByName, picked), last, found)


def asked_rows(walked: Walked, seed: int, most: int | None = None) -> DataFrame:
    """The rows of the last table that a question is about: all, or ``most`` of them by digest, numbered ``rn``."""
    drawn = walked.last.where("value is not null").withColumn("_h", digest(seed, "asked", "chain", "row"))
    if most is None:
        return drawn.withColumn("rn", F.lit(1)).drop("_h")
    return top_rows(drawn, ["chain", "question"], ["_h", "row"], most).drop("_h")


def averages(asked: DataFrame) -> DataFrame:
    """(chain, question, rows, label): the mean of the last values."""
    value = F.col("value").cast("decimal(18,2)")
    return asked.groupBy("chain", "question").agg(
        F.count(F.lit(1)).alias("rows"), plain(F.sum(value).cast("double") / F.count(value)).alias("label")
    )


def paths(walked: Walked) -> DataFrame:
    """(chain, question, path): the answers on the way, in the order of the steps."""
    ordered = F.array_sort(F.collect_list(F.struct("step", "answer")))
    return walked.picked.groupBy("chain", "question").agg(F.array_join(F.transform(ordered, lambda x: x["answer"]), " > ").alias("path"))


def shown_rows(walked: Walked, asked: DataFrame) -> DataFrame:
    """(chain, question, step, row, shown, needed): each step's table, cut to MAX_TABLE_CELLS around the needed rows."""
    needed = walked.picked.select("chain", "question", "step", "row").unionByName(
        asked.join(walked.rows.where("step = last_step").select("chain", "question", "step", "row"), ["chain", "question", "row"]).select(
            "chain", "question", "step", "row"
        )
    )
    marked = walked.rows.join(needed.distinct().withColumn("needed", F.lit(True)), ["chain", "question", "step", "row"], "left")
    marked = marked.withColumn("needed", F.coalesce("needed", F.lit(False)))
    room = F.greatest(F.floor(F.lit(MAX_TABLE_CELLS) / F.size("shown")), F.lit(1))
    ranked = top_rows(marked, ["chain", "question", "step"], [F.desc("needed"), "row"], MAX_TABLE_CELLS)
    kept = ranked.where(F.col("needed") | (F.col("rn") <= room))
    return kept.select("chain", "question", "step", "row", "shown", "needed")


def documents(shown: DataFrame, steps: DataFrame) -> DataFrame:
    """(chain, question, text): the tables of a question one after another, as HTML; each has at most a hundred rows."""
    cells = lambda side, name: join_all(F.transform(side, lambda x: tag(name, escape(F.coalesce(x, F.lit(""))))))
    lines = shown.groupBy("chain", "question", "step").agg(
        F.array_sort(F.collect_list(F.struct("row", tag("tr", cells("shown", "td")).alias("line")))).alias("lines")
    )
    heads = F.broadcast(steps.select("chain", "step", F.col("shown").alias("titles")))
    body = join_all(F.transform("lines", lambda x: x["line"]))
    page = tag("table", F.concat(tag("thead", tag("tr", cells("titles", "th"))), tag("tbody", body)))
    pages = lines.join(heads, ["chain", "step"]).select("chain", "question", "step", page.alias("html"))
    ordered = F.array_sort(F.collect_list(F.struct("step", "html")))
    titled = F.transform(ordered, lambda x, i: F.concat(F.lit("Table "), (i + 1).cast("string"), F.lit(":\n"), x["html"]))
    return pages.groupBy("chain", "question").agg(F.array_join(titled, "\n\n").alias("text"))


def questions(walked: Walked, asked: DataFrame, steps: DataFrame, starts: DataFrame, aggregate: str = "AVG") -> DataFrame:
    """(chain, question, text): the first key is named, later ones depend on the answer before, the last rows are listed."""
    shape = ["chain", "question", "step", "branch", "pos", "col", "op", "value", "is_last"]
    fixed = {"branch": F.lit(1), "pos": F.lit(0), "op": F.lit("=")}
    told = F.when(F.col("step") == 1, F.col("start")).otherwise(F.lit(PLACEHOLDER))
    begin = starts.select("chain", "question", F.col("key").cast("string").alias("start"))
    lookups = begin.join(F.broadcast(steps), "chain").withColumns({**fixed, "value": told, "is_last": F.lit(False), "col": F.col("key_column")})
    last = steps.groupBy("chain").agg(F.max_by("answer_column", "step").alias("target"), F.max("step").alias("step"))
    branches = asked.join(F.broadcast(last), "chain").withColumns({**fixed, "branch": F.col("rn"), "col": F.lit("Row"), "value": F.col("row"), "is_last": F.lit(True)})
    key = F.concat_ws("|", "chain", "question")
    preds = lookups.select(*shape).unionByName(branches.select(*shape)).withColumn("_q", key)
    ends = walked.last.select("chain", "question").distinct().join(F.broadcast(last), "chain").withColumn("_q", key)
    texts = templated(preds, "_q", ends.select("_q", F.lit(aggregate).alias("aggregate"), "target"))
    return ends.select("_q", "chain", "question").join(texts, "_q").drop("_q")


def inclusions(relations: dict[str, DataFrame], columns: dict[str, Sequence[str]]) -> DataFrame:
    """(child_relation, child_column, parent_relation, parent_column): possible foreign keys.

    The child's values are all among the parent's, and the parent's are unique and never NULL. Values are aggregated to
    (column, value, count) first; columns then meet per value, at most as many as were listed, and a pair of columns is an
    inclusion if it meets on every value of the child.
    """
    listed = [(name, c) for name, some in columns.items() for c in some]
    parts = [
        relations[name].select(F.lit(i).alias("at"), F.col(f"`{c}`").cast("string").alias("value")) for i, (name, c) in enumerate(listed)
    ]
    counted = reduce(DataFrame.unionByName, parts).groupBy("at", "value").agg(F.count(F.lit(1)).alias("n"))
    counted = materialise(counted, "column-values")
    about = counted.groupBy("at").agg(
        F.count("value").alias("size"), F.max("n").alias("most"), F.bool_or(F.col("value").isNull()).alias("holes")
    )
    unique = F.broadcast(about.where("most = 1 and not holes").select(F.col("at").alias("parent")))
    met = counted.where("value is not null").groupBy("value").agg(F.collect_set("at").alias("ats"))
    pairs = met.select("ats", F.explode("ats").alias("parent")).join(unique, "parent")
    pairs = pairs.select("parent", F.explode("ats").alias("child")).where("parent <> child").groupBy("parent", "child").agg(F.count(F.lit(1)).alias("n"))
    whole = pairs.join(F.broadcast(about.select(F.col("at").alias("child"), "size")), "child").where("n = size")
    names = F.array(*[F.struct(F.lit(name).alias("relation"), F.lit(c).alias("col")) for name, c in listed])
    child, parent = F.get(names, F.col("child")), F.get(names, F.col("parent"))
    return whole.select(
        child["relation"].alias("child_relation"),
        child["col"].alias("child_column"),
        parent["relation"].alias("parent_relation"),
        parent["col"].alias("parent_column"),
    )

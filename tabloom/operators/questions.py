"""Question texts from predicate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import camel_to_words, predicate_text
from tabloom.operators.views import PLACEHOLDER

# Aggregate names in question texts.
AGGREGATES = {"AVG": "average", "SUM": "summation", "MIN": "min", "MAX": "max", "COUNT": "count"}


def templated(preds: DataFrame, question: str, last: DataFrame) -> DataFrame:
    """``preds``: (question, step, branch, pos, col, op, value, is_last); ``last``: (question, aggregate, target).

    All predicates but those of the last query become numbered constraints, each text once, in the
    order they appear; placeholders are skipped.  A question has a handful of predicates.
    """
    texts = preds.filter(F.lower("value") != PLACEHOLDER).withColumn(
        "_text", predicate_text(F.col("col"), F.col("op"), F.col("value"))
    )
    order = F.struct("step", "branch", "pos")
    firsts = texts.filter(~F.col("is_last")).groupBy(question, "_text").agg(F.min(order).alias("_at"))
    numbered = firsts.groupBy(question).agg(F.array_sort(F.collect_list(F.struct("_at", "_text"))).alias("_list"))
    constraints = numbered.select(
        question,
        F.transform("_list", lambda s, i: F.concat((i + 1).cast("string"), F.lit(") "), s["_text"])).alias("_constraints"),
    )
    parts = texts.filter("is_last").groupBy(question, "branch").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "_text"))), lambda s: F.concat(F.lit("the "), s["_text"])).alias("_p")
    )
    joined = F.concat(
        F.array_join(F.slice("_p", F.lit(1), F.size("_p") - 1), ", "), F.lit(" and "), F.element_at("_p", -1)
    )
    across = parts.select(question, "branch", joined.alias("_b")).groupBy(question).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("branch", "_b"))),
                lambda s, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), s["_b"]),
            ),
            "; ",
        ).alias("_across")
    )
    names = F.create_map(*[F.lit(x) for pair in AGGREGATES.items() for x in pair])
    kind = F.coalesce(names[F.upper("aggregate")], F.lit("exact"))
    target = camel_to_words(F.col("target"))
    what = F.when(
        (kind == "summation") & F.col("_across").isNotNull(), F.concat(F.lit("what is the summation of "), target)
    ).otherwise(F.concat(F.lit("what is the "), kind, F.lit(" value of "), target))
    where = F.coalesce(F.concat(F.lit(" where "), "_across"), F.lit(""))
    lines = F.concat(
        F.array(F.lit("Considering the following constraints:")),
        F.coalesce("_constraints", F.array().cast("array<string>")),
        F.array(F.lit(""), F.concat(what, where, F.lit("?"))),
    )
    return (
        last.join(constraints, question, "left")
        .join(across, question, "left")
        .select(question, F.array_join(lines, "\n").alias("text"))
    )

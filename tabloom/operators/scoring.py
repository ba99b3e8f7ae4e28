"""Scoring of model outputs: extraction, matching, token F1, accuracy."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tabloom.functions.numbers import LOOSE_NUMBER, first_number
from tabloom.functions.text import (
    after_last_marker,
    answer_tokens,
    first_list_element,
    normalize_alnum,
    strip,
    strip_markdown,
    strip_percent,
    yes_no_prefix,
)
from tabloom.sources.files import write_csv

# Fixed values.
MARKER = "Final answer:"
TOLERANCE = 0.005


def prediction_of(output: Column) -> Column:
    """The answer part of a model output."""
    return strip_percent(after_last_marker(strip_markdown(output), MARKER))


def exact_match(prediction: Column, label: Column, method: Column) -> Column:
    """Numbers agree after rounding (2 digits for percentage changes, else 6); other texts are
    compared without case and outer blanks."""
    p, g = first_number(prediction), first_number(label)
    same_text = F.lower(strip(prediction)) == F.lower(strip(label))
    numeric = p.isNotNull() & g.isNotNull()
    return (
        F.when(numeric & (method == "percentage_change"), F.round(p, 2) == F.round(g, 2))
        .when(numeric, F.round(p, 6) == F.round(g, 6))
        .otherwise(same_text)
    )


def tolerant_match(df: DataFrame, dataset: Sequence[str], prediction: str, label: str) -> DataFrame:
    """Match of the second scorer, which first decides per dataset whether all labels are numbers.

    The decision is one row per dataset, joined back on its key.
    """
    numbered = df.withColumn("_p", first_number(F.col(prediction), LOOSE_NUMBER)).withColumn(
        "_g", first_number(F.col(label), LOOSE_NUMBER)
    )
    mode = numbered.groupBy(*dataset).agg(F.bool_and(F.col("_g").isNotNull()).alias("_numeric"))
    near = F.coalesce(F.abs(F.col("_p") - F.col("_g")) < TOLERANCE, F.lit(False))
    words = lambda c: yes_no_prefix(normalize_alnum(F.col(c)))
    return (
        numbered.join(mode, list(dataset))
        .withColumn("match", F.when(F.col("_numeric"), near).otherwise(words(prediction) == words(label)))
        .drop("_p", "_g", "_numeric")
    )


def token_f1(df: DataFrame, key: Sequence[str], prediction: str, label: str) -> DataFrame:
    """Multiset token F1.

    Tokens of both sides are counted in one aggregate per (sample, token); the overlap is the sum
    of the smaller counts.  A sample without tokens on either side keeps its row.
    """
    tokens = lambda c, side: F.transform(
        answer_tokens(F.coalesce(F.col(c), F.lit(""))), lambda t: F.struct(t.alias("token"), F.lit(side).alias("side"))
    )
    exploded = df.select(*key, F.explode_outer(F.concat(tokens(prediction, "p"), tokens(label, "g"))).alias("_t"))
    side = F.col("_t.side")
    counts = exploded.groupBy(*key, F.col("_t.token").alias("token")).agg(
        F.count(F.when(side == "p", 1)).alias("p"), F.count(F.when(side == "g", 1)).alias("g")
    )
    totals = counts.groupBy(*key).agg(
        F.sum("p").alias("p"), F.sum("g").alias("g"), F.sum(F.least("p", "g")).alias("same")
    )
    precision, recall = F.col("same") / F.col("p"), F.col("same") / F.col("g")
    f1 = (
        F.when((F.col("p") == 0) & (F.col("g") == 0), F.lit(1.0))
        .when((F.col("p") == 0) | (F.col("g") == 0) | (F.col("same") == 0), F.lit(0.0))
        .otherwise(F.lit(2.0) * precision * recall / (precision + recall))
    )
    return totals.select(*key, f1.alias("f1"))


def scored(outputs: DataFrame) -> DataFrame:
    """``output, label, method`` -> prediction, cleaned label and strict match; no shuffle.

    Steps are columns of their own, so that a later one does not repeat the text work of the earlier.
    """
    return (
        outputs.withColumn("_plain", strip_markdown(F.col("output")))
        .withColumn("prediction", strip_percent(after_last_marker(F.col("_plain"), MARKER)))
        .withColumn("label", first_list_element(F.col("label")))
        .withColumn("match", exact_match(F.col("prediction"), F.col("label"), F.col("method")))
        .drop("_plain")
    )


def accuracy(df: DataFrame, dataset: Sequence[str]) -> DataFrame:
    hits = F.sum(F.col("match").cast("int"))
    return df.groupBy(*dataset).agg(
        F.count(F.lit(1)).alias("samples"), (hits / F.count(F.lit(1))).alias("accuracy")
    )


def evaluated(outputs: DataFrame, key: Sequence[str], dataset: Sequence[str]) -> DataFrame:
    """Strict accuracy and mean token F1 per dataset.

    Answers are one short text per sample, so their token overlap is computed inside the row; the
    only shuffle is the final aggregate.
    """
    rows = scored(outputs).withColumn("_p", answer_tokens(F.col("prediction"))).withColumn(
        "_g", answer_tokens(F.col("label"))
    )
    rows = rows.withColumn("f1", row_f1(F.col("_p"), F.col("_g")))
    n = F.count(F.lit(1))
    return rows.groupBy(*dataset).agg(
        n.alias("samples"),
        (F.sum(F.col("match").cast("int")) / n).alias("accuracy"),
        (F.sum(F.col("f1").cast("decimal(18,9)")).cast("double") / n).alias("mean_f1"),
    )


def row_f1(predicted: Column, gold: Column) -> Column:
    """Token F1 of two short token arrays; long texts use ``token_f1``."""
    times = lambda arr, t: F.size(F.filter(arr, lambda x: x == t))
    shared = F.array_distinct(F.array_intersect(predicted, gold))
    same = F.aggregate(shared, F.lit(0), lambda acc, t: acc + F.least(times(predicted, t), times(gold, t)))
    p, g = F.size(predicted), F.size(gold)
    return (
        F.when((p == 0) & (g == 0), F.lit(1.0))
        .when((p == 0) | (g == 0) | (same == 0), F.lit(0.0))
        .otherwise(F.lit(2.0) * (same / p) * (same / g) / (same / p + same / g))
    )


def usage_totals(log: DataFrame, key: Sequence[str]) -> DataFrame:
    """Totals of a token log; only calls that report content count as tables."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return log.groupBy(*key).agg(
        whole("input_tokens"),
        whole("output_tokens"),
        F.count(F.lit(1)).alias("calls"),
        F.sum("chars").alias("text_chars"),
        whole("content_used"),
        whole("total_content"),
        F.count("content_used").alias("num_tables"),
    )


class Sunk(NamedTuple):
    """Folders of the three tables that an evaluation leaves behind."""

    predictions: str
    score: str
    reasoning: str


def write_scores(outputs: DataFrame, folder: str) -> Sunk:
    """Write predictions with their match and F1, a one-row score table, and the raw reasoning texts, as CSV.

    The score is observed while the predictions are written, so outputs are scored once and no second pass reads them.
    An empty frame leaves an empty accuracy and F1.
    """
    folder = folder.rstrip("/")
    sunk = Sunk(f"{folder}/preds", f"{folder}/score", f"{folder}/reasoning")
    rows = scored(outputs).withColumn("f1", row_f1(answer_tokens(F.col("prediction")), answer_tokens(F.col("label"))))
    seen = Observation()
    rows = rows.select("sample_id", "prediction", "label", "match", "f1").observe(
        seen,
        F.count(F.lit(1)).alias("samples"),
        F.sum(F.col("match").cast("int")).alias("hits"),
        F.sum(F.col("f1").cast("decimal(38,9)")).alias("f1"),
    )
    write_csv(rows, sunk.predictions)
    found = seen.get
    n = found["samples"]
    score = (n, found["hits"] / n if n else None, float(found["f1"]) / n if n else None)
    write_csv(outputs.sparkSession.createDataFrame([score], "samples long, accuracy double, mean_f1 double"), sunk.score)
    write_csv(outputs.select("sample_id", F.col("output").alias("reasoning")), sunk.reasoning)
    return sunk

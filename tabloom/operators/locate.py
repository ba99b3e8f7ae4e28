"""Finding cells of web tables from queries, and masking what an earlier answer gives away."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import normalize_label, paren_parts, token_sort
from tabloom.operators.ranking import first_rows

# Weights and thresholds of the match.
FIELD_WEIGHT, VALUE_WEIGHT = 0.35, 0.65
BOTH_BONUS, BOTH_THRESHOLD = 0.15, 0.70
SELECT_WEIGHT, AXIS_BIAS = 1.25, 0.05
MIN_SCORE = 0.35
SAME_VALUE = 0.88
MASK = "n.a."


def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def sequence_ratio(a: Column, b: Column) -> Column:
    """Largest ratio of two labels as they are and with their words sorted."""

    @F.pandas_udf("double")
    def apply(a: pd.Series, b: pd.Series, sorted_a: pd.Series, sorted_b: pd.Series) -> pd.Series:
        return pd.Series(
            [max(_ratio(x, y), _ratio(sx, sy)) for x, y, sx, sy in zip(a, b, sorted_a, sorted_b)], dtype="float64"
        )

    return apply(a, b, token_sort(a), token_sort(b))


def with_similarity(df: DataFrame, left: str, right: str, name: str = "similarity") -> DataFrame:
    """Similarity of two normalised labels in [0, 1].

    Equal and empty labels are decided without Python; the sequence ratio runs once per distinct
    pair of the others and is joined back.
    """
    open_pair = (F.col(left) != F.col(right)) & (F.col(left) != "") & (F.col(right) != "")
    pairs = df.filter(open_pair).select(F.col(left).alias("_l"), F.col(right).alias("_r")).distinct()
    inside = F.contains(F.col("_l"), F.col("_r")) | F.contains(F.col("_r"), F.col("_l"))
    shorter, longer = F.least(F.length("_l"), F.length("_r")), F.greatest(F.length("_l"), F.length("_r"))
    ratio = pairs.withColumn("_ratio", sequence_ratio(F.col("_l"), F.col("_r")))
    scored = ratio.select(
        "_l", "_r", F.greatest("_ratio", F.when(inside, shorter / longer).otherwise(F.lit(0.0))).alias("_s")
    )
    joined = df.join(scored, (F.col(left) == F.col("_l")) & (F.col(right) == F.col("_r")), "left")
    similarity = (
        F.when((F.col(left) == "") | (F.col(right) == ""), F.lit(0.0))
        .when(F.col(left) == F.col(right), F.lit(1.0))
        .otherwise(F.col("_s"))
    )
    return joined.withColumn(name, similarity).drop("_l", "_r", "_s")


def best_label(df: DataFrame, key: list[str], path: str, text: str) -> DataFrame:
    """Best similarity of a text among the labels of a path."""
    labels = df.select(*key, normalize_label(F.col(text)).alias("_text"), F.explode(path).alias("_label"))
    labels = labels.withColumn("_label", normalize_label(F.col("_label")))
    return with_similarity(labels, "_label", "_text").groupBy(*key).agg(F.max("similarity").alias("similarity"))


def query_terms(queries: DataFrame, *key: str) -> DataFrame:
    """Texts a query looks for: per predicate its field and values, and the selected field as part -1.

    ``queries`` holds ``(key, select_field, predicates array<struct<field, values array>>)``; the key is the table, and
    the query where a table has several.
    """
    parts = F.concat(
        F.array(F.struct(F.lit(-1).alias("pred"), F.lit("field").alias("part"), F.col("select_field").alias("text"))),
        F.flatten(
            F.transform(
                "predicates",
                lambda p, i: F.concat(
                    F.array(F.struct(i.alias("pred"), F.lit("field").alias("part"), p["field"].alias("text"))),
                    F.transform(
                        p["values"], lambda v: F.struct(i.alias("pred"), F.lit("value").alias("part"), v.alias("text"))
                    ),
                ),
            )
        ),
    )
    return queries.select(*key, F.explode(parts).alias("_term")).select(
        *key, "_term.pred", "_term.part", normalize_label(F.col("_term.text")).alias("_text")
    )


def path_scores(lines: DataFrame, terms: DataFrame, table: str, at: str, path: str, query: Sequence[str] = ()) -> DataFrame:
    """Score of every predicate on every line of one axis: ``(table, query, at, pred, score)``.

    The selected field (-1) scores by its best label alone. ``query`` names the key of several queries per table.
    """
    labels = lines.select(table, at, F.explode(path).alias("_label")).withColumn("_label", normalize_label(F.col("_label")))
    texts = with_similarity(labels.filter("_label <> ''").join(terms, table), "_label", "_text")
    best = texts.groupBy(table, *query, at, "pred").agg(
        F.max(F.when(F.col("part") == "field", F.col("similarity"))).alias("f"),
        F.max(F.when(F.col("part") == "value", F.col("similarity"))).alias("v"),
    )
    f, v = F.coalesce("f", F.lit(0.0)), F.coalesce("v", F.lit(0.0))
    both = F.when((f >= BOTH_THRESHOLD) & (v >= BOTH_THRESHOLD), F.lit(BOTH_BONUS)).otherwise(F.lit(0.0))
    score = F.least(F.lit(FIELD_WEIGHT) * f + F.lit(VALUE_WEIGHT) * v + both, F.lit(1.0))
    return best.select(table, *query, at, "pred", F.when(F.col("pred") == -1, f).otherwise(score).alias("score"))


def _by_line(scores: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.when(F.col("pred") >= 0, F.struct("pred", "score"))))
    return scores.groupBy(*key, at).agg(
        F.transform(listed, lambda s: s["score"]).alias(f"_{at}_scores"),
        F.max(F.when(F.col("pred") == -1, F.col("score"))).alias(f"_{at}_select"),
    )


def located(body: DataFrame, queries: DataFrame, table: str, query: Sequence[str] = ()) -> DataFrame:
    """Best cell of every query: ``(table, query, row, col, answer, score, reason)``.

    A table may have any number of queries, told apart by the columns ``query``. Rows and columns are scored apart, and a
    label once per distinct text; a cell only adds up its line scores. A query without a confident cell has a reason
    instead of an answer: ``below the least score``, or ``empty table`` if its table has no cells.
    """
    key = [table, *query]
    terms = query_terms(queries, *key)
    n_preds = queries.select(*key, F.size("predicates").alias("_n"))
    lines = {at: body.groupBy(table, at).agg(F.first(f"{at}_path").alias("path")) for at in ("row", "col")}
    cells = body.select(table, "row", "col", "text").join(n_preds, table)
    for at in ("row", "col"):
        scores = path_scores(lines[at], terms, table, at, "path", query)
        cells = cells.join(_by_line(scores, key, at), [*key, at], "left")
        zeros = F.array_repeat(F.lit(0.0), F.col("_n"))
        cells = cells.withColumn(f"_{at}_scores", F.coalesce(f"_{at}_scores", zeros)).withColumn(
            f"_{at}_select", F.coalesce(f"_{at}_select", F.lit(0.0))
        )
    matched = F.aggregate(
        F.zip_with("_row_scores", "_col_scores", lambda a, b: F.greatest(a, b)), F.lit(0.0), lambda acc, x: acc + x
    )
    bias = F.when(F.col("_col_select") >= F.col("_row_select"), F.lit(AXIS_BIAS)).otherwise(F.lit(0.0))
    total = matched + F.lit(SELECT_WEIGHT) * F.greatest("_row_select", "_col_select") + bias
    best = first_rows(cells.withColumn("score", total), key, [F.col("score").desc(), "row", "col"])
    sure = F.col("score") >= MIN_SCORE
    found = queries.select(*key).join(best, key, "left")
    reason = F.when(F.col("score").isNull(), "empty table").when(~sure, "below the least score")
    spots = [F.when(sure, F.col(c)).alias(name) for c, name in (("row", "row"), ("col", "col"), ("text", "answer"))]
    return found.select(*key, *spots, "score", reason.alias("reason"))


def locate(body: DataFrame, queries: DataFrame, table: str) -> DataFrame:
    """Best cell of the one query of each table, where there is a confident one: ``(table, row, col, answer, score)``."""
    return located(body, queries, table).filter("reason IS NULL").drop("reason")


def uneven_samples(tables: DataFrame, queries: DataFrame, sample: str) -> DataFrame:
    """Samples whose number of tables is not that of their queries: ``(sample, tables, queries)``; they cannot be chained."""
    count = lambda df, name: df.groupBy(sample).agg(F.count(F.lit(1)).alias(name))
    both = count(tables, "tables").join(count(queries, "queries"), sample, "full").na.fill(0, ["tables", "queries"])
    return both.filter("tables <> queries")


def previous_matches(body: DataFrame, previous: DataFrame, table: str) -> DataFrame:
    """Similarity of an earlier answer to body cells and header lines.

    ``(table, area, row, col, similarity)`` with area body, row or col; ``previous`` is one row per
    table with column ``previous``.
    """
    wanted = previous.select(table, normalize_label(F.col("previous")).alias("_text"))
    none = F.lit(None).cast("int")
    cells = body.select(table, F.lit("body").alias("area"), "row", "col", F.explode(paren_parts(F.col("text"))).alias("_label"))

    def lines(at):
        path = body.groupBy(table, at).agg(F.first(f"{at}_path").alias("p"))
        row, col = (F.col("row"), none) if at == "row" else (none, F.col("col"))
        return path.select(table, F.lit(at).alias("area"), row.alias("row"), col.alias("col"), F.explode("p").alias("_label"))

    every = cells.unionByName(lines("row")).unionByName(lines("col")).join(wanted, table)
    every = every.withColumn("_label", normalize_label(F.col("_label")))
    return with_similarity(every, "_label", "_text").groupBy(table, "area", "row", "col").agg(
        F.max("similarity").alias("similarity")
    )


def previous_location(matches: DataFrame, table: str) -> DataFrame:
    """Where an earlier answer shows up: body, header, row_header, col_header or not_found."""
    best = lambda area: F.coalesce(F.max(F.when(F.col("area") == area, F.col("similarity"))), F.lit(0.0))
    hits = lambda area: F.count(F.when((F.col("area") == area) & (F.col("similarity") >= SAME_VALUE), 1))
    found = matches.groupBy(table).agg(
        best("body").alias("b"), best("row").alias("r"), best("col").alias("c"),
        hits("body").alias("body_matches"), hits("row").alias("row_matches"), hits("col").alias("col_matches"),
    )
    header = F.greatest("r", "c")
    kind = (
        F.when((F.col("b") == 0) & (header == 0), "not_found")
        .when(F.col("b") >= header, "body")
        .when((F.col("r") > 0) & (F.col("c") > 0), "header")
        .when(F.col("r") > 0, "row_header")
        .otherwise("col_header")
    )
    return found.select(
        table, kind.alias("kind"), F.greatest("b", header).alias("score"), "body_matches", "row_matches", "col_matches"
    )


def mask_previous(cells: DataFrame, matches: DataFrame, targets: DataFrame, table: str) -> DataFrame:
    """Mask what repeats an earlier answer, never the target cell; ``masked`` tells which cells changed.

    A body answer masks the matching cells, a header answer its whole rows and columns.  Cells that
    come from one merged cell change together.
    """
    kinds = previous_location(matches, table).select(table, "kind")
    hits = matches.filter(F.col("similarity") >= SAME_VALUE).join(kinds, table)
    body_kind = F.col("kind") == "body"
    spots = hits.filter((body_kind & (F.col("area") == "body")) | (~body_kind & (F.col("area") != "body")))
    spots = spots.select(table, "area", F.col("row").alias("_row"), F.col("col").alias("_col"))
    both = cells.filter(F.col("source").isNotNull())
    goal = targets.select(table, F.col("row").alias("_trow"), F.col("col").alias("_tcol"))
    by_cell = spots.filter("area = 'body'").select(table, F.col("_row").alias("row"), F.col("_col").alias("col"))
    by_row = spots.filter("area = 'row'").select(table, F.col("_row").alias("row"))
    by_col = spots.filter("area = 'col'").select(table, F.col("_col").alias("col"))
    touched = (
        both.join(by_cell, [table, "row", "col"], "left_semi")
        .unionByName(both.join(by_row, [table, "row"], "left_semi"))
        .unionByName(both.join(by_col, [table, "col"], "left_semi"))
        .join(goal, table, "left")
        .filter(~F.coalesce((F.col("row") == F.col("_trow")) & (F.col("col") == F.col("_tcol")), F.lit(False)))
        .select(table, "source")
        .distinct()
        .withColumn("masked", F.lit(True))
    )
    return (
        cells.join(touched, [table, "source"], "left")
        .withColumn("masked", F.coalesce("masked", F.lit(False)))
        .withColumn("text", F.when(F.col("masked"), MASK).otherwise(F.col("text")))
    )


def chain_previous(answers: DataFrame, samples: DataFrame, table: str, sample: str, place: str) -> DataFrame:
    """Previous answer of each table that is masked: all but the first and the last of its sample.

    An answer is looked up in the table as it was, so the answers of a whole chain are known at once
    and every table only needs that of its neighbour.
    """
    placed = samples.select(table, sample, place)
    sizes = placed.groupBy(sample).agg(F.count(F.lit(1)).alias("_n"))
    before = (
        answers.join(placed, table)
        .select(sample, (F.col(place) + 1).alias(place), F.col("answer").alias("previous"))
    )
    return (
        placed.join(sizes, sample)
        .filter((F.col(place) >= 1) & (F.col(place) <= F.col("_n") - 2))
        .join(before, [sample, place])
        .select(table, "previous")
    )

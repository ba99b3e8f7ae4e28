"""From relational tables to question-answering samples.

A sample is keyed by ``sample_id`` (table and method); a *variant* adds the perturbation.  All
methods and perturbations of a corpus are rows of the same frames, so a dataset is one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.arrays import let
from tabloom.functions.numbers import exact_avg, exact_sum, money, plain
from tabloom.functions.sampling import digest, pick, pick_int, uniform
from tabloom.operators import cells as cells_of
from tabloom.operators import perturb, pivot
from tabloom.operators.joins import bundles
from tabloom.operators.keys import unique_combinations
from tabloom.operators.labels import (
    COMPARISONS,
    EXTREMES,
    MAX_TUPLES,
    compare,
    extractive,
    multitable,
    nth,
    percentage_change,
    sampled_cells,
    yes_no,
)
from tabloom.operators.pages import pages
from tabloom.operators.questions import templated
from tabloom.operators.ranking import top_rows
from tabloom.operators.units import convert_tables
from tabloom.session import materialise
from tabloom.sources.html import multitable_text, render_rows
from tabloom.sources.tables import spread

# Question methods and perturbations.
METHODS = ["extractive", "comparative", "superlative", "sum", "average", "percentage_change"]
BEFORE_PIVOT = ["null_inject", "merge_columns", "entity_missing", "value_contradiction"]
AFTER_PIVOT = ["typos", "blank_rows", "blank_columns", "add_notes"]
MIXED = "all_perturbations"
STRONG, WEAK = 50, 20
#: Rows up to which a table is held together, as an array of one row; larger tables are cut to what samples show by joins.
MOST_TOGETHER = 500


def _cells_wanted(table: str, seed: int) -> Column:
    size = lambda m, low: pick_int(seed, f"{m}-size", low, MAX_TUPLES, table)
    method = F.col("method")
    return (
        F.when(method == "extractive", 1)
        .when(method.isin("comparative", "percentage_change"), 2)
        .when(method == "superlative", size("superlative", 3))
        .when(method == "sum", size("sum", 2))
        .otherwise(size("average", 2))
    )


def parted(rel: DataFrame, table: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of tables of at most ``most`` rows, every table in one partition, and those of larger tables, if any."""
    known = rel.filter(F.col(table).isNotNull())
    large = known.groupBy(table).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(table)
    large = materialise(large, "large-tables")
    tasks = int(rel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if large.isEmpty():
        return known.repartition(tasks, table), None
    return known.join(large, table, "left_anti").repartition(tasks, table), known.join(large, table, "left_semi")


def chosen_cells(
    rel: DataFrame, table: str, columns: Sequence[str], value: str, seed: int, methods=METHODS, most: int = MOST_TOGETHER
) -> DataFrame:
    """Cells every method asks for: ``(table, method, tuple, value, row_id, rn)``.

    The unique tuples are found once; each method then draws its own sample of them. The rows of a table meet once for
    both, unless they are more than ``most``.
    """
    found = [_drawn_cells(part, table, columns, value, seed, methods) for part in parted(rel, table, most) if part is not None]
    return reduce(DataFrame.unionByName, found)


def _drawn_cells(rel: DataFrame, table: str, columns: Sequence[str], value: str, seed: int, methods: Sequence[str]) -> DataFrame:
    unique = unique_combinations(rel, [table, *columns], [value, "row_id"])
    drawn = unique.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods]))).withColumn(
        "_h", F.md5(F.concat_ws("|", F.lit(str(seed)), "method", F.col(table).cast("string"), *columns))
    )
    ranked = top_rows(drawn, [table, "method"], ["_h", *columns], MAX_TUPLES).drop("_h")
    return ranked.withColumn("wanted", _cells_wanted(table, seed)).filter("rn <= wanted")


def sample_labels(chosen: DataFrame, table: str, value: str, seed: int) -> DataFrame:
    """Gold answers of all methods from one aggregate; samples without an answer are left out."""
    method, x = F.col("method"), F.col(value)
    answers = chosen.groupBy(table, "method", "wanted").agg(
        F.count(F.lit(1)).alias("_n"), nth(x, 1).alias("a"), nth(x, 2).alias("b"),
        F.max(money(x)).cast("double").alias("hi"), F.min(money(x)).cast("double").alias("lo"),
        exact_sum(x).alias("total"), exact_avg(x).alias("mean"),
    )
    op = pick(seed, "comparison", COMPARISONS, table)
    extreme = pick(seed, "extreme", EXTREMES, table)
    label = (
        F.when(method == "extractive", plain(F.col("a")))
        .when(method == "comparative", yes_no(compare(op, F.col("a"), F.col("b"))))
        .when(method == "percentage_change", plain(percentage_change(F.col("a"), F.col("b"))))
        .when(method == "superlative", plain(F.when(extreme == "MAX", F.col("hi")).otherwise(F.col("lo"))))
        .when(method == "sum", plain(F.col("total")))
        .otherwise(plain(F.col("mean")))
    )
    aggregate = (
        F.when(method == "superlative", extreme).when(method == "sum", "SUM").when(method == "average", "AVG").otherwise(op)
    )
    return answers.filter("_n = wanted").select(
        table, "method", aggregate.alias("aggregate"), label.alias("label")
    ).filter("label IS NOT NULL")


def query_texts(chosen: DataFrame, labels: DataFrame, table: str, columns: Sequence[str], value: str) -> DataFrame:
    """The SQL a sample's answer comes from, for the dataset column of that name."""
    where = F.concat_ws(" AND ", *[F.concat(F.lit(f'{c} = "'), F.col(c), F.lit('"')) for c in columns])
    name = F.concat(F.lit("table_"), F.col(table).cast("string"))
    select = F.concat(F.lit(f"SELECT {value} AS {value} FROM "), name, F.lit(" WHERE "), where)
    parts = chosen.groupBy(table, "method").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("rn"), select.alias("s")))), lambda p: p["s"]).alias("_s")
    )
    pair = F.concat(
        F.lit("SELECT ("), F.get("_s", F.lit(0)), F.lit(") "), F.col("aggregate"), F.lit(" ("), F.get("_s", F.lit(1)), F.lit(f") AS {value};")
    )
    change = F.concat(
        F.lit("SELECT (("), F.get("_s", F.lit(0)), F.lit(") - ("), F.get("_s", F.lit(1)), F.lit(")) * 100.0 / NULLIF(("),
        F.get("_s", F.lit(1)), F.lit(f"), 0) AS {value};"),
    )
    union = F.concat(
        F.lit("SELECT "), F.col("aggregate"), F.lit(f"({value}) AS {value} FROM ("), F.array_join("_s", " UNION ALL "), F.lit(");")
    )
    text = (
        F.when(F.col("method") == "extractive", F.concat(F.get("_s", F.lit(0)), F.lit(";")))
        .when(F.col("method") == "comparative", pair)
        .when(F.col("method") == "percentage_change", change)
        .otherwise(union)
    )
    return parts.join(labels, [table, "method"]).select(table, "method", text.alias("sql_query"))


def question_texts(chosen: DataFrame, labels: DataFrame, table: str, columns: Sequence[str], value: str) -> DataFrame:
    parts = F.array(
        *[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("col"), F.col(c).alias("value")) for i, c in enumerate(columns)]
    )
    key = F.concat_ws("|", F.col(table).cast("string"), "method")
    preds = chosen.select(
        key.alias("_q"), F.lit(1).alias("step"), F.col("rn").alias("branch"), F.explode(parts).alias("p")
    ).select("_q", "step", "branch", "p.pos", "p.col", F.lit("=").alias("op"), "p.value", F.lit(True).alias("is_last"))
    last = labels.select(key.alias("_q"), table, "method", "aggregate", F.lit(value).alias("target"))
    return templated(preds, "_q", last).join(last.select("_q", table, "method"), "_q").select(
        table, "method", F.col("text").alias("question")
    )


def variant_key(table: str) -> Column:
    return F.concat_ws("|", F.col(table).cast("string"), "method", "perturbation")


def base_pivot(rel: DataFrame, layouts: DataFrame, table: str, columns: Sequence[str], value: str) -> DataFrame:
    """One pivot per table, which all samples and variants share: ``(table, row_path, col_path, row_id, columns, value)``.

    A cell is the row of the smallest key among those with its attributes.
    """
    placed = perturb.layout_cells(rel, layouts, table, columns)
    cells = placed.groupBy(table, "row_path", "col_path").agg(F.min_by(F.struct("row_id", *columns, value), "row_id").alias("_row"))
    return cells.select(table, "row_path", "col_path", "_row.*")


def shown_lines(base: DataFrame, needed: DataFrame, table: str, path: str, seed: int, low: int, high: int) -> DataFrame:
    """The lines of one side that a sample shows: ``(table, method, path)``.

    Lines with a needed cell come first, then those that the table's own draw puts first; so besides needed lines only the
    first ``high`` lines of a table matter, and they are found once for all its samples. Samples of tables with fewer
    than ``low`` lines, or with more needed lines than fit, have none.
    """
    drawn = digest(seed, path, table, F.array_join(path, "|"))
    lines = base.groupBy(table, path).agg(F.lit(0).alias("must")).withColumn("_h", drawn)
    sizes = lines.groupBy(table).agg(F.count(F.lit(1)).alias("_n"))
    first = top_rows(lines, [table], ["_h", path], high).drop("rn")
    asked = needed.groupBy(table, "method", path).agg(F.lit(1).alias("must")).withColumn("_h", drawn)
    each = first.join(needed.select(table, "method").distinct(), table).select(*asked.columns)
    marked = each.unionByName(asked).groupBy(table, "method", path).agg(F.max("must").alias("must"), F.max("_h").alias("_h"))
    wanted = asked.groupBy(table, "method").agg(F.count(F.lit(1)).alias("_must")).join(sizes, table)
    good = wanted.filter((F.col("_n") >= low) & ((F.col("_must") <= high) | (F.col("_n") < high))).select(table, "method")
    kept = top_rows(marked, [table, "method"], [F.desc("must"), "_h", path], high)
    return kept.select(table, "method", path).join(good, [table, "method"], "left_semi")


def shown_cells(base: DataFrame, chosen: DataFrame, labels: DataFrame, table: str, seed: int) -> DataFrame:
    """The base pivot cut to what every sample shows, with ``method`` and ``needed``: at most a hundred cells each."""
    asked = chosen.select(table, "method", "row_id").join(labels.select(table, "method"), [table, "method"], "left_semi")
    needed = materialise(asked.join(base.select(table, "row_id", "row_path", "col_path"), [table, "row_id"]), "needed-cells")
    low, high = pivot.SHRINK_RANGE
    rows, cols = (materialise(shown_lines(base, needed, table, path, seed, low, high), path) for path in ("row_path", "col_path"))
    small = base
    for kept, path in ((rows, "row_path"), (cols, "col_path")):
        small = small.join(kept.select(table, path).distinct(), [table, path], "left_semi")
    cells = small.join(rows, [table, "row_path"]).join(cols, [table, "method", "col_path"])
    marks = needed.select(table, "method", "row_id", F.lit(True).alias("needed"))
    return cells.join(marks, [table, "method", "row_id"], "left").withColumn("needed", F.coalesce("needed", F.lit(False)))


def _listed(rows: DataFrame, table: str, name: str) -> DataFrame:
    """The rows of each table as an array of structs."""
    return rows.groupBy(table).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != table])).alias(name))


def _small_samples(
    small: DataFrame, chosen: DataFrame, labels: DataFrame, table: str, columns: Sequence[str], value: str, seed: int
) -> DataFrame:
    """``shown_cells`` of tables that are held as arrays: one row per sample, made where the rows of its table lie."""
    rows = _listed(small.dropna(subset=list(columns)).select(table, "row_id", *columns, value), table, "_rows")
    asked = _listed(chosen.select(table, "method", "row_id", *columns), table, "_asked")
    known = _listed(labels, table, "_known")
    together = rows.join(asked, table).join(known, table)
    distinct = lambda part: F.size(F.array_distinct(F.transform("_rows", lambda x: F.struct(*[x[c] for c in part]))))
    counts = {name: distinct(part) for part, name in pivot.split_sides(columns).items()}
    together = together.withColumns({"_filled": distinct(columns), **counts}).select(
        table, "_rows", "_asked", "_known", F.explode(F.array(pivot.best_split([table], columns, seed))).alias("_best")
    )
    parts = F.split("_best.layout", r" \| ")
    together = together.filter("_best is not null").select(
        table, "_rows", "_asked", "_known", F.explode(F.array(F.struct(*[F.split(parts[i], "; ").alias(side) for i, side in enumerate("rc")]))).alias("_sides")
    )

    def laid(x: Column) -> Column:
        path = lambda side: F.concat_ws(
            perturb.PATH_MARK, *[F.when(F.array_contains(F.col("_sides")[side], c), x[c].cast("string")) for c in columns]
        )
        kept = F.struct(*[x[c].alias(c) for c in ("row_id", *columns, value)])
        return F.struct(path("r").alias("r"), path("c").alias("c"), x["row_id"].isNull().alias("none"), kept.alias("row"))

    def first_of_each(ordered: Column) -> Column:
        new = lambda x, i: (i == 0) | (x["r"] != F.get(ordered, i - 1)["r"]) | (x["c"] != F.get(ordered, i - 1)["c"])
        return F.filter(ordered, new)

    def cell(x: Column) -> Column:
        row = x["row"]
        own = lambda c: F.when(~x["none"], row[c])
        return F.struct(
            row["row_id"].alias("row_id"), F.struct(*[own(c).alias(c) for c in columns]).alias("at"), x["r"].alias("r"), x["c"].alias("c"),
            own(value).alias("price"), plain(own(value), 2).alias("value"),
        )

    base = F.transform(let(F.sort_array(F.transform("_rows", laid)), first_of_each), cell)
    together = together.select(table, "_asked", "_known", F.explode(F.array(base)).alias("_base"))
    samples = together.select(
        table, "_base", "_asked", F.explode(F.transform("_known", lambda x: x)).alias("_s")
    )
    samples = samples.select(
        table, "_base", "_s.*", F.explode(F.array(F.filter("_asked", lambda x: x["method"] == F.col("_s.method")))).alias("branches")
    )

    def mark(ids: Column, x: Column) -> Column:
        needed = F.coalesce(F.array_contains(ids, x["row_id"]), F.lit(False))
        return F.struct(*[x[n].alias(n) for n in ("row_id", "at", "r", "c", "price", "value")], needed.alias("needed"))

    marked = let(F.transform("branches", lambda b: b["row_id"]), lambda ids: F.transform("_base", lambda x: mark(ids, x)))
    named = [c for c in labels.columns if c != table]
    samples = samples.select(table, *named, "branches", F.explode(F.array(marked)).alias("_marked"))
    low, high = pivot.SHRINK_RANGE
    shown = F.when(F.exists("_marked", lambda x: x["needed"]), cells_of.shrunk(F.col("_marked"), table, seed, low, high))
    samples = samples.select(table, *named, "branches", F.explode(F.array(shown)).alias("cells"))
    return samples.filter("size(cells) > 0")


def _large_samples(
    large: DataFrame, chosen: DataFrame, labels: DataFrame, table: str, columns: Sequence[str], value: str, seed: int
) -> DataFrame:
    """The same for tables of any size, by joins."""
    layouts = materialise(pivot.split_search(large, [table], columns, seed), "layouts")
    base = materialise(base_pivot(large, layouts, table, columns, value), "base-pivot")
    shown = shown_cells(base, chosen, labels, table, seed)
    path = lambda side: F.array_join(side, perturb.PATH_MARK)
    cell = F.struct(
        "row_id", F.struct(*columns).alias("at"), path("row_path").alias("r"), path("col_path").alias("c"), F.col(value).alias("price"),
        plain(F.col(value), 2).alias("value"), "needed",
    )
    cells = shown.groupBy(table, "method").agg(F.collect_list(cell).alias("cells"))
    branches = chosen.select(table, "method", "row_id", *columns).groupBy(table, "method").agg(
        F.collect_list(F.struct("method", "row_id", *columns)).alias("branches")
    )
    return labels.join(branches, [table, "method"]).join(cells, [table, "method"])


def shown_samples(
    rel: DataFrame, chosen: DataFrame, labels: DataFrame, table: str, columns: Sequence[str], value: str, seed: int, most: int = MOST_TOGETHER
) -> DataFrame:
    """One row per sample: the columns of ``labels``, ``branches`` (its chosen tuples) and ``cells``, the hundred it shows at most.

    Tables are pivoted once and cut to what their samples show.
    """
    small, large = parted(rel, table, most)
    samples = _small_samples(small, chosen, labels, table, columns, value, seed)
    if large is None:
        return samples
    return samples.unionByName(_large_samples(large, chosen, labels, table, columns, value, seed))


def _applies(name: str, seed: int) -> Column:
    """The perturbation itself, or a coin toss for the mixed variant."""
    mixed = (F.col("perturbation") == MIXED) & (uniform(seed, f"mix-{name}", "variant") < 0.5)
    return (F.col("perturbation") == name) | mixed


def _changed(variants: DataFrame, cells: Column) -> DataFrame:
    """``variants`` with other cells, which are worked out once: what an explode makes is not read into later steps."""
    kept = [c for c in variants.columns if c != "cells"]
    return variants.select(*kept, F.explode(F.array(cells)).alias("cells"))


def row_level(variants: DataFrame, seed: int) -> DataFrame:
    """Perturbations of the relational form: missing entities, contradictions, null tokens."""
    cells = F.col("cells")
    return _changed(
        variants,
        F.when(F.col("perturbation") == "entity_missing", cells_of.entity_missing(cells, "variant", seed))
        .when(F.col("perturbation") == "value_contradiction", cells_of.contradicted(cells, "variant", seed, 2))
        .when(_applies("null_inject", seed), cells_of.nulled(cells, "variant", seed))
        .otherwise(cells),
    )


def merged_columns(variants: DataFrame, table: str, columns: Sequence[str], value: str, seed: int) -> DataFrame:
    """Merges of two columns lay the rows of a variant out anew; its pivot is cut again. Other variants stay."""
    cells, sample = F.col("cells"), F.concat_ws("|", F.col(table).cast("string"), "method")
    merging = _applies("merge_columns", seed)
    laid = cells_of.merged(cells, sample, F.col("branches"), columns, value, seed)
    cut = let(laid, lambda rows: let(cells_of.pivoted(rows), lambda pivoted: cells_of.shrunk(pivoted, "variant", seed, *pivot.SHRINK_RANGE)))
    return _changed(variants, F.when(merging, cut).otherwise(cells_of.fields(cells))).drop("branches")


def pivot_level(variants: DataFrame, seed: int, unit: str) -> DataFrame:
    """Units inside cells, notes and typos, each drawn for the variants it applies to; ``rendered_arrays`` puts them into the cells.

    Notes and typos are stronger where they are the only perturbation.
    """
    strength = lambda name: F.when(_applies(name, seed), F.when(F.col("perturbation") == name, STRONG).otherwise(WEAK)).otherwise(0)
    in_cell = pick_int(seed, "unit-in-cell", 0, 1, "variant") == 1
    drawn = variants.withColumns({"unit": F.when(in_cell, unit), "notes": strength("add_notes"), "typos": strength("typos")})
    return drawn.withColumns({"header": F.col("unit").isNull(), "templates": F.when(F.col("notes") > 0, perturb.note_templates(seed, "variant"))})


def rendered(cells: DataFrame, table: str, seed: int, header: str, unit: str) -> DataFrame:
    """HTML per variant, with unit header line, blank rows and blank columns.

    A variant has at most ten rows and columns after the shrink, so its cells are a small array.
    """
    sep = perturb.PATH_MARK
    small = cells.select(
        "variant", "header", F.col("value").cast("string").alias("value"),
        F.array_join("row_path", sep).alias("r"), F.array_join("col_path", sep).alias("c"),
    )
    small = small.groupBy("variant").agg(
        F.bool_or("header").alias("header"), F.collect_list(F.struct("r", "c", "value")).alias("cells")
    )
    names = F.split("variant", r"\|")
    small = small.withColumn("method", names[1]).withColumn("perturbation", names[2]).withColumn(table, names[0])
    done = {"unit": F.lit(None).cast("string"), "notes": F.lit(0), "typos": F.lit(0), "templates": F.lit(None).cast("array<string>")}
    return rendered_arrays(small.withColumns(done), seed, header, unit).select(table, "method", "perturbation", "html")


def rendered_arrays(small: DataFrame, seed: int, header: str, unit: str) -> DataFrame:
    """``html`` of variants whose ``cells`` are an array, with what ``pivot_level`` has drawn, besides the other columns of ``small``."""
    spent = ["cells", "header", "unit", "notes", "templates", "typos"]
    label = F.when(F.col("header"), F.when(pick_int(seed, "only-unit", 0, 1, "variant") == 1, unit).otherwise(header))
    everywhere = pick_int(seed, "filled", 0, 1, "variant") == 1
    none = F.array().cast("array<double>")
    blanks = [F.when(_applies(name, seed), perturb.insert_draws(seed, name, "variant")).otherwise(none) for name in ("blank_rows", "blank_columns")]
    drawn = [F.col(c) for c in ("unit", "notes", "templates", "typos")]
    html = pages("cells", "variant", seed, *drawn, label, everywhere, *blanks)
    return small.select(*[c for c in small.columns if c not in spent], html.alias("html"))


def variant_cells(
    rel: DataFrame, chosen: DataFrame, labels: DataFrame, table: str, columns: Sequence[str], value: str, seed: int, perturbations: Sequence[str],
    most: int = MOST_TOGETHER,
) -> DataFrame:
    """One row per sample and perturbation of the relational form, with its ``cells``: ``(variant, perturbation, ..., cells)``.

    The columns of ``labels`` go along. Samples are made once; perturbations only touch the cells that they show, so they
    move no rows.
    """
    samples = shown_samples(rel, chosen, labels, table, columns, value, seed, most)
    spread = samples.withColumn("perturbation", F.explode(F.array(*[F.lit(p) for p in perturbations])))
    rows = row_level(spread.withColumn("variant", variant_key(table)), seed)
    return merged_columns(rows, table, columns, value, seed).filter("size(cells) > 0")


def single_table(
    rel: DataFrame, table: str, columns: Sequence[str], value: str, unit: str, seed: int,
    methods: Sequence[str] = METHODS, most: int = MOST_TOGETHER,
) -> DataFrame:
    """``question, sql_query, method, perturbation, table_html, label`` of a corpus of tables."""
    chosen = materialise(chosen_cells(rel, table, columns, value, seed, methods, most), "chosen")
    labels = materialise(sample_labels(chosen, table, value, seed), "labels")
    texts = question_texts(chosen, labels, table, columns, value).join(
        query_texts(chosen, labels, table, columns, value), [table, "method"]
    )
    named = materialise(labels.join(texts, [table, "method"]), "texts")
    cells = variant_cells(rel, chosen, named, table, columns, value, seed, ["none", *BEFORE_PIVOT, *AFTER_PIVOT, MIXED], most)
    cells = pivot_level(cells, seed, unit)
    tables = rendered_arrays(cells, seed, f"{value} ({unit})", unit)
    return tables.select(table, "method", "perturbation", "html", "aggregate", "label", "question", "sql_query")


def complete_bundles(tables: DataFrame, sample: str, place: str) -> DataFrame:
    """Tables per bundle of 2, 3, 5, 10 and 20; bundles that lack a table are left out."""
    listed = bundles(tables, place).withColumn("bundle_id", F.concat_ws("-", F.col(sample).cast("string"), "bundle"))
    full = listed.groupBy("bundle_id", "bundle").agg(F.count(F.lit(1)).alias("_n")).filter("_n = bundle")
    return listed.join(full.select("bundle_id"), "bundle_id", "left_semi")


def parallel_labels(cells: DataFrame, table: str, value: str, per_sample: int = 20) -> DataFrame:
    """Extractive label of every table with its place in every bundle."""
    single = extractive(cells, table, value).select(
        table, "label", F.expr(f"{table} div {per_sample}").alias("sample_id"),
        F.expr(f"{table} % {per_sample}").cast("int").alias("place"),
    )
    return complete_bundles(single, "sample_id", "place")


def parallel_answers(placed: DataFrame, seed: int = 42) -> DataFrame:
    """Label per bundle and method across its tables."""
    return multitable(placed, "bundle_id", "place", "label", ["superlative", "sum", "average"], seed)


def converted_html(rel: DataFrame, table: str, columns: Sequence[str], value: str, unit: str, seed: int, units: DataFrame) -> DataFrame:
    """HTML of every table as it is and with its values in another unit: ``(table, variant, html)``."""
    texts = with_unit(spread(rel, "row_id"), value, unit)
    changed = convert_tables(texts, units, table, "shown", "unit", seed).filter("reason IS NULL").withColumn(
        "shown", F.concat_ws(" ", plain(F.col("converted"), 12), "to_unit", F.lit(unit))
    )
    both = (
        texts.withColumn("shown", F.concat_ws(" ", "shown", F.lit(unit)))
        .select(table, "row_id", *columns, "shown", F.lit("not_unit_converted").alias("variant"))
        .unionByName(changed.select(table, "row_id", *columns, "shown", F.lit("unit_converted").alias("variant")))
    )
    both = both.withColumn("_key", F.concat_ws("|", F.col(table).cast("string"), "variant"))
    shown = {**{c: F.col(c) for c in columns}, value: F.col("shown")}
    pages = render_rows(both, "_key", "row_id", shown, per_page=20)
    parts = F.split("_key", r"\|")
    return pages.select(
        parts[0].cast(rel.schema[table].dataType).alias(table), parts[1].alias("variant"), "html"
    )


def refused_variants(placed: DataFrame, changed: DataFrame, table: str) -> DataFrame:
    """(bundle_id, perturbation, reason, tables): variants that bundles go without, and how many of their tables cause it.

    ``changed`` has a ``reason`` on the rows of tables that no unit converts. The first table of a bundle keeps its unit.
    """
    failed = changed.filter("reason IS NOT NULL").select(table, "reason").distinct()
    hit = placed.filter("place > 0").select(table, "bundle_id").join(failed, table)
    return hit.groupBy("bundle_id", F.lit("unit_converted").alias("perturbation"), "reason").agg(F.count(F.lit(1)).alias("tables"))


def with_unit(rel: DataFrame, value: str, unit: str) -> DataFrame:
    return rel.withColumn("shown", plain(F.col(value), 2)).withColumn("domain", F.lit("finance")).withColumn("unit", F.lit(unit))


def parallel_refused(
    rel: DataFrame, units: DataFrame, table: str, columns: Sequence[str], value: str, unit: str, seed: int, tries: int = 5
) -> DataFrame:
    """The variants that ``parallel`` leaves out, each with its reason, if ``tries`` units are tried for every table."""
    cells = sampled_cells(rel, table, columns, value, 1, "parallel", seed)
    changed = convert_tables(with_unit(rel, value, unit), units, table, "shown", "unit", seed, tries)
    return refused_variants(parallel_labels(cells, table, value), changed, table)


def parallel(rel: DataFrame, units: DataFrame, table: str, columns: Sequence[str], value: str, unit: str, seed: int) -> DataFrame:
    """Bundles of parallel tables, unit-converted and not, with a label across the tables.

    The first table of a sample keeps its unit, as the question names it. A bundle with a table that no unit converts
    has no converted variant, see ``parallel_refused``, so every text holds all tables that its label was computed from.
    """
    cells = sampled_cells(rel, table, columns, value, 1, "parallel", seed)
    placed = materialise(parallel_labels(cells, table, value), "placed")
    pages = converted_html(rel, table, columns, value, unit, seed, units)
    keep = (F.col("place") > 0) | (F.col("variant") == "not_unit_converted")
    shown = placed.select(table, "bundle_id", "place").join(pages, table).filter(keep)
    first = shown.filter("place = 0").withColumn("variant", F.lit("unit_converted"))
    shown = shown.unionByName(first).withColumn("_k", F.concat_ws("|", "bundle_id", "variant"))
    tables = F.element_at(F.split("bundle_id", "-"), -1).cast("int")
    whole = shown.groupBy("_k", "bundle_id").agg(F.count_distinct("place").alias("_n")).filter(F.col("_n") == tables).select("_k")
    texts = multitable_text(shown.join(whole, "_k"), "_k", "place", "html")
    key = F.split("_k", r"\|")
    texts = texts.select(key[0].alias("bundle_id"), key[1].alias("perturbation"), "text")
    return parallel_answers(placed, seed).join(texts, "bundle_id").withColumn(
        "num_tables", F.element_at(F.split("bundle_id", "-"), -1).cast("int")
    )

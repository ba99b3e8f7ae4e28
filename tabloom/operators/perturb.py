"""Perturbations: clean tables become messy ones.

Each works on a whole corpus keyed by a table column.  Random choices are digests of the seed and
the row key, so they are the same on any cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.numbers import plain
from tabloom.functions.arrays import let
from tabloom.functions.sampling import digest, first_half, pick, pick_int, uniform, unit_interval
from tabloom.operators.ranking import SLICES, first_rows, hash_ranked, top_rows
from tabloom.operators.units import NULL_TOKENS
from tabloom.session import materialise

# Note templates and invisible characters.
NOTES = {
    "PARENTHETICAL_NOTES": [
        "{value} (see notes)",
        "{value} (est.)",
        "{value} (latest update)",
        "{value} (source: official reports)",
    ],
    "FOOTNOTE_NOTES": [
        "{value}¹",
        "{value}²",
        "{value}³",
        "{value}⁴",
        "{value}⁵",
        "{value}*",
        "{value}**",
        "{value} (see footnote {number})",
        "{value} (see [{number}])",
        "{value} (cf. appendix)",
    ],
    "CONTEXTUAL_PHRASES": [
        "{value} - according to official data",
        "{value} - as listed on the website",
        "{value} - noted in the catalog",
        "{value} - additional details are provided in the documentation",
        "{value} - Note: recorded in [{number}]",
        "{value}\nAccording to official data",
        "{value}\nAs listed on the website",
        "{value}\nNoted in the catalog",
        "{value}\nAdditional details are provided in the documentation",
        "{value}\nNote: recorded in [{number}]",
        "according to official data: {value}",
        "as listed on the website: {value}",
    ],
}
INVISIBLE = ["\u200b", "\u200c", "\u200d", "\u2060", "\u00a0"]
MAX_BLANKS = 3
PATH_MARK = "\u0001"


def column(name: Column | str) -> Column:
    return F.col(name) if isinstance(name, str) else name


def is_filled(value: Column) -> Column:
    """Neither NULL nor one of the null tokens."""
    return value.isNotNull() & ~F.trim(value).isin(NULL_TOKENS)


def null_token(table: str, seed: int) -> Column:
    return pick(seed, "null-token", NULL_TOKENS, table)


def nulled(
    table: str, row: Sequence[Column | str], value: Column | str, seed: int, needed: Column | str = "needed", token: Column | None = None
) -> Column:
    """The value, or the null token of the table for half of the rows that no answer needs."""
    lost = ~column(needed) & first_half(digest(seed, "null", table, *row))
    return F.when(lost, null_token(table, seed) if token is None else token).otherwise(column(value))


def null_inject(df: DataFrame, table: str, row: Sequence[str], value: str, seed: int) -> DataFrame:
    return df.withColumn(value, nulled(table, row, value, seed))


def entity_missing(df: DataFrame, table: str, row: str, seed: int) -> DataFrame:
    """Every table loses one needed row, which makes its question unanswerable."""
    gone = df.filter("needed").withColumn("_h", digest(seed, "missing", table, row))
    gone = first_rows(gone.select(table, row, "_h"), [table], ["_h"]).drop("_h")
    return df.join(gone, [table, row], "left_anti")


def contradicted(row: Sequence[Column | str], value: Column | str, seed: int, digits: int = 6) -> Column:
    """``v (v + n)`` with n from 1 to 10."""
    other = column(value) + pick_int(seed, "contradiction", 1, 10, *row)
    return F.concat(plain(column(value), digits), F.lit(" ("), plain(other, digits), F.lit(")"))


def value_contradiction(df: DataFrame, row: Sequence[str], value: str, seed: int) -> DataFrame:
    return df.withColumn(value, contradicted(row, value, seed))


def merge_columns(
    df: DataFrame, table: str, columns: Sequence[str], value: str, branches: DataFrame, seed: int
) -> DataFrame:
    """Two random columns per table become one: name ``c1 (c2)``, value ``v1 (v2)``.

    The merge is left out when the value column would absorb a predicate column without which two
    predicates of the question are the same.  ``branches`` holds the predicate tuples of a table.
    """
    order = F.array_sort(
        F.array(*[F.struct(digest(seed, "merge", F.col(table), F.lit(c)).alias("h"), F.lit(c).alias("c")) for c in columns])
    )
    keys = [c for c in branches.columns if c != table]
    left_out = [
        F.countDistinct(F.struct(*[F.col(k) for k in keys if k != c], F.lit(0).alias("_"))) < F.count(F.lit(1)) for c in keys
    ]
    collapse = branches.groupBy(table).agg(
        F.create_map(*[x for c, flag in zip(keys, left_out) for x in (F.lit(c), flag)]).alias("_collapse")
    )
    have = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])
    chosen = df.withColumn("_o", order).withColumn("c1", F.get("_o", F.lit(0))["c"]).withColumn("c2", F.get("_o", F.lit(1))["c"])
    absorbed = F.when(F.col("c1") == value, F.col("c2")).when(F.col("c2") == value, F.col("c1"))
    return (
        chosen.join(collapse, table, "left")
        .withColumn("skipped", F.coalesce(F.element_at("_collapse", F.coalesce(absorbed, F.lit(""))), F.lit(False)))
        .withColumn("merged_name", F.when(~F.col("skipped"), F.concat("c1", F.lit(" ("), "c2", F.lit(")"))))
        .withColumn(
            "merged_value",
            F.when(~F.col("skipped"), F.concat(have[F.col("c1")], F.lit(" ("), have[F.col("c2")], F.lit(")"))),
        )
        .withColumn("is_value", absorbed.isNotNull() & ~F.col("skipped"))
        .drop("_o", "_collapse")
    )


def merge_rows(df: DataFrame, table: str, row: str, columns: Sequence[str], seed: int) -> DataFrame:
    """Two random rows per table become one with ``v1 (v2)`` in every column."""
    texts = df.select(table, F.col(row).cast("string").alias(row), *[F.col(c).cast("string").alias(c) for c in columns])
    two = top_rows(texts.withColumn("_h", digest(seed, "merge-rows", table, row)), [table], ["_h"], 2).drop("_h")
    pick_of = lambda c, n: F.max(F.when(F.col("rn") == n, F.col(c)))
    merged = (
        two.groupBy(table)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.concat(pick_of(row, 1), F.lit("_"), pick_of(row, 2)).alias(row),
            *[F.concat(pick_of(c, 1), F.lit(" ("), pick_of(c, 2), F.lit(")")).alias(c) for c in columns],
        )
        .filter("_n = 2")
        .drop("_n")
    )
    paired = two.join(merged.select(table), table, "left_semi").select(table, row)
    return texts.join(paired, [table, row], "left_anti").unionByName(merged)


def show_units(df: DataFrame, table: str, value: str, unit: str, in_cell: Column) -> DataFrame:
    """Unit behind each value, or in the header of the value column.

    The header form needs exactly one unit in the table; other tables fall back to the cells.
    """
    known = F.when(F.col(unit) != "None", F.col(unit))
    per_table = df.groupBy(table).agg(F.min(known).alias("_lo"), F.max(known).alias("_hi"))
    marked = df.join(per_table, table).withColumn("_cell", in_cell | F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(True)))
    shown = F.when(
        F.col("_cell") & known.isNotNull() & is_filled(F.col(value)), F.concat(F.col(value), F.lit(" "), known)
    ).otherwise(F.col(value))
    header = F.when(~F.col("_cell"), F.concat(F.lit(f"{value} ("), "_lo", F.lit(")"))).otherwise(F.lit(value))
    return marked.withColumn("header", header).withColumn(value, shown).drop("_lo", "_hi", "_cell")


def insert_draws(seed: int, op: str, *keys: str) -> Column:
    """One to three numbers in [0, 1), one for each insert."""
    drawn = F.array(*[uniform(seed, f"{op}-{i}", *keys) for i in range(MAX_BLANKS)])
    return F.slice(drawn, F.lit(1), pick_int(seed, op, 1, MAX_BLANKS, *keys))


def insert_positions(size: Column, seed: int, op: str, *keys: str) -> Column:
    """One to three insert positions, each within the table as the inserts before have left it."""
    return F.transform(insert_draws(seed, op, *keys), lambda draw, i: F.floor(draw * (size + i + 1)).cast("int"))


def pushed(position: Column, inserts: Column) -> Column:
    """Position after the inserts, each of which moves what is at or behind it."""
    return F.aggregate(inserts, position.cast("int"), lambda at, spot: at + F.when(at >= spot, 1).otherwise(0))


def blank_positions(inserts: Column) -> Column:
    """Final positions of the inserted blanks."""
    return F.transform(
        inserts, lambda spot, i: pushed(spot, F.slice(inserts, i + 2, F.greatest(F.size(inserts) - i - 1, F.lit(0))))
    )


def insert_blanks(df: DataFrame, table: str, position: str, seed: int, op: str) -> DataFrame:
    """Rows (or columns) moved by blanks, and the blanks: ``(table, position, old_position)``.

    ``df`` has one row per table line with positions 0, 1, ...
    """
    sizes = df.groupBy(table).agg((F.max(position) + 1).alias("_size")).withColumn(
        "_spots", insert_positions(F.col("_size"), seed, op, table)
    )
    moved = df.join(sizes.select(table, "_spots"), table).select(
        table, pushed(F.col(position), F.col("_spots")).alias("position"), F.col(position).cast("int").alias("old_position")
    )
    blanks = sizes.select(
        table, F.explode(blank_positions(F.col("_spots"))).alias("position"), F.lit(None).cast("int").alias("old_position")
    )
    return moved.unionByName(blanks)


def checked(strength: int | str) -> Column:
    """A strength in percent: a number, or the column that holds it."""
    if isinstance(strength, str):
        return F.col(strength)
    if not 0 <= strength <= 100:
        raise ValueError("strength must be between 0 and 100")
    return F.lit(strength)


def share_of(size: Column, strength: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(size * strength / F.lit(100)))


def note_templates(seed: int, table: str) -> Column:
    """One template of every note category the table uses; at least one category."""
    options = []
    for category, templates in NOTES.items():
        used = uniform(seed, f"use-{category}", table) < 0.5
        options.append((used, pick(seed, category, templates, table)))
    fallback = F.element_at(F.array(*[t for _, t in options]), pick_int(seed, "category", 1, len(options), table))
    chosen = F.filter(F.array(*[F.when(used, t) for used, t in options]), lambda t: t.isNotNull())
    return F.when(F.size(chosen) > 0, chosen).otherwise(F.array(fallback))


def with_note(templates: Column, table: str, cell: Sequence[Column | str], value: Column, seed: int) -> Column:
    """The value in one of the templates of its table."""
    index = F.floor(uniform(seed, "note-template", table, *cell) * F.size(templates)).cast("int")
    number = pick_int(seed, "note-number", 1, 5, table, *cell).cast("string")
    return F.replace(F.replace(F.get(templates, index), F.lit("{number}"), number), F.lit("{value}"), value)


def add_notes(
    cells: DataFrame, table: str, cell: Sequence[str], value: str, seed: int, strength: int | str = 20, slices: int = SLICES
) -> DataFrame:
    """A share of the filled cells of each table gets a note."""
    percent = checked(strength)
    filled = cells.filter(is_filled(F.col(value))).withColumn("_h", digest(seed, "note", table, *cell))
    ranked = hash_ranked(filled, [table], "_h", list(cell), "_rn", "_n", slices)
    noted = with_note(note_templates(seed, table), table, cell, F.col(value), seed)
    changed = ranked.withColumn(
        value, F.when(F.col("_rn") <= share_of(F.col("_n"), percent), noted).otherwise(F.col(value))
    ).drop("_h", "_rn", "_n")
    rest = cells.filter(~F.coalesce(is_filled(F.col(value)), F.lit(False)))
    return changed.unionByName(rest)


def noisy(text: Column, seed: Column, strength: Column) -> Column:
    """Noise for short texts: neighbours change places, or invisible characters go between them.

    Digits are never touched, so numbers keep their order. ``seed`` is a digest per text; the gaps between two
    non-digits are ranked by digests of it, and ``strength`` percent of them are used, of swaps in one or two rounds. An empty text,
    or one without a gap, gets an invisible character at its end; null stays.
    """
    # every array is bound once: a lambda would work it out again for each element
    gapped = let(F.split(text, ""), lambda chars: _noisy_chars(text, chars, seed, strength))
    return F.when(~text.rlike(r"\P{Nd}\P{Nd}"), F.concat(text, _invisible(seed, F.length(text)))).otherwise(gapped)


def _invisible(seed: Column, i: Column) -> Column:
    which = F.floor(unit_interval(F.md5(F.concat_ws("|", seed, F.lit("sign"), i))) * len(INVISIBLE)).cast("int")
    return F.get(F.array(*[F.lit(c) for c in INVISIBLE]), which)


def _noisy_chars(text: Column, chars: Column, seed: Column, strength: Column) -> Column:
    size = F.size(chars)

    def gaps_of(shape: Column) -> Column:
        """Gaps of a text whose digits all became noughts."""
        free = lambda i: F.get(shape, i) != "0"
        return F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: (i > 0) & free(i - 1) & free(i))

    def swapped(have: Column, i: Column) -> Column:
        return F.concat(F.slice(have, F.lit(1), i - 1), F.array(F.get(have, i), F.get(have, i - 1)), F.slice(have, i + 2, size))

    def in_gaps(gaps: Column) -> Column:
        share = F.floor(F.size(gaps) * strength / 100).cast("int")

        def spots(n: Column, draw: str) -> Column:
            ranked = F.sort_array(F.transform(gaps, lambda i: F.struct(F.md5(F.concat_ws("|", seed, F.lit(draw), i)).alias("h"), i.alias("i"))))
            return F.transform(F.slice(ranked, F.lit(1), n), lambda g: g["i"])

        again = F.when(first_half(F.md5(F.concat_ws("|", seed, F.lit("rounds")))), spots(share, "second")).otherwise(F.array().cast("array<int>"))
        moved = F.array_join(F.aggregate(F.concat(spots(share, "gap"), again), chars, swapped), "")
        filled = let(
            spots(F.greatest(share, F.lit(1)), "gap"),
            lambda at: F.array_join(F.transform(chars, lambda c, i: F.when(F.array_contains(at, i), F.concat(_invisible(seed, i), c)).otherwise(c)), ""),
        )
        swaps = (share > 0) & first_half(F.md5(F.concat_ws("|", seed, F.lit("kind"))))
        return F.when(swaps, moved).otherwise(filled)

    return let(F.split(F.regexp_replace(text, r"\p{Nd}", "0"), ""), lambda shape: let(gaps_of(shape), in_gaps))


def textual(text: Column) -> Column:
    """Whether anything but digits is left."""
    return text.rlike("[^0-9]")


def typos(cells: DataFrame, table: str, seed: int, strength: int | str = 20, slices: int = SLICES) -> DataFrame:
    """Noise in a share of the cells, row labels and column labels of every table.

    Labels are perturbed once per table and path, so all cells of a line keep the same label.
    """
    percent = checked(strength).alias("_percent")
    cells = materialise(cells, "typo-cells")
    def label_slots(path):
        spot = F.filter(F.sequence(F.lit(0), F.size(path) - 1), lambda i: textual(F.get(F.col(path), i)))
        slots = cells.select(table, path, percent).distinct().withColumn("_spots", spot).filter(F.size("_spots") > 0)
        index = F.floor(uniform(seed, f"level-{path}", table, F.array_join(path, "|")) * F.size("_spots")).cast("int")
        level = F.get("_spots", index)
        return slots.select(
            table, F.lit(path).alias("kind"), F.col(path).alias("path"), F.array().cast("array<string>").alias("other"),
            level.alias("level"), F.get(F.col(path), level).alias("text"), "_percent",
        )

    data = cells.filter(textual(F.col("value"))).select(
        table, F.lit("data").alias("kind"), F.col("row_path").alias("path"), F.col("col_path").alias("other"),
        F.lit(None).cast("int").alias("level"), F.col("value").alias("text"), percent,
    )
    slots = data.unionByName(label_slots("row_path")).unionByName(label_slots("col_path"))
    key = digest(seed, "typo", table, "kind", F.array_join("path", "|"), F.array_join("other", "|"))
    ranked = hash_ranked(slots.withColumn("_h", key), [table], "_h", [], "_rn", "_n", slices)
    chosen = ranked.filter(F.col("_rn") <= share_of(F.col("_n"), F.col("_percent")))
    changed = materialise(
        chosen.withColumn("noise", noisy(F.col("text"), F.col("_h"), F.col("_percent"))).select(
            table, "kind", "path", "other", "level", "noise"
        ),
        "typo-slots",
    )
    new_value = changed.filter("kind = 'data'").select(
        table, F.col("path").alias("row_path"), F.col("other").alias("col_path"), F.col("noise").alias("_value")
    )
    out = cells.join(new_value, [table, "row_path", "col_path"], "left").withColumn("value", F.coalesce("_value", "value"))
    for path in ("row_path", "col_path"):
        labels = changed.filter(F.col("kind") == path).select(
            table, F.col("path").alias(path), F.col("level").alias("_level"), F.col("noise").alias("_label")
        )
        renamed = F.transform(path, lambda x, i: F.when(i == F.col("_level"), F.col("_label")).otherwise(x))
        out = (
            out.join(labels, [table, path], "left")
            .withColumn(f"_{path}", F.when(F.col("_level").isNotNull(), renamed).otherwise(F.col(path)))
            .drop("_level", "_label")
        )
    return out.withColumn("row_path", F.col("_row_path")).withColumn("col_path", F.col("_col_path")).drop(
        "_value", "_row_path", "_col_path"
    )


def layout_cells(rel: DataFrame, layouts: DataFrame, table: str, attributes: Sequence[str]) -> DataFrame:
    """Row and column paths of every row by the layout its table was given.

    The layout is taken apart once per table; a row only joins the attribute values of each side.
    """
    sides = {}
    for name, part in (("row_path", 0), ("col_path", 1)):
        listed = F.split(F.split("layout", r" \| ")[part], "; ")
        sides[name] = [F.array_contains(listed, c).alias(f"_{name}_{c}") for c in attributes]
    flags = layouts.select(table, *sides["row_path"], *sides["col_path"])
    out = rel.dropna(subset=list(attributes)).join(flags, table)
    for name in sides:
        text = F.concat_ws(PATH_MARK, *[F.when(F.col(f"_{name}_{c}"), F.col(c).cast("string")) for c in attributes])
        out = out.withColumn(name, F.split(text, PATH_MARK))
    return out.drop(*[f"_{name}_{c}" for name in sides for c in attributes])


def unit_header_row(cells: DataFrame, table: str, header: str, unit: str, seed: int) -> DataFrame:
    """A line above the pivot that names the value column or only its unit, once or over every column."""
    label = F.when(pick_int(seed, "only-unit", 0, 1, table) == 1, unit).otherwise(header)
    filled = pick_int(seed, "filled", 0, 1, table) == 1
    lines = cells.groupBy(table, "col_path").agg(F.max(F.size("row_path")).alias("_levels"))
    first = lines.groupBy(table).agg(F.min("col_path").alias("_first"))
    head = lines.join(first, table).withColumn("_label", label)
    rows = head.select(
        table,
        F.array_repeat("_label", F.col("_levels")).alias("row_path"),
        "col_path",
        F.when(filled | (F.col("col_path") == F.col("_first")), F.col("_label")).otherwise("").alias("value"),
        F.lit(True).alias("is_header"),
    )
    body = cells.select(table, "row_path", "col_path", F.col("value").cast("string").alias("value"), F.lit(False).alias("is_header"))
    return body.unionByName(rows)

"""HTML tables: extraction from text, cells with spans, header depths and paths, rendering."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Table, row and cell patterns.
MARK = "\u0001"
TABLE = r"(?is)<table\b.*?</table>"
ROW = r"(?is)<tr\b[^>]*>(.*?)</tr>"
CELL = r"(?is)<(th|td)\b([^>]*)>(.*?)</(?:th|td)>"

CELL_FIELDS = [
    T.StructField("header_rows", T.IntegerType()),
    T.StructField("header_cols", T.IntegerType()),
    T.StructField("row", T.IntegerType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("source", T.IntegerType()),
    T.StructField("is_header", T.BooleanType()),
    T.StructField("text", T.StringType()),
]


def table_texts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TABLE})"), 1)


def tables_in_text(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per table with its number and its start and end offset in the text."""
    found = df.select(*keys, table_texts(F.col(text)).alias("_t"), F.split(F.col(text), TABLE, -1).alias("_b"))

    def lengths(arr, n):
        return F.aggregate(F.slice(arr, F.lit(1), n), F.lit(0), lambda acc, x: acc + F.length(x))

    placed = F.transform(
        "_t",
        lambda t, i: F.struct(
            i.alias("table_no"),
            (lengths(F.col("_b"), i + 1) + lengths(F.col("_t"), i)).alias("start"),
            t.alias("table_html"),
        ),
    )
    return (
        found.select(*keys, F.explode(placed).alias("_table"))
        .select(*keys, "_table.*")
        .withColumn("end", F.col("start") + F.length("table_html"))
    )


def replace_tables(text: Column, tables: Column) -> Column:
    """Text with its tables replaced in order; a different number of tables is an error."""
    around = F.split(text, TABLE, -1)
    return F.when(
        F.size(tables) == F.size(around) - 1,
        F.array_join(F.zip_with(around, tables, lambda a, t: F.concat(a, F.coalesce(t, F.lit("")))), ""),
    ).otherwise(F.raise_error(F.concat(F.lit("expected "), (F.size(around) - 1).cast("string"), F.lit(" tables"))))


_ROW, _CELL = re.compile(ROW), re.compile(CELL)
_INNER_TAG = re.compile(r"<[^>]*>")
#: Largest spans that the HTML standard allows.
_MOST = {"rowspan": 65534, "colspan": 1000}
_SPAN = {name: re.compile(rf"""(?i)\b{name}\s*=\s*["']?(\d+)""") for name in ("rowspan", "colspan")}


def _cell_text(inner: str) -> str:
    parts = (entities.unescape(p).strip() for p in _INNER_TAG.split(inner))
    return " ".join(p for p in parts if p)


def _place(table_html: str) -> list[tuple]:
    """Grid cells of a table, spans expanded: a cell goes to the next column of its row that no
    earlier row span covers.  Short rows are padded with cells that have no source."""
    rows = _ROW.findall(table_html)
    grid: dict[tuple[int, int], tuple] = {}
    source = 0
    for r, row in enumerate(rows):
        col = 0
        for kind, attributes, inner in _CELL.findall(row):
            while (r, col) in grid:
                col += 1
            down, right = (
                min(max(int(found.group(1)), 1), _MOST[name]) if (found := _SPAN[name].search(attributes)) else 1
                for name in ("rowspan", "colspan")
            )
            entry = (source, kind.lower() == "th", _cell_text(inner))
            source += 1
            for i in range(min(down, len(rows) - r)):
                for j in range(right):
                    grid.setdefault((r + i, col + j), entry)
            col += right
    width = max((c for _, c in grid), default=-1) + 1
    return [(r, c, *grid.get((r, c), (None, False, ""))) for r in range(len(rows)) for c in range(width)]


def _depth(cells: list[tuple], axis: int) -> int:
    """Leading lines whose occupied cells are all headers."""
    lines: dict[int, list[bool]] = {}
    for cell in cells:
        lines.setdefault(cell[axis], []).append(cell[3] if cell[2] is not None else None)
    depth = 0
    for _, flags in sorted(lines.items()):
        occupied = [f for f in flags if f is not None]
        if not occupied or not all(occupied):
            break
        depth += 1
    return depth


def html_cells(df: DataFrame, keys: list[str], html: str) -> DataFrame:
    """One row per grid position of every table, with the header depths of the table.

    Tables are parsed where they are; nothing is shuffled.
    """
    names = [f.name for f in CELL_FIELDS]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, repeats = [], []
            for text in batch[html]:
                cells = _place(text) if isinstance(text, str) else []  # a missing page has no cells
                top = _depth(cells, 0)
                left = _depth([c for c in cells if c[0] >= top], 1)
                out.extend((top, left, *c) for c in cells)
                repeats.append(len(cells))
            flat = pd.DataFrame(out, columns=names).astype({"source": "Int32"})
            labels = batch[keys].loc[batch.index.repeat(repeats)].reset_index(drop=True)
            yield pd.concat([labels, flat], axis=1)

    schema = T.StructType([df.schema[k] for k in keys] + CELL_FIELDS)
    return df.select(*keys, html).mapInPandas(parse, schema)


def body_with_paths(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Body cells with the header labels of their row and column."""

    def side(along, across, depth, first):
        labels = cells.filter((F.col(across) < F.col(depth)) & (F.col(along) >= F.col(first)))
        ordered = F.array_sort(F.collect_list(F.struct(F.col(across).alias("at"), F.col("text").alias("text"))))
        return labels.groupBy(*keys, along).agg(F.transform(ordered, lambda s: s["text"]).alias(f"{along}_path"))

    rows = side("row", "col", "header_cols", "header_rows")
    cols = side("col", "row", "header_rows", "header_cols")
    body = cells.filter((F.col("row") >= F.col("header_rows")) & (F.col("col") >= F.col("header_cols")))
    empty = F.array().cast("array<string>")
    return (
        body.join(rows, [*keys, "row"], "left")
        .join(cols, [*keys, "col"], "left")
        .withColumn("row_path", F.coalesce("row_path", empty))
        .withColumn("col_path", F.coalesce("col_path", empty))
    )


def tag(name: str, content: Column, attributes: Column | None = None) -> Column:
    return F.concat(F.lit(f"<{name}"), attributes if attributes is not None else F.lit(""), F.lit(">"), content, F.lit(f"</{name}>"))


def join_all(parts: Column) -> Column:
    return F.array_join(parts, "")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def render_rows(df: DataFrame, table: str, row_id: str, columns: dict[str, Column], per_page: int = 500) -> DataFrame:
    """Relational tables as HTML without an index.

    ``columns`` maps header names to text columns.  Rows are rendered where they are; only the text
    of one page of rows comes together.  Tables up to ``per_page`` rows are a single page.
    """
    head = "<thead><tr>" + "".join(f"<th>{entities.escape(c, quote=False)}</th>" for c in columns) + "</tr></thead>"
    line = tag("tr", F.concat(*[tag("td", escape(c)) for c in columns.values()]))
    page = df.select(table, row_id, line.alias("_tr")).withColumn("page", F.floor(F.col(row_id) / F.lit(per_page)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(row_id, "_tr"))), lambda s: s["_tr"])
    body = tag("tbody", join_all(ordered))
    return page.groupBy(table, "page").agg(
        F.concat(F.lit("<table>" + head), body, F.lit("</table>")).alias("html")
    )


def _level_labels(k: int) -> Column:
    return F.transform("_cols", lambda c: tag("th", escape(F.get(c["p"], F.lit(k)))))


def render_pivot(cells: DataFrame, table: str, row_levels: int, col_levels: int) -> DataFrame:
    """Hierarchical pivots as HTML with merged outer labels.

    Meant for pivots after ``shrink``, which have at most ten rows and columns, so the cells of one
    table are a small array.
    """
    text = cells.select(
        table, F.array_join("row_path", MARK).alias("r"), F.array_join("col_path", MARK).alias("c"), "value"
    )
    small = text.groupBy(table).agg(F.collect_list(F.struct("r", "c", "value")).alias("_cells"))
    keys = lambda side: F.array_sort(F.array_distinct(F.transform("_cells", lambda x: x[side])))
    parts = lambda side: F.transform(keys(side), lambda k: F.struct(k.alias("key"), F.split(k, MARK).alias("p")))
    small = small.withColumn("_rows", parts("r")).withColumn("_cols", parts("c"))
    corner = F.lit("<th></th>" * row_levels)
    heads = []
    for k in range(col_levels):
        if k == 0 and col_levels > 1:
            outer = F.array_distinct(F.transform("_cols", lambda c: c["p"][0]))
            labels = F.transform(
                outer,
                lambda o: tag(
                    "th", escape(o),
                    F.concat(F.lit(' colspan="'), F.size(F.filter("_cols", lambda c: c["p"][0] == o)).cast("string"), F.lit('"')),
                ),
            )
        else:
            labels = _level_labels(k)
        heads.append(tag("tr", F.concat(corner, join_all(labels))))

    def body_row(r, i):
        first = (i == 0) | (F.get(F.col("_rows"), i - 1)["p"][0] != r["p"][0])
        span = F.size(F.filter("_rows", lambda o: o["p"][0] == r["p"][0])).cast("string")
        if row_levels > 1:
            outer = F.when(first, tag("th", escape(r["p"][0]), F.concat(F.lit(' rowspan="'), span, F.lit('"')))).otherwise("")
        else:
            outer = tag("th", escape(r["p"][0]))
        inner = [tag("th", escape(F.get(r["p"], F.lit(k)))) for k in range(1, row_levels)]
        mine = F.map_from_entries(
            F.transform(F.filter("_cells", lambda x: x["r"] == r["key"]), lambda x: F.struct(x["c"], x["value"]))
        )
        values = F.transform("_cols", lambda c: tag("td", escape(F.coalesce(F.element_at(mine, c["key"]), F.lit("")))))
        return tag("tr", F.concat(outer, *inner, join_all(values)))

    body = tag("tbody", join_all(F.transform("_rows", body_row)))
    text = F.concat(F.lit("<table>"), tag("thead", F.concat(*heads)), body, F.lit("</table>"))
    return small.select(table, text.alias("html"))


def multitable_text(tables: DataFrame, sample: str, position: str, html: str) -> DataFrame:
    """``Table i`` headings and tables of a sample in order; a sample has at most twenty tables."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(html).alias("h"))))
    parts = F.transform(ordered, lambda s, i: F.concat(F.lit("Table "), i.cast("string"), F.lit("\n\n"), s["h"]))
    return tables.groupBy(sample).agg(F.array_join(parts, "\n\n").alias("text"))

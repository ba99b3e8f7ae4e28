"""Perturbation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.numbers import plain, sql_plain
from tabloom.functions.sampling import pick, pick_int, sql_digest, sql_pick, sql_pick_int, sql_uniform
from tabloom.operators import labels, perturb, pivot
from tabloom.operators.units import NULL_TOKENS
from tabloom.plans.labels import TUPLE, sql_cells
from tabloom.plans.pivots import SPLIT_ATTRIBUTES, sql_density, sql_shrink
from tabloom.plans.registry import query
from tabloom.sources.tables import SQL_ORDER_TABLES, order_tables


def marked_tables(spark, sf_dir):
    """Order tables with the value as text and one row in ten needed."""
    return order_tables(spark, sf_dir).withColumn("needed", pick_int(60, "need", 1, 10, "row_id") == 1)


SQL_MARKED = f"{SQL_ORDER_TABLES}, marked AS (SELECT *, {sql_pick_int(60, 'need', 1, 10, 'row_id')} = 1 AS needed FROM rel)"


def with_nulls(spark, sf_dir):
    texts = marked_tables(spark, sf_dir).withColumn("price", plain(F.col("price"), 2))
    return perturb.null_inject(texts, "table_id", ["row_id"], "price", 61)


SQL_NULLED = f"""{SQL_MARKED}, nulled AS (SELECT * EXCLUDE (price), CASE WHEN NOT needed AND {sql_uniform(61, "null", "table_id", "row_id")} < 0.5
  THEN {sql_pick(61, "null-token", NULL_TOKENS, "table_id")} ELSE {sql_plain("price", 2)} END AS price FROM marked)"""


@query("null_inject", f"WITH {SQL_NULLED} SELECT table_id, row_id, needed, price FROM nulled")
def null_inject(spark, sf_dir):
    return with_nulls(spark, sf_dir).select("table_id", "row_id", "needed", "price")


@query("entity_missing", f"""
WITH {SQL_MARKED}, gone AS (SELECT table_id, row_id FROM marked WHERE needed
  QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY {sql_digest(62, "missing", "table_id", "row_id")}) = 1)
SELECT table_id, row_id, needed FROM marked ANTI JOIN gone USING (table_id, row_id)
""")
def entity_missing(spark, sf_dir):
    return perturb.entity_missing(marked_tables(spark, sf_dir), "table_id", "row_id", 62).select("table_id", "row_id", "needed")


@query("value_contradiction", f"""
WITH {SQL_MARKED} SELECT row_id, {sql_plain("price")} || ' (' || {sql_plain(f"price + {sql_pick_int(63, 'contradiction', 1, 10, 'row_id')}")} || ')' AS price FROM marked
""")
def value_contradiction(spark, sf_dir):
    return perturb.value_contradiction(marked_tables(spark, sf_dir), ["row_id"], "price", 63).select("row_id", "price")


COLUMNS = ["status", "priority", "year", "price"]


@query("merge_columns", f"""
WITH {sql_cells("merge", 3)}, names AS (SELECT table_id, col, row_number() OVER (PARTITION BY table_id ORDER BY {sql_digest(64, "merge", "table_id", "col")}) AS k
  FROM (SELECT DISTINCT table_id FROM rel), (VALUES ('status'), ('priority'), ('year'), ('price')) v(col)),
ch AS (SELECT table_id, max(col) FILTER (WHERE k = 1) AS c1, max(col) FILTER (WHERE k = 2) AS c2 FROM names GROUP BY table_id),
co AS (SELECT table_id, count(DISTINCT (priority, year)) < count(*) AS s, count(DISTINCT (status, year)) < count(*) AS p,
  count(DISTINCT (status, priority)) < count(*) AS y FROM cells GROUP BY table_id),
x AS (SELECT ch.*, CASE WHEN c1 = 'price' THEN c2 WHEN c2 = 'price' THEN c1 END AS absorbed, s, p, y FROM ch LEFT JOIN co ON co.table_id = ch.table_id),
z AS (SELECT *, coalesce(CASE absorbed WHEN 'status' THEN s WHEN 'priority' THEN p WHEN 'year' THEN y END, false) AS skipped FROM x),
h AS (SELECT rel.table_id, row_id, c1, c2, absorbed, skipped, MAP {{'status': status, 'priority': priority, 'year': year, 'price': {sql_plain("price", 2)}}} AS m
  FROM rel JOIN z ON z.table_id = rel.table_id)
SELECT table_id, row_id, skipped, CASE WHEN NOT skipped THEN c1 || ' (' || c2 || ')' END AS merged_name,
  CASE WHEN NOT skipped THEN m[c1] || ' (' || m[c2] || ')' END AS merged_value, absorbed IS NOT NULL AND NOT skipped AS is_value FROM h
""")
def merge_columns(spark, sf_dir):
    rel = order_tables(spark, sf_dir)
    branches = labels.sampled_cells(rel, "table_id", TUPLE, "price", 3, "merge").select("table_id", *TUPLE)
    texts = rel.withColumn("price", plain(F.col("price"), 2))
    return perturb.merge_columns(texts, "table_id", COLUMNS, "price", branches, 64).select(
        "table_id", "row_id", "skipped", "merged_name", "merged_value", "is_value"
    )


@query("merge_rows", f"""
WITH {SQL_ORDER_TABLES}, t AS (SELECT table_id, row_id, status, priority, year, row_number() OVER (PARTITION BY table_id ORDER BY {sql_digest(65, "merge-rows", "table_id", "row_id")}) AS rn FROM rel)
SELECT table_id, CAST(row_id AS VARCHAR) AS row_id, status, priority, year FROM t WHERE rn > 2
UNION ALL SELECT a.table_id, a.row_id || '_' || b.row_id, a.status || ' (' || b.status || ')', a.priority || ' (' || b.priority || ')', a.year || ' (' || b.year || ')'
FROM t a JOIN t b ON a.table_id = b.table_id AND a.rn = 1 AND b.rn = 2
""")
def merge_rows(spark, sf_dir):
    return perturb.merge_rows(order_tables(spark, sf_dir), "table_id", "row_id", TUPLE, 65)


def with_units(spark, sf_dir):
    usual = pick(66, "unit", ["USD", "EUR", "GBP"], "table_id")
    unit = F.when(pick_int(66, "odd", 1, 60, "row_id") == 1, "JPY").otherwise(usual)
    return with_nulls(spark, sf_dir).withColumn("unit", unit)


SQL_UNIT_ROWS = f"""{SQL_NULLED}, un AS (SELECT *, CASE WHEN {sql_pick_int(66, "odd", 1, 60, "row_id")} = 1 THEN 'JPY'
  ELSE {sql_pick(66, "unit", ["USD", "EUR", "GBP"], "table_id")} END AS unit FROM nulled)"""
SQL_TOKENS = ", ".join("'" + t + "'" for t in NULL_TOKENS)


@query("unit_in_cell", f"""
WITH {SQL_UNIT_ROWS} SELECT row_id, CASE WHEN trim(price) IN ({SQL_TOKENS}) THEN price ELSE price || ' ' || unit END AS price FROM un
""")
def unit_in_cell(spark, sf_dir):
    return perturb.show_units(with_units(spark, sf_dir), "table_id", "price", "unit", F.lit(True)).select("row_id", "price")


@query("unit_in_header", f"""
WITH {SQL_UNIT_ROWS}, t AS (SELECT table_id, min(unit) AS lo, max(unit) AS hi FROM un GROUP BY table_id)
SELECT row_id, CASE WHEN lo = hi THEN 'price (' || lo || ')' ELSE 'price' END AS header,
  CASE WHEN lo = hi OR trim(price) IN ({SQL_TOKENS}) THEN price ELSE price || ' ' || unit END AS price FROM un JOIN t USING (table_id)
""")
def unit_in_header(spark, sf_dir):
    return perturb.show_units(with_units(spark, sf_dir), "table_id", "price", "unit", F.lit(False)).select(
        "row_id", "header", "price"
    )


def sql_blanks(lines, op):
    spots = ", ".join(f"CAST(floor({sql_uniform(67, f'{op}-{i}', 'table_id')} * (n + {i + 1})) AS INTEGER) AS p{i}" for i in range(3))
    return f"""sizes AS (SELECT table_id, max(pos) + 1 AS n FROM {lines} GROUP BY table_id),
sp AS (SELECT table_id, {sql_pick_int(67, op, 1, 3, "table_id")} AS k, {spots} FROM sizes),
m1 AS (SELECT l.table_id, l.pos, k, p1, p2, l.pos + (l.pos >= p0)::INT AS a FROM {lines} l JOIN sp ON sp.table_id = l.table_id),
m2 AS (SELECT *, a + (k >= 2 AND a >= p1)::INT AS b FROM m1),
moved AS (SELECT table_id, b + (k >= 3 AND b >= p2)::INT AS position, pos AS old_position FROM m2),
b0 AS (SELECT *, p0 + (k >= 2 AND p0 >= p1)::INT AS q FROM sp),
blanks AS (SELECT table_id, q + (k >= 3 AND q >= p2)::INT AS position FROM b0
  UNION ALL SELECT table_id, p1 + (k >= 3 AND p1 >= p2)::INT FROM sp WHERE k >= 2 UNION ALL SELECT table_id, p2 FROM sp WHERE k >= 3)"""


@query("blank_rows", f"""
WITH {SQL_ORDER_TABLES}, lines AS (SELECT table_id, CAST(row_id % 20 AS INTEGER) AS pos FROM rel), {sql_blanks("lines", "blank-row")}
SELECT table_id, position, old_position FROM moved UNION ALL SELECT table_id, position, NULL FROM blanks
""")
def blank_rows(spark, sf_dir):
    rows = order_tables(spark, sf_dir).select("table_id", (F.col("row_id") % 20).cast("int").alias("pos"))
    return perturb.insert_blanks(rows, "table_id", "pos", 67, "blank-row")


@query("blank_columns", f"""
WITH {SQL_ORDER_TABLES}, cols AS (SELECT DISTINCT table_id, CAST(pos AS INTEGER) AS pos FROM rel, (VALUES (0),(1),(2),(3)) v(pos)), {sql_blanks("cols", "blank-col")}
SELECT table_id, position, old_position FROM moved UNION ALL SELECT table_id, position, NULL FROM blanks
""")
def blank_columns(spark, sf_dir):
    columns = order_tables(spark, sf_dir).select("table_id").distinct().withColumn(
        "pos", F.explode(F.array(*[F.lit(i) for i in range(len(COLUMNS))]))
    )
    return perturb.insert_blanks(columns, "table_id", "pos", 67, "blank-col")


def block_cells(df):
    """Cells of relational tables: one row per table, row and column."""
    parts = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in COLUMNS])
    return df.select("table_id", "row_id", F.explode(parts).alias("c")).select("table_id", "row_id", "c.col", "c.value")


def sql_note_templates():
    use, options = [], []
    for category, templates in perturb.NOTES.items():
        use.append(f"{sql_uniform(68, f'use-{category}', 'table_id')} < 0.5")
        options.append(sql_pick(68, category, templates, "table_id"))
    chosen = "list_filter([" + ", ".join(f"CASE WHEN {u} THEN {o} END" for u, o in zip(use, options)) + "], lambda x: x IS NOT NULL)"
    fallback = f"([{', '.join(options)}])[{sql_pick_int(68, 'category', 1, 3, 'table_id')}]"
    return f"CASE WHEN len({chosen}) > 0 THEN {chosen} ELSE [{fallback}] END"


@query("add_notes", f"""
WITH {SQL_NULLED}, cl AS (SELECT table_id, row_id, unnest(['status','priority','year','price']) AS col, unnest([status, priority, year, price]) AS value FROM nulled),
tp AS (SELECT table_id, {sql_note_templates()} AS tpl FROM (SELECT DISTINCT table_id FROM rel)),
f AS (SELECT *, count(*) OVER (PARTITION BY table_id) AS n, row_number() OVER (PARTITION BY table_id ORDER BY {sql_digest(68, "note", "table_id", "row_id", "col")}) AS rn
  FROM cl WHERE trim(value) NOT IN ({SQL_TOKENS}))
SELECT f.table_id, row_id, col, CASE WHEN rn <= greatest(1, floor(n * 20 / 100)) THEN replace(replace(
  tpl[CAST(floor({sql_uniform(68, "note-template", "f.table_id", "row_id", "col")} * len(tpl)) AS INTEGER) + 1],
  '{{number}}', CAST({sql_pick_int(68, "note-number", 1, 5, "f.table_id", "row_id", "col")} AS VARCHAR)), '{{value}}', value) ELSE value END AS value
FROM f JOIN tp ON tp.table_id = f.table_id
UNION ALL SELECT table_id, row_id, col, value FROM cl WHERE trim(value) IN ({SQL_TOKENS})
""")
def add_notes(spark, sf_dir):
    cells = block_cells(with_nulls(spark, sf_dir))
    return perturb.add_notes(cells, "table_id", ["row_id", "col"], "value", 68, slices=1)


def shrunk(spark, sf_dir):
    """Pivots of the order tables in their best layout, limited to ten rows and columns."""
    rel = marked_tables(spark, sf_dir)
    layouts = pivot.split_search(rel, ["table_id"], SPLIT_ATTRIBUTES, 11)
    cells = (
        perturb.layout_cells(rel, layouts, "table_id", SPLIT_ATTRIBUTES)
        .groupBy("table_id", "row_path", "col_path")
        .agg(F.min_by(plain(F.col("price"), 2), "row_id").alias("value"), F.bool_or("needed").alias("needed"))
    )
    return pivot.shrink(cells, "table_id", 69)


def sql_layout_path(side):
    parts = ", ".join(f"CASE WHEN contains(split_part(layout, ' | ', {side}), '{c}') THEN {c} END" for c in SPLIT_ATTRIBUTES)
    return f"concat_ws('|', {parts})"


SQL_SHRUNK = f"""{SQL_MARKED}, s AS ({" UNION ALL ".join(sql_density("rel", ["table_id"], r, c) for r, c in pivot.splits_of(SPLIT_ATTRIBUTES))}),
best AS (SELECT table_id, r || ' | ' || c AS layout, nr FROM s WHERE pivot_rows > 1 AND pivot_columns > 1
  QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY (filled = pivot_rows * pivot_columns) DESC,
    filled / CAST(pivot_rows * pivot_columns AS DOUBLE) DESC, {sql_digest(11, "split", "table_id", "r || ' | ' || c")}) = 1),
cells AS (SELECT m.table_id, {sql_layout_path(1)} AS row_path, {sql_layout_path(2)} AS col_path, min_by({sql_plain("price", 2)}, row_id) AS value,
    bool_or(needed) AS needed, max(nr) AS nr FROM marked m JOIN best b ON m.table_id = b.table_id GROUP BY ALL),
{sql_shrink(69)}"""


@query("multiheader_pivot", f"""
WITH {SQL_SHRUNK}, lab AS (SELECT table_id, CASE WHEN {sql_pick_int(70, "only-unit", 0, 1, "table_id")} = 1 THEN 'USD' ELSE 'price (USD)' END AS label,
   {sql_pick_int(70, "filled", 0, 1, "table_id")} = 1 AS filled, min(col_path) AS first_col, max(nr) AS nr FROM after_col_path GROUP BY table_id),
hd AS (SELECT DISTINCT a.table_id, CASE nr WHEN 1 THEN label ELSE label || '|' || label END AS row_path, a.col_path,
   CASE WHEN filled OR a.col_path = first_col THEN label ELSE '' END AS value FROM after_col_path a JOIN lab USING (table_id, nr))
SELECT table_id, row_path, col_path, value, false AS is_header FROM after_col_path UNION ALL SELECT table_id, row_path, col_path, value, true FROM hd
""")
def multiheader_pivot(spark, sf_dir):
    """Best split, pivot, shrink, unit header row."""
    out = perturb.unit_header_row(shrunk(spark, sf_dir), "table_id", "price (USD)", "USD", 70)
    return out.withColumn("row_path", F.array_join("row_path", "|")).withColumn("col_path", F.array_join("col_path", "|"))


@query("typos")
def typos(spark, sf_dir):
    noisy = perturb.typos(shrunk(spark, sf_dir), "table_id", 71, 20, slices=1)
    return noisy.select("table_id", F.array_join("row_path", "|").alias("row_path"), F.array_join("col_path", "|").alias("col_path"), "value")

"""Cell location and masking over parsed web tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.sampling import digest, sql_digest
from tabloom.operators import locate, pivot
from tabloom.operators.ranking import top_rows
from tabloom.plans.registry import query
from tabloom.session import materialise
from tabloom.sources import html
from tabloom.sources.tables import SQL_SUPPLIER_LINES, load, supplier_lines


def quantity_cells(spark, sf_dir):
    """Supplier pivots of quantities, whose small numbers repeat between cells and headers."""
    lines = supplier_lines(spark, sf_dir).withColumn("measure", F.lit("amount"))
    cells = pivot.pivot_cells(lines, ["table_id"], ["flag", "line_status"], ["measure", "line"], "quantity", "first", "row_key")
    return materialise(cells.withColumn("value", F.col("value").cast("string")), "quantities")


def parsed(pivots):
    """Pivots written as HTML and parsed back, computed once: grid cells and body cells."""
    pages = html.render_pivot(pivots, "table_id", 2, 2)
    cells = materialise(html.html_cells(pages, ["table_id"], "html"), "grid")
    return cells, materialise(html.body_with_paths(cells, ["table_id"]), "body")


def questions(pivots, most=1):
    """Queries of each table: the quantity at the flag, status and line of a random cell, or of ``most`` of them."""
    cells = pivots.withColumn(
        "_h", digest(80, "ask", "table_id", F.array_join(F.concat("row_path", "col_path"), "|"))
    )
    asked = top_rows(cells, ["table_id"], ["_h"], most, "query_id")
    predicate = lambda field, value: F.struct(F.lit(field).alias("field"), F.array(value).alias("values"))
    return asked.select(
        "table_id", F.lit("amount").alias("select_field"),
        F.array(
            predicate("flag", F.col("row_path")[0]), predicate("status", F.col("row_path")[1]),
            predicate("line", F.col("col_path")[1]),
        ).alias("predicates"),
        "query_id",
    )


SQL_GRID = f"""{SQL_SUPPLIER_LINES}, v AS (SELECT table_id, flag, line_status, CAST(line AS VARCHAR) AS line, CAST(min_by(quantity, row_key) AS VARCHAR) AS value
  FROM lines GROUP BY ALL),
r AS (SELECT table_id, flag, line_status, row_number() OVER (PARTITION BY table_id ORDER BY flag, line_status) + 1 AS "row" FROM (SELECT DISTINCT table_id, flag, line_status FROM v)),
c AS (SELECT table_id, line, row_number() OVER (PARTITION BY table_id ORDER BY line) + 1 AS col FROM (SELECT DISTINCT table_id, line FROM v)),
body AS (SELECT r.table_id, r."row", c.col, r.flag, r.line_status, c.line, coalesce(v.value, '') AS value FROM r JOIN c ON r.table_id = c.table_id
  LEFT JOIN v ON v.table_id = r.table_id AND v.flag = r.flag AND v.line_status = r.line_status AND v.line = c.line),
target AS (SELECT b.table_id, b."row", b.col, b.value AS answer FROM body b JOIN v USING (table_id, flag, line_status, line)
  QUALIFY row_number() OVER (PARTITION BY b.table_id ORDER BY {sql_digest(80, "ask", "b.table_id", "flag || '|' || line_status || '|amount|' || line")}) = 1)"""


@query("locate_cell", f"""WITH {SQL_GRID} SELECT table_id, "row", col, answer FROM target""")
def locate_cell(spark, sf_dir):
    pivots = quantity_cells(spark, sf_dir)
    _, body = parsed(pivots)
    found = locate.locate(body, questions(pivots), "table_id")
    return found.select("table_id", "row", "col", "answer")


@query("locate_cell_queries", f"""
WITH {SQL_GRID}, asked AS (SELECT b.table_id, b."row", b.col, b.value AS answer, row_number() OVER (PARTITION BY b.table_id
    ORDER BY {sql_digest(80, "ask", "b.table_id", "flag || '|' || line_status || '|amount|' || line")}) AS query_id
  FROM body b JOIN v USING (table_id, flag, line_status, line))
SELECT table_id, query_id, "row", col, answer, NULL AS reason FROM asked WHERE query_id <= 3
UNION ALL SELECT DISTINCT table_id, 4, NULL, NULL, NULL, 'below the least score' FROM r
UNION ALL SELECT -1, 1, NULL, NULL, NULL, 'empty table'
""")
def locate_cell_queries(spark, sf_dir):
    """Up to three queries per table, one that fits nothing, and one for a table without cells."""
    pivots = quantity_cells(spark, sf_dir)
    _, body = parsed(pivots)
    asked = questions(pivots, 3)
    shape = asked.select("predicates").schema[0].dataType.simpleString()
    none = F.array().cast(shape)
    vague = pivots.select("table_id").distinct().select("table_id", F.lit("").alias("select_field"), none.alias("predicates"), F.lit(4).alias("query_id"))
    lost = spark.range(1).select(F.lit(-1).cast("long").alias("table_id"), F.lit("amount").alias("select_field"), none.alias("predicates"), F.lit(1).alias("query_id"))
    queries = materialise(asked.unionByName(vague).unionByName(lost), "queries")
    return locate.located(body, queries, "table_id", ["query_id"]).select("table_id", "query_id", "row", "col", "answer", "reason")


@query("uneven_samples", f"""
WITH {SQL_GRID}, t AS (SELECT table_id // 5 AS sample_id, count(*) AS tables FROM (SELECT DISTINCT table_id FROM r) GROUP BY 1),
q AS (SELECT table_id // 5 AS sample_id, count(*) AS queries FROM target WHERE table_id % 7 <> 0 GROUP BY 1)
SELECT sample_id, coalesce(tables, 0) AS tables, coalesce(queries, 0) AS queries FROM t FULL JOIN q USING (sample_id)
WHERE coalesce(tables, 0) <> coalesce(queries, 0)
""")
def uneven_samples(spark, sf_dir):
    """Samples of five tables that lack the query of a table (here those of every seventh supplier)."""
    pivots = quantity_cells(spark, sf_dir)
    sample = F.expr("table_id div 5").alias("sample_id")
    tables = pivots.select("table_id").distinct().select(sample)
    return locate.uneven_samples(tables, questions(pivots).where("table_id % 7 <> 0").select(sample), "sample_id")


@query("label_similarity")
def label_similarity(spark, sf_dir):
    """Similarity of part names and of misspelt, reordered and extended forms."""
    part = load(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    other = (
        F.when(F.col("p_size") % 3 == 0, F.concat_ws("_", words[1], words[0]))
        .when(F.col("p_size") % 3 == 1, F.concat_ws(" ", "p_name", "p_type"))
        .otherwise(F.concat_ws(" ", words[0], F.reverse(words[1])))
    )
    pairs = part.select("p_partkey", F.col("p_name").alias("label"), F.lower(F.translate(other, "_", " ")).alias("text"))
    return locate.with_similarity(pairs, "label", "text").select("p_partkey", "similarity")


@query("best_label_match")
def best_label_match(spark, sf_dir):
    """How well the text 'amounts, line 3' fits the header of every column."""
    pivots = quantity_cells(spark, sf_dir)
    _, body = parsed(pivots)
    columns = body.groupBy("table_id", "col").agg(F.first("col_path").alias("path")).withColumn("text", F.lit("line 3"))
    return locate.best_label(columns, ["table_id", "col"], "path", "text")


@query("predicate_path_score")
def predicate_path_score(spark, sf_dir):
    pivots = quantity_cells(spark, sf_dir)
    _, body = parsed(pivots)
    rows = body.groupBy("table_id", "row").agg(F.first("row_path").alias("path"))
    terms = locate.query_terms(questions(pivots), "table_id")
    return locate.path_scores(rows, terms, "table_id", "row", "path")


def previous_answers(targets):
    """The answer of the supplier before is the earlier answer of a supplier."""
    return targets.select((F.col("table_id") + 1).alias("table_id"), F.col("answer").alias("previous"))


SQL_PREVIOUS = f"""{SQL_GRID}, prev AS (SELECT t.table_id + 1 AS table_id, t.answer AS previous FROM target t),
eq AS (SELECT p.table_id, p.previous, EXISTS (SELECT 1 FROM body b WHERE b.table_id = p.table_id AND b.value = p.previous) AS in_body,
   EXISTS (SELECT 1 FROM c WHERE c.table_id = p.table_id AND c.line = p.previous) AS in_cols FROM prev p WHERE p.table_id IN (SELECT table_id FROM r))"""


@query("locate_previous_value", f"""
WITH {SQL_PREVIOUS} SELECT table_id, in_body, (SELECT count(*) FROM body b WHERE b.table_id = eq.table_id AND b.value = previous) AS body_matches,
  (SELECT count(*) FROM c WHERE c.table_id = eq.table_id AND c.line = previous) AS col_matches FROM eq
""")
def locate_previous_value(spark, sf_dir):
    """Where the earlier answer occurs; an exact body match makes the kind ``body``."""
    pivots = quantity_cells(spark, sf_dir)
    _, body = parsed(pivots)
    targets = locate.locate(body, questions(pivots), "table_id")
    matches = locate.previous_matches(body, previous_answers(targets), "table_id")
    found = locate.previous_location(matches, "table_id")
    return found.select(
        "table_id", ((F.col("kind") == "body") & (F.col("score") == 1)).alias("in_body"), "body_matches", "col_matches"
    )


def sql_masked(eq):
    return f"""masked AS (SELECT b.table_id, b."row", b.col FROM body b JOIN {eq} e ON e.table_id = b.table_id WHERE
    (in_body AND b.value = previous) OR (NOT in_body AND in_cols AND b.line = previous)),
grid AS (SELECT table_id, "row", col, value AS text FROM body
  UNION ALL SELECT table_id, "row", 0, flag FROM r UNION ALL SELECT table_id, "row", 1, line_status FROM r
  UNION ALL SELECT table_id, 0, col, 'amount' FROM c UNION ALL SELECT table_id, 1, col, line FROM c
  UNION ALL SELECT DISTINCT table_id, a.i, b.j, '' FROM r, (VALUES (0),(1)) a(i), (VALUES (0),(1)) b(j)),
final AS (SELECT g.table_id, g."row", g.col, CASE
   WHEN EXISTS (SELECT 1 FROM target t WHERE t.table_id = g.table_id AND t."row" = g."row" AND t.col = g.col) THEN text
   WHEN EXISTS (SELECT 1 FROM masked m WHERE m.table_id = g.table_id AND m."row" = g."row" AND m.col = g.col) THEN 'n.a.'
   WHEN g."row" = 1 AND EXISTS (SELECT 1 FROM {eq} e WHERE e.table_id = g.table_id AND NOT in_body AND in_cols AND text = previous AND g.col >= 2) THEN 'n.a.'
   WHEN g."row" = 0 AND g.col >= 2 AND EXISTS (SELECT 1 FROM {eq} e WHERE e.table_id = g.table_id AND NOT in_body AND in_cols) THEN 'n.a.'
   ELSE text END AS text FROM grid g)"""


@query("mask_chain_table", f"""
WITH {SQL_PREVIOUS}, {sql_masked("eq")} SELECT table_id, "row", col, text FROM final
""")
def mask_chain_table(spark, sf_dir):
    pivots = quantity_cells(spark, sf_dir)
    cells, body = parsed(pivots)
    targets = materialise(locate.locate(body, questions(pivots), "table_id"), "targets")
    matches = locate.previous_matches(body, previous_answers(targets), "table_id")
    return locate.mask_previous(cells, matches, targets, "table_id").select("table_id", "row", "col", "text")


@query("mask_chain_corpus", f"""
WITH {SQL_GRID}, t AS (SELECT DISTINCT table_id, table_id // 5 AS sample_id, table_id % 5 AS place FROM r),
n AS (SELECT sample_id, count(*) AS n FROM t GROUP BY sample_id),
prev AS (SELECT t.table_id, p.answer AS previous FROM t JOIN n ON n.sample_id = t.sample_id
  JOIN t q ON q.sample_id = t.sample_id AND q.place = t.place - 1 JOIN target p ON p.table_id = q.table_id WHERE t.place BETWEEN 1 AND n - 2),
eq AS (SELECT p.table_id, p.previous, EXISTS (SELECT 1 FROM body b WHERE b.table_id = p.table_id AND b.value = p.previous) AS in_body,
   EXISTS (SELECT 1 FROM c WHERE c.table_id = p.table_id AND c.line = p.previous) AS in_cols FROM prev p),
{sql_masked("eq")} SELECT table_id // 5 AS sample_id, table_id, "row", col, text FROM final
""")
def mask_chain_corpus(spark, sf_dir):
    """Samples of five chained tables: the middle ones lose the answer of the table before."""
    pivots = quantity_cells(spark, sf_dir)
    cells, body = parsed(pivots)
    targets = materialise(locate.locate(body, questions(pivots), "table_id"), "targets")
    samples = cells.select("table_id").distinct().select(
        "table_id", F.expr("table_id div 5").alias("sample_id"), F.expr("table_id % 5").alias("place")
    )
    previous = locate.chain_previous(targets, samples, "table_id", "sample_id", "place")
    matches = locate.previous_matches(body, previous, "table_id")
    masked = locate.mask_previous(cells, matches, targets, "table_id")
    return masked.select(F.expr("table_id div 5").alias("sample_id"), "table_id", "row", "col", "text")

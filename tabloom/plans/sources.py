"""Scans, sinks and HTML sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.sampling import pick, sql_pick
from tabloom.operators import pivot
from tabloom.operators.scoring import accuracy as accuracy_of
from tabloom.operators.scoring import scored, write_scores
from tabloom.plans.registry import query
from tabloom.plans.scalars import SQL_OUTPUTS, SQL_SCORED, model_outputs, sql_normalize
from tabloom.session import materialise, scratch_path
from tabloom.sources import catalog, files, html
from tabloom.sources.tables import SQL_ORDER_TABLES, SQL_SUPPLIER_LINES, load, order_tables, supplier_lines


@query("scan_csv", f"WITH {SQL_OUTPUTS} SELECT sample_id, method, label, output FROM outputs")
def scan_csv(spark, sf_dir):
    """Written as CSV with multi-line values and read back with a schema."""
    path = scratch_path(spark, "outputs-csv")
    files.write_csv(model_outputs(spark, sf_dir).select("sample_id", "method", "label", "output"), path)
    return files.read_csv(spark, path, "sample_id long, method string, label string, output string")


PERTURBATIONS = ["typos", "notes", "blank_rows"]


@query("sink_dataset_partitioned", f"""
WITH {SQL_OUTPUTS}, d AS (SELECT *, {sql_pick(24, "perturbation", PERTURBATIONS, "sample_id")} AS perturbation FROM outputs)
SELECT sample_id, label, method, dataset AS domain, perturbation, 1 AS num_tables FROM d
WHERE perturbation = 'typos' AND method = 'sum'
""")
def sink_dataset_partitioned(spark, sf_dir):
    data = model_outputs(spark, sf_dir).select(
        "sample_id", "label", "method", F.col("dataset").alias("domain"),
        pick(24, "perturbation", PERTURBATIONS, "sample_id").alias("perturbation"),
        F.lit(1).alias("num_tables"),
    )
    path = scratch_path(spark, "dataset")
    files.write_dataset(data, path)
    return files.read_dataset(spark, path, perturbation="typos", method="sum")


@query("sink_scores", f"""
WITH {SQL_SCORED} SELECT dataset, count(*) AS samples, CAST(count(*) FILTER (WHERE match) AS DOUBLE) / count(*) AS accuracy
FROM scored GROUP BY dataset
""")
def sink_scores(spark, sf_dir):
    path = scratch_path(spark, "scores")
    accuracy_of(scored(model_outputs(spark, sf_dir)), ["dataset"]).write.parquet(path)
    return spark.read.parquet(path)


def _sunk(spark, sf_dir):
    return write_scores(model_outputs(spark, sf_dir), scratch_path(spark, "evaluation"))


SQL_SAMPLE_F1 = f"""{SQL_SCORED}, tok AS (SELECT sample_id, 'p' AS side, unnest(string_split({sql_normalize("prediction")}, ' ')) AS token FROM scored
  UNION ALL SELECT sample_id, 'g', unnest(string_split({sql_normalize("label")}, ' ')) FROM scored),
cnt AS (SELECT sample_id, token, count(*) FILTER (WHERE side = 'p') AS p, count(*) FILTER (WHERE side = 'g') AS g FROM tok WHERE token <> '' GROUP BY ALL),
tot AS (SELECT s.sample_id, coalesce(sum(p), 0)::DOUBLE AS p, coalesce(sum(g), 0)::DOUBLE AS g, coalesce(sum(least(p, g)), 0)::DOUBLE AS same
  FROM scored s LEFT JOIN cnt ON cnt.sample_id = s.sample_id GROUP BY s.sample_id),
sample_f1 AS (SELECT sample_id, prediction, label, match, CASE WHEN p = 0 AND g = 0 THEN 1.0::DOUBLE WHEN p = 0 OR g = 0 OR same = 0 THEN 0.0::DOUBLE
  ELSE 2.0::DOUBLE * (same / p) * (same / g) / (same / p + same / g) END AS f1 FROM scored JOIN tot USING (sample_id))"""


@query("sink_predictions", f"WITH {SQL_SAMPLE_F1} SELECT * FROM sample_f1")
def sink_predictions(spark, sf_dir):
    """Predictions as written, read back: with label, match and token F1."""
    schema = "sample_id long, prediction string, label string, match boolean, f1 double"
    return files.read_csv(spark, _sunk(spark, sf_dir).predictions, schema)


@query("sink_score_table", f"""
WITH {SQL_SAMPLE_F1} SELECT count(*) AS samples, count(*) FILTER (WHERE match) / count(*)::DOUBLE AS accuracy,
  CAST(sum(CAST(f1 AS DECIMAL(18,9))) AS DOUBLE) / count(*) AS mean_f1 FROM sample_f1
""")
def sink_score_table(spark, sf_dir):
    """The score observed while the predictions were written, read back."""
    return files.read_csv(spark, _sunk(spark, sf_dir).score, "samples long, accuracy double, mean_f1 double")


@query("sink_reasoning", f"WITH {SQL_OUTPUTS} SELECT sample_id, output AS reasoning FROM outputs")
def sink_reasoning(spark, sf_dir):
    """The raw texts of the model, read back."""
    return files.read_csv(spark, _sunk(spark, sf_dir).reasoning, "sample_id long, reasoning string")


@query("scan_relation", "SELECT * FROM supplier")
def scan_relation(spark, sf_dir):
    return load(spark, sf_dir, "supplier")


@query("register_temp_table", "SELECT count(*) AS rows_, count(DISTINCT c_nationkey) AS nations FROM customer")
def register_temp_table(spark, sf_dir):
    """Registering a name again replaces the earlier frame; the name is dropped after planning."""
    catalog.register(load(spark, sf_dir, "supplier"), "tabloom_frame")
    catalog.register(load(spark, sf_dir, "customer"), "tabloom_frame")
    frame = spark.table("tabloom_frame")
    catalog.forget(spark, "tabloom_frame")
    return frame.agg(F.count(F.lit(1)).alias("rows_"), F.countDistinct("c_nationkey").alias("nations"))


SQL_RUN = """SELECT o_orderpriority, count(*) AS orders, max(o_totalprice) AS largest
FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority"""


@query("run_sql", SQL_RUN)
def run_sql(spark, sf_dir):
    return spark.sql(SQL_RUN.replace("FROM orders", "FROM {orders}"), orders=load(spark, sf_dir, "orders"))


@query("nested_qa_source", f"""
WITH {SQL_ORDER_TABLES}
SELECT table_id, 'price of ' || row_id AS question, CAST(row_id AS VARCHAR) AS label, 'status|priority|order' AS header, cnt AS body_rows
FROM (SELECT *, count(*) OVER (PARTITION BY table_id) AS cnt FROM rel) WHERE priority IN ('1-URGENT', '2-HIGH') AND status <> 'P'
""")
def nested_qa_source(spark, sf_dir):
    """Nested documents (table and questions) flattened to numeric table questions."""
    rel = order_tables(spark, sf_dir)
    number = F.col("row_id").cast("string")
    answer = (
        F.when(F.col("priority") == "1-URGENT", number)
        .when(F.col("priority") == "2-HIGH", F.to_json(F.array(number)))
        .when(F.col("priority") == "3-MEDIUM", F.to_json(F.array(number, number)))
        .otherwise(F.col("status"))
    )
    question = F.struct(
        F.concat(F.lit("price of "), number).alias("question"), answer.alias("answer"),
        F.when(F.col("status") == "P", "text").otherwise("table").alias("answer_from"),
    )
    line = F.array("status", "priority", number)
    documents = rel.groupBy("table_id").agg(
        F.to_json(
            F.struct(
                F.struct(
                    F.concat(F.array(F.array(F.lit("status"), F.lit("priority"), F.lit("order"))), F.collect_list(line)).alias("table")
                ).alias("table"),
                F.collect_list(question).alias("questions"),
            )
        ).alias("document")
    )
    return files.nested_questions(documents, "table_id", F.col("document")).select(
        "table_id", "question", "label", F.array_join("header", "|").alias("header"),
        F.size("body").cast("long").alias("body_rows"),
    )


DISPLAY = ["status", "priority", "price"]


def block_html(spark, sf_dir):
    """Each table of orders as HTML with two decimals."""
    rel = order_tables(spark, sf_dir)
    columns = {
        "order status": F.col("status"), "order priority": F.col("priority"),
        "price (USD)": F.format_string("%.2f", "price"),
    }
    return html.render_rows(rel, "table_id", "row_id", columns, per_page=20).select("table_id", "html")


SQL_BLOCK_HTML = f"""{SQL_ORDER_TABLES}, blocks AS (SELECT table_id,
  '<table><thead><tr><th>order status</th><th>order priority</th><th>price (USD)</th></tr></thead><tbody>' ||
  string_agg('<tr><td>' || status || '</td><td>' || priority || '</td><td>' || format('{{:.2f}}', price) || '</td></tr>', '' ORDER BY row_id)
  || '</tbody></table>' AS html FROM rel GROUP BY table_id)"""


@query("render_html", f"WITH {SQL_BLOCK_HTML} SELECT table_id, html FROM blocks")
def render_html(spark, sf_dir):
    return block_html(spark, sf_dir)


def sample_texts(spark, sf_dir):
    """Three tables per sample, as one text."""
    tables = block_html(spark, sf_dir).select(
        F.expr("table_id div 3").alias("sample_id"), F.expr("table_id % 3").alias("place"), "html"
    )
    return html.multitable_text(tables, "sample_id", "place", "html")


SQL_TEXTS = f"""{SQL_BLOCK_HTML}, texts AS (SELECT sample_id, string_agg('Table ' || rn || chr(10) || chr(10) || html, chr(10) || chr(10) ORDER BY rn) AS text
  FROM (SELECT table_id // 3 AS sample_id, row_number() OVER (PARTITION BY table_id // 3 ORDER BY table_id) - 1 AS rn, html FROM blocks)
  GROUP BY sample_id)"""


@query("render_multitable_doc", f"WITH {SQL_TEXTS} SELECT sample_id, text FROM texts")
def render_multitable_doc(spark, sf_dir):
    return sample_texts(spark, sf_dir)


@query("array_tables_source", f"""
WITH {SQL_TEXTS} SELECT sample_id, 'orders_three' AS method, text, '[]' AS queries, '[]' AS constraints FROM texts
""")
def array_tables_source(spark, sf_dir):
    """Samples that carry their tables as an array; queries and constraints are empty lists."""
    tables = block_html(spark, sf_dir)
    samples = tables.groupBy(F.expr("table_id div 3").alias("sample_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("table_id", "html"))), lambda s: s["html"]).alias("tables_html")
    )
    parts = F.transform("tables_html", lambda t, i: F.concat(F.lit("Table "), i.cast("string"), F.lit("\n\n"), t))
    return samples.select(
        "sample_id", F.concat_ws("_", F.lit("orders"), F.lit("three")).alias("method"), F.array_join(parts, "\n\n").alias("text"),
        *[F.to_json(F.array().cast("array<string>")).alias(name) for name in ("queries", "constraints")],
    )


@query("html_tables_from_text", f"""
WITH {SQL_TEXTS}, t AS (SELECT sample_id, text, unnest(regexp_extract_all(text, '(?is)<table\\b.*?</table>')) AS table_html FROM texts),
n AS (SELECT sample_id, table_html, strpos(text, table_html) - 1 AS start FROM t)
SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY start) - 1 AS INTEGER) AS table_no, start,
  start + length(table_html) AS "end", md5(table_html) AS digest FROM n
UNION ALL SELECT -1 - page_id, 0, 0, 0, '' FROM pages WHERE regexp_matches(html, '(?is)<table\\b.*?</table>')
""")
def html_tables_from_text(spark, sf_dir):
    texts = sample_texts(spark, sf_dir)
    pages = load(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("sample_id"), F.col("html").alias("text"))
    found = html.tables_in_text(texts.unionByName(pages), ["sample_id"], "text")
    return found.select("sample_id", "table_no", "start", "end", F.md5("table_html").alias("digest"))


@query("replace_tables_in_text", f"""
WITH {SQL_TEXTS} SELECT sample_id, md5(replace(text, '<thead>', '<thead class="x">')) AS digest FROM texts
""")
def replace_tables_in_text(spark, sf_dir):
    rewritten = F.transform(html.table_texts(F.col("text")), lambda t: F.replace(t, F.lit("<thead>"), F.lit('<thead class="x">')))
    return sample_texts(spark, sf_dir).select("sample_id", F.md5(html.replace_tables(F.col("text"), rewritten)).alias("digest"))


def pivot_html(spark, sf_dir):
    """Supplier pivots as HTML with two header rows and two header columns."""
    lines = supplier_lines(spark, sf_dir).withColumn("measure", F.lit("price & line"))
    cells = pivot.pivot_cells(lines, ["table_id"], ["flag", "line_status"], ["measure", "line"], "price", "first", "row_key")
    return html.render_pivot(cells.withColumn("value", F.format_string("%.2f", "value")), "table_id", 2, 2)


SQL_GRID = f"""{SQL_SUPPLIER_LINES}, v AS (SELECT table_id, flag, line_status, CAST(line AS VARCHAR) AS line, format('{{:.2f}}', min_by(price, row_key)) AS value
  FROM lines GROUP BY ALL),
r AS (SELECT table_id, flag, line_status, row_number() OVER (PARTITION BY table_id ORDER BY flag, line_status) + 1 AS "row" FROM (SELECT DISTINCT table_id, flag, line_status FROM v)),
c AS (SELECT table_id, line, row_number() OVER (PARTITION BY table_id ORDER BY line) + 1 AS col FROM (SELECT DISTINCT table_id, line FROM v)),
body AS (SELECT r.table_id, r."row", c.col, r.flag, r.line_status, c.line, coalesce(v.value, '') AS value FROM r JOIN c ON r.table_id = c.table_id
  LEFT JOIN v ON v.table_id = r.table_id AND v.flag = r.flag AND v.line_status = r.line_status AND v.line = c.line)"""


def pivot_cells(spark, sf_dir):
    return html.html_cells(pivot_html(spark, sf_dir), ["table_id"], "html")


@query("html_cells", f"""
WITH {SQL_GRID}
SELECT table_id, "row", col, false AS is_header, value AS text FROM body
UNION ALL SELECT table_id, "row", 0, true, flag FROM r UNION ALL SELECT table_id, "row", 1, true, line_status FROM r
UNION ALL SELECT table_id, 0, col, true, 'price & line' FROM c UNION ALL SELECT table_id, 1, col, true, line FROM c
UNION ALL SELECT DISTINCT table_id, a.i, b.j, true, '' FROM r, (VALUES (0),(1)) a(i), (VALUES (0),(1)) b(j)
""")
def html_cells(spark, sf_dir):
    """Rendered tables parsed back to grid cells, spans expanded."""
    return pivot_cells(spark, sf_dir).select("table_id", "row", "col", "is_header", "text")


@query("html_header_depth", f"""
WITH {SQL_GRID} SELECT table_id, 2 AS header_rows, 2 AS header_cols FROM r GROUP BY table_id
""")
def html_header_depth(spark, sf_dir):
    return pivot_cells(spark, sf_dir).select("table_id", "header_rows", "header_cols").distinct()


@query("html_paths", f"""
WITH {SQL_GRID} SELECT table_id, "row", col, flag || '; ' || line_status AS row_path, 'price & line; ' || line AS col_path, value AS text FROM body
""")
def html_paths(spark, sf_dir):
    cells = materialise(pivot_cells(spark, sf_dir), "cells")
    return html.body_with_paths(cells, ["table_id"]).select(
        "table_id", "row", "col", F.array_join("row_path", "; ").alias("row_path"),
        F.array_join("col_path", "; ").alias("col_path"), "text",
    )

"""End-to-end datasets and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.numbers import sql_plain
from tabloom.functions.sampling import sql_digest, sql_pick, sql_pick_int, sql_uniform
from tabloom.operators import datasets, discovered, joins, labels, pivot, scoring, units
from tabloom.operators.cells import joined
from tabloom.operators.keys import unique_combinations
from tabloom.operators.units import NULL_TOKENS
from tabloom.plans import catalogue, registry
from tabloom.plans.labels import TUPLE, sql_cells
from tabloom.plans.pivots import SQL_TIERS, sql_density, sql_side, two_tier
from tabloom.plans.perturb import sql_layout_path
from tabloom.plans.registry import query
from tabloom.plans.scalars import SQL_SCORED, model_outputs, sql_normalize
from tabloom.plans.units import SQL_MEASURED, SQL_TARGETS, sql_conversion
from tabloom.session import materialise, scratch_path
from tabloom.sources import files
from tabloom.sources.tables import SQL_LINE_KEY, SQL_ORDER_TABLES, line_key, load, order_tables


@query("dataset_single")
def dataset_single(spark, sf_dir):
    """Every order table with every method and perturbation."""
    made = datasets.single_table(order_tables(spark, sf_dir), "table_id", TUPLE, "price", "USD", 42)
    return made.select("table_id", "method", "perturbation", "label", "question", "sql_query", F.md5("html").alias("table_digest"))


@query("dataset_single_labels", " UNION ALL ".join(
    f"SELECT table_id, '{m}' AS method, label FROM ({registry.SQL['label_' + m]})" for m in datasets.METHODS))
def dataset_single_labels(spark, sf_dir):
    """The gold answers of all methods from one pass."""
    chosen = datasets.chosen_cells(order_tables(spark, sf_dir), "table_id", TUPLE, "price", 42)
    return datasets.sample_labels(chosen, "table_id", "price", 42).select("table_id", "method", "label")


CELL_VARIANTS = ["none", "null_inject", "value_contradiction", "entity_missing"]


def _sql_single_lines(path: str) -> str:
    return f"""l_{path} AS (SELECT table_id, {path}, {sql_digest(42, path, "table_id", path)} AS h, count(*) OVER (PARTITION BY table_id) AS n
  FROM (SELECT DISTINCT table_id, {path} FROM base)),
m_{path} AS (SELECT DISTINCT table_id, method, {path} FROM need),
k_{path} AS (SELECT l.table_id, s.method, l.{path}, l.n, m.{path} IS NOT NULL AS must, h FROM l_{path} l JOIN samples s ON s.table_id = l.table_id
  LEFT JOIN m_{path} m ON m.table_id = l.table_id AND m.method = s.method AND m.{path} = l.{path}),
s_{path} AS (SELECT table_id, method, {path} FROM k_{path}
  QUALIFY row_number() OVER (PARTITION BY table_id, method ORDER BY must DESC, h, {path}) <= 10
    AND max(n) OVER (PARTITION BY table_id, method) >= 2
    AND (count(*) FILTER (WHERE must) OVER (PARTITION BY table_id, method) <= 10 OR max(n) OVER (PARTITION BY table_id, method) < 10))"""


@query("dataset_single_cells", f"""
WITH {SQL_ORDER_TABLES}, labs AS ({registry.SQL["dataset_single_labels"]}),
lay AS ({" UNION ALL ".join(sql_density("rel", ["table_id"], r, c) for r, c in pivot.splits_of(TUPLE))}),
best AS (SELECT table_id, r || ' | ' || c AS layout FROM lay WHERE pivot_rows > 1 AND pivot_columns > 1
  QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY (filled = pivot_rows * pivot_columns) DESC,
    filled / CAST(pivot_rows * pivot_columns AS DOUBLE) DESC, {sql_digest(42, "split", "table_id", "r || ' | ' || c")}) = 1),
base AS MATERIALIZED (SELECT rel.table_id, {sql_layout_path(1)} AS row_path, {sql_layout_path(2)} AS col_path, min(row_id) AS row_id, min_by(price, row_id) AS price
  FROM rel JOIN best ON best.table_id = rel.table_id GROUP BY ALL),
uniq AS (SELECT table_id, status, priority, year, max(price) AS price, max(row_id) AS row_id FROM rel GROUP BY ALL HAVING count(*) = 1),
drawn AS (SELECT table_id, method, row_id, row_number() OVER (PARTITION BY table_id, method ORDER BY md5(concat_ws('|', '42', method, table_id, status, priority, year)), status, priority, year) AS rn,
    CASE method WHEN 'extractive' THEN 1 WHEN 'comparative' THEN 2 WHEN 'percentage_change' THEN 2
      WHEN 'superlative' THEN {sql_pick_int(42, "superlative-size", 3, 4, "table_id")} WHEN 'sum' THEN {sql_pick_int(42, "sum-size", 2, 4, "table_id")}
      ELSE {sql_pick_int(42, "average-size", 2, 4, "table_id")} END AS wanted
  FROM uniq, (SELECT unnest({datasets.METHODS!r}) AS method)),
need AS MATERIALIZED (SELECT d.table_id, d.method, d.row_id, row_path, col_path FROM drawn d SEMI JOIN labs USING (table_id, method)
  JOIN base ON base.table_id = d.table_id AND base.row_id = d.row_id WHERE rn <= wanted),
samples AS (SELECT DISTINCT table_id, method FROM need),
{_sql_single_lines("row_path")}, {_sql_single_lines("col_path")},
cells AS MATERIALIZED (SELECT b.*, r.method, EXISTS (SELECT 1 FROM need n WHERE n.table_id = b.table_id AND n.method = r.method AND n.row_id = b.row_id) AS needed
  FROM base b JOIN s_row_path r ON r.table_id = b.table_id AND r.row_path = b.row_path
  JOIN s_col_path c ON c.table_id = b.table_id AND c.col_path = b.col_path AND c.method = r.method),
v AS (SELECT *, table_id || '|' || method || '|' || perturbation AS variant FROM cells, (SELECT unnest({CELL_VARIANTS!r}) AS perturbation)),
lost AS (SELECT variant, row_id FROM v WHERE needed AND perturbation = 'entity_missing'
  QUALIFY row_number() OVER (PARTITION BY variant ORDER BY {sql_digest(42, "missing", "variant", "row_id")}) = 1),
txt AS (SELECT *, CASE perturbation WHEN 'value_contradiction' THEN
      {sql_plain("price", 2)} || ' (' || {sql_plain(f"price + {sql_pick_int(42, 'contradiction', 1, 10, 'variant', 'row_id')}", 2)} || ')'
    WHEN 'null_inject' THEN CASE WHEN NOT needed AND {sql_uniform(42, "null", "variant", "row_id")} < 0.5
      THEN {sql_pick(42, "null-token", NULL_TOKENS, "variant")} ELSE {sql_plain("price", 2)} END
    ELSE {sql_plain("price", 2)} END AS shown
  FROM v ANTI JOIN lost USING (variant, row_id))
SELECT txt.table_id, txt.method, perturbation, label, count(*) AS cells, count(*) FILTER (WHERE needed) AS needed_cells,
  md5(string_agg(concat_ws('#', row_path, col_path, shown), chr(10) ORDER BY row_path, col_path)) AS cells_digest
FROM txt JOIN labs ON labs.table_id = txt.table_id AND labs.method = txt.method GROUP BY ALL
""")
def dataset_single_cells(spark, sf_dir):
    """Labels and cell digests of the clean samples and of three perturbations of the relational form."""
    rel = order_tables(spark, sf_dir)
    chosen = materialise(datasets.chosen_cells(rel, "table_id", TUPLE, "price", 42), "chosen")
    answers = materialise(datasets.sample_labels(chosen, "table_id", "price", 42), "labels")
    cells = datasets.variant_cells(rel, chosen, answers, "table_id", TUPLE, "price", 42, CELL_VARIANTS)
    line = lambda x: F.struct(x["r"].alias("r"), x["c"].alias("c"), F.concat_ws("#", x["r"], x["c"], x["value"]).alias("line"))
    named = F.transform("cells", lambda x: x.withField("r", joined(x["r"])).withField("c", joined(x["c"])))
    cells = cells.withColumn("cells", F.explode(F.array(named)))
    listed = F.transform(F.array_sort(F.transform("cells", line)), lambda x: x["line"])
    return cells.select(
        "table_id", "method", "perturbation", "label", F.size("cells").cast("long").alias("cells"),
        F.size(F.filter("cells", lambda x: x["needed"])).cast("long").alias("needed_cells"), F.md5(F.array_join(listed, "\n")).alias("cells_digest"),
    )


@query("dataset_parallel")
def dataset_parallel(spark, sf_dir):
    made = datasets.parallel(order_tables(spark, sf_dir), units.dimension(spark), "table_id", TUPLE, "price", "USD", 42)
    return made.select("bundle_id", "num_tables", "method", "op", "perturbation", "label", F.md5("text").alias("text_digest"))


@query("dataset_parallel_labels", f"""
WITH {sql_cells("parallel", 1)}, lab AS (SELECT table_id // 20 AS sample_id, table_id % 20 AS place, CAST({sql_plain("price")} AS DOUBLE) AS x FROM cells WHERE rn = 1),
b AS (SELECT sample_id || '-' || size AS bundle_id, size, x FROM lab JOIN (VALUES (2),(3),(5),(10),(20)) v(size) ON place < size),
g AS (SELECT bundle_id, {sql_pick(42, 'multi-extreme', labels.EXTREMES, 'bundle_id')} AS ext, max(x) AS hi, min(x) AS lo, CAST(sum(CAST(x AS DECIMAL(18,6))) AS DOUBLE) AS total, count(*) AS n FROM b GROUP BY bundle_id, size HAVING count(*) = size)
SELECT bundle_id, 'superlative' AS method, ext AS op, CASE WHEN ext = 'MAX' THEN {sql_plain("hi")} ELSE {sql_plain("lo")} END AS label FROM g
UNION ALL SELECT bundle_id, 'sum', NULL, {sql_plain("total")} FROM g UNION ALL SELECT bundle_id, 'average', NULL, {sql_plain("total / n")} FROM g
""")
def dataset_parallel_labels(spark, sf_dir):
    cells = labels.sampled_cells(order_tables(spark, sf_dir), "table_id", TUPLE, "price", 1, "parallel")
    return datasets.parallel_answers(datasets.parallel_labels(cells, "table_id", "price"))


#: Row keys of the relations that samples are made of, in SQL; those of line items are made by ``line_key``.
KEYS = {
    "lineitem": SQL_LINE_KEY, "orders": "o_orderkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
    "events": "event_id", catalogue.VIEW: "o_orderkey",
}


def _sql_store() -> str:
    parts = []
    for table, key in KEYS.items():
        columns = [c.split(":") for c in catalogue.SCHEMA[table].split()]
        names = ", ".join(f"'{c}'" for c, _ in columns)
        texts = ", ".join(f"CAST({c} AS VARCHAR)" for c, _ in columns)
        numbers = ", ".join(f"CAST({c} AS DECIMAL(28,6))" if k == "n" else "NULL" for c, k in columns)
        parts.append(f"SELECT '{table}' AS relation, CAST({key} AS VARCHAR) AS row, [{names}] AS names, [{texts}] AS vals, [{numbers}] AS nums FROM {table}")
    return " UNION ALL ".join(parts)


SQL_DISCOVERED = f"""
WITH {SQL_TIERS},
entries AS (SELECT DISTINCT relation, row_attributes, column_attributes, value_attribute,
    concat_ws('|', relation, row_attributes, column_attributes, value_attribute) AS entry,
    string_split(row_attributes, '; ') AS ra, string_split(column_attributes, '; ') AS ca FROM tiers),
store AS ({_sql_store()}),
tuples AS (SELECT entry, len(ra) + len(ca) AS attrs, row, list_transform(ra, lambda a: vals[list_position(names, a)]) AS r,
    list_transform(ca, lambda a: vals[list_position(names, a)]) AS c, nums[list_position(names, value_attribute)] AS value
  FROM store JOIN entries USING (relation)),
cells AS MATERIALIZED (SELECT entry, attrs, array_to_string(r, '|') AS row_path, array_to_string(c, '|') AS col_path, min(row) AS row, min_by(value, row) AS value
  FROM tuples WHERE value IS NOT NULL AND len(list_filter(r, lambda x: x IS NULL)) = 0 AND len(list_filter(c, lambda x: x IS NULL)) = 0 GROUP BY ALL),
spread AS (SELECT *, unnest(['average', 'sum', 'superlative']) AS method FROM cells),
asked AS MATERIALIZED (SELECT *, CASE method WHEN 'superlative' THEN {sql_pick_int(42, "superlative-size", 3, 4, "entry")}
    WHEN 'sum' THEN {sql_pick_int(42, "sum-size", 2, 4, "entry")} ELSE {sql_pick_int(42, "average-size", 2, 4, "entry")} END AS wanted
  FROM (SELECT *, row_number() OVER (PARTITION BY entry, method ORDER BY {sql_digest(42, "discovered", "entry", "method", "row_path", "col_path")}, row) AS rn FROM spread)
  WHERE rn <= wanted),
money AS (SELECT entry, method, wanted, count(*) AS n, CAST(max(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS hi, CAST(min(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS lo,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM asked GROUP BY ALL),
labels AS (SELECT entry, method, CASE method WHEN 'sum' THEN {sql_plain("total")} WHEN 'average' THEN {sql_plain("total / n")}
    ELSE CASE WHEN {sql_pick(42, "extreme", labels.EXTREMES, "entry")} = 'MAX' THEN {sql_plain("hi")} ELSE {sql_plain("lo")} END END AS label FROM money WHERE n = wanted),
marked AS MATERIALIZED (SELECT s.*, entry || '|' || method AS table_id, EXISTS (SELECT 1 FROM asked a WHERE a.entry = s.entry AND a.method = s.method
    AND a.row_path = s.row_path AND a.col_path = s.col_path) AS needed FROM spread s SEMI JOIN labels USING (entry, method)),
rel_rows AS (SELECT entry, method, count(*) AS relational_rows, md5(string_agg(concat_ws('#', row_path, col_path, CAST(value AS VARCHAR)), chr(10) ORDER BY row, row_path, col_path)) AS relational_digest
  FROM (SELECT *, row_number() OVER (PARTITION BY entry, method ORDER BY needed DESC, row, row_path, col_path) AS rn FROM marked)
  WHERE rn <= 100 AND (needed OR rn <= greatest(100 // (attrs + 1), 1)) GROUP BY ALL),
{sql_side("row_path", "marked", "marked")}, {sql_side("col_path", "marked", "after_row_path")},
piv AS (SELECT entry, method, count(DISTINCT row_path) AS pivot_rows, count(DISTINCT col_path) AS pivot_columns,
    md5(string_agg(concat_ws('#', row_path, col_path, CAST(value AS VARCHAR)), chr(10) ORDER BY row_path, col_path)) AS pivot_digest FROM after_col_path GROUP BY ALL)
SELECT entry, method, label, relational_rows, relational_digest, pivot_rows, pivot_columns, pivot_digest
FROM labels JOIN rel_rows USING (entry, method) LEFT JOIN piv USING (entry, method)
"""


@query("dataset_discovered", SQL_DISCOVERED)
def dataset_discovered(spark, sf_dir):
    """Samples over discovered dense pivots of all relations: labels, and digests of both forms of their tables."""
    relations = catalogue.relations(spark, sf_dir)
    found = catalogue.searched(spark, sf_dir)
    entries = materialise(two_tier(found.pivots), "entries")
    store = discovered.cell_store(relations, found.shapes, {r: line_key() if r == "lineitem" else F.col(key) for r, key in KEYS.items()})
    made = discovered.discovered(store, entries, 42)
    line = F.concat_ws("#", F.array_join("row_path", "|"), F.array_join("col_path", "|"), F.col("value").cast("string"))

    def listed(*order: str):
        """Digest of the lines of a table, which has at most a hundred."""
        keys = [F.array_join(c, "|") if c.endswith("path") else F.col(c) for c in order]
        lines = F.array_sort(F.collect_list(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], line.alias("line"))))
        return F.md5(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"))

    rows = made.rows.groupBy("entry", "method").agg(F.count(F.lit(1)).alias("relational_rows"), listed("row", "row_path", "col_path").alias("relational_digest"))
    cells = made.cells.groupBy("entry", "method").agg(
        F.count_distinct("row_path").alias("pivot_rows"), F.count_distinct("col_path").alias("pivot_columns"), listed("row_path", "col_path").alias("pivot_digest")
    )
    return made.labels.select("entry", "method", "label").join(rows, ["entry", "method"]).join(cells, ["entry", "method"], "left")


def _sql_parallel(tries: int = 5) -> str:
    return f"""{SQL_MEASURED}, {SQL_TARGETS}, {sql_cells("parallel", 1)},
tab AS (SELECT table_id, 'finance' AS domain, 'USD' AS from_unit, {sql_plain("price", 2)} AS shown FROM rel),
{sql_conversion("tab", 42, tries)},
placed AS (SELECT table_id, table_id // 20 AS sample_id, table_id % 20 AS place, size FROM cells JOIN (VALUES (2),(3),(5),(10),(20)) v(size) ON table_id % 20 < size WHERE rn = 1),
g AS (SELECT sample_id, size, sample_id || '-' || size AS bundle_id FROM placed GROUP BY ALL HAVING count(*) = size),
refused AS (SELECT bundle_id, 'unit_converted' AS perturbation, 'no target converts the table' AS reason, count(*) AS tables
  FROM placed JOIN g USING (sample_id, size) WHERE place > 0 AND table_id NOT IN (SELECT table_id FROM ok) GROUP BY ALL),
variants AS (SELECT sample_id, size, bundle_id, unnest(['unit_converted', 'not_unit_converted']) AS perturbation FROM g),
made AS (SELECT * FROM variants v WHERE NOT EXISTS (SELECT 1 FROM refused r WHERE r.bundle_id = v.bundle_id AND r.perturbation = v.perturbation))"""


@query("dataset_parallel_refused", f"WITH {_sql_parallel(1)} SELECT * FROM refused")
def dataset_parallel_refused(spark, sf_dir):
    """Bundles that go without a unit-converted variant if a table only gets one try, with the number of tables at fault."""
    return datasets.parallel_refused(order_tables(spark, sf_dir), units.dimension(spark), "table_id", TUPLE, "price", "USD", 42, 1)


@query("dataset_parallel_samples", f"""
WITH {_sql_parallel()}, labelled AS ({registry.SQL["dataset_parallel_labels"]})
SELECT bundle_id, CAST(size AS INTEGER) AS num_tables, method, op, perturbation, label FROM made JOIN labelled USING (bundle_id)
""")
def dataset_parallel_samples(spark, sf_dir):
    """Keys, labels and variants of the parallel samples that have a text."""
    made = datasets.parallel(order_tables(spark, sf_dir), units.dimension(spark), "table_id", TUPLE, "price", "USD", 42)
    return made.select("bundle_id", "num_tables", "method", "op", "perturbation", "label")


@query("dataset_collect", f"""
WITH {_sql_parallel()} SELECT CAST(size AS INTEGER) AS num_tables, method, perturbation, count(*) AS samples
FROM made, (VALUES ('superlative'),('sum'),('average')) m(method) GROUP BY ALL
""")
def dataset_collect(spark, sf_dir):
    """Parallel samples written to their folders and counted per folder."""
    made = datasets.parallel(order_tables(spark, sf_dir), units.dimension(spark), "table_id", TUPLE, "price", "USD", 42)
    path = scratch_path(spark, "collected")
    files.write_dataset(made.withColumn("domain", F.lit("finance")), path)
    return files.read_dataset(spark, path, domain="finance").groupBy("num_tables", "method", "perturbation").agg(
        F.count(F.lit(1)).alias("samples")
    )


@query("error_log_summary", """
WITH u AS (SELECT o_custkey AS table_id, max(n) FILTER (WHERE n = 1) AS has_unique FROM (
    SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey),
b AS (SELECT table_id // 20 AS sample_id, size, has_unique FROM u JOIN (VALUES (2),(3),(5),(10),(20)) v(size) ON table_id % 20 < size),
r AS (SELECT sample_id, size, CASE WHEN count(*) < size THEN 'missing table' WHEN count(has_unique) < size THEN 'no unique tuple' END AS reason FROM b GROUP BY sample_id, size)
SELECT CAST(size AS INTEGER) AS num_tables, reason, count(*) AS failures FROM r WHERE reason IS NOT NULL GROUP BY ALL
""")
def error_log_summary(spark, sf_dir):
    """Bundles that give no sample, by size and reason."""
    rel = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id"), F.col("o_orderstatus").alias("status"))
    unique = unique_combinations(rel, ["table_id", "status"]).select("table_id").distinct().withColumn("has_unique", F.lit(1))
    tables = rel.select("table_id").distinct().join(unique, "table_id", "left").select(
        F.expr("table_id div 20").alias("sample_id"), F.expr("table_id % 20").alias("place"), "has_unique"
    )
    checked = joins.bundles(tables, "place").groupBy("sample_id", "bundle").agg(
        F.count(F.lit(1)).alias("n"), F.count("has_unique").alias("good")
    )
    reason = F.when(F.col("n") < F.col("bundle"), "missing table").when(F.col("good") < F.col("bundle"), "no unique tuple")
    return (
        checked.select(F.col("bundle").alias("num_tables"), reason.alias("reason"))
        .filter("reason IS NOT NULL")
        .groupBy("num_tables", "reason")
        .agg(F.count(F.lit(1)).alias("failures"))
    )


@query("evaluate_predictions", f"""
WITH {SQL_SCORED}, tok AS (SELECT sample_id, 'p' AS side, unnest(string_split({sql_normalize("prediction")}, ' ')) AS token FROM scored
  UNION ALL SELECT sample_id, 'g', unnest(string_split({sql_normalize("label")}, ' ')) FROM scored),
cnt AS (SELECT sample_id, token, count(*) FILTER (WHERE side = 'p') AS p, count(*) FILTER (WHERE side = 'g') AS g FROM tok WHERE token <> '' GROUP BY ALL),
tot AS (SELECT s.sample_id, any_value(dataset) AS dataset, any_value(match) AS match, coalesce(sum(p), 0)::DOUBLE AS p, coalesce(sum(g), 0)::DOUBLE AS g,
  coalesce(sum(least(p, g)), 0)::DOUBLE AS same FROM scored s LEFT JOIN cnt ON cnt.sample_id = s.sample_id GROUP BY s.sample_id),
f AS (SELECT dataset, match, CASE WHEN p = 0 AND g = 0 THEN 1.0::DOUBLE WHEN p = 0 OR g = 0 OR same = 0 THEN 0.0::DOUBLE
  ELSE 2.0::DOUBLE * (same / p) * (same / g) / (same / p + same / g) END AS f1 FROM tot)
SELECT dataset, count(*) AS samples, CAST(count(*) FILTER (WHERE match) AS DOUBLE) / count(*) AS accuracy,
  CAST(sum(CAST(f1 AS DECIMAL(18,9))) AS DOUBLE) / count(*) AS mean_f1 FROM f GROUP BY dataset
""")
def evaluate_predictions(spark, sf_dir):
    """Model outputs to accuracy and mean token F1 per dataset."""
    return scoring.evaluated(model_outputs(spark, sf_dir), ["sample_id"], ["dataset"])

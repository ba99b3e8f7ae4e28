"""Reasoning texts and question templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.sampling import pick, pick_int, sql_digest, sql_pick, sql_pick_int
from tabloom.operators import labels, prep, questions
from tabloom.operators.views import PLACEHOLDER
from tabloom.plans.labels import TUPLE, sql_cells
from tabloom.plans.registry import query
from tabloom.plans.scalars import SQL_TOKENS, turn_pairs
from tabloom.session import scratch_path
from tabloom.sources import files
from tabloom.sources.tables import load, order_tables

MARK = prep.STEP_MARKER


def reasoning_texts(spark, sf_dir):
    """User turn, step marker, assistant turn and an answer; some lack a marker, some repeat it."""
    kind = pick_int(90, "reasoning", 0, 5, "pair")
    body = F.concat("label", F.lit(" " + MARK + " "), "prediction")
    text = (
        F.when(kind == 0, F.concat("label", F.lit(prep.THINK_END), "prediction"))
        .when(kind == 1, body)
        .when(kind == 2, F.concat(body, F.lit(MARK), F.lit(prep.THINK_END), F.lit("\nFinal answer: yes")))
        .otherwise(F.concat(body, F.lit(prep.THINK_END), F.lit("\nFinal answer: 12")))
    )
    return turn_pairs(spark, sf_dir).select("pair", text.alias("reasoning"))


SQL_PAIRS = SQL_TOKENS.split("\ntok AS")[0].rstrip(", ")
SQL_MARK = MARK.replace("'", "''")
SQL_REASONING = f"""{SQL_PAIRS}, rs AS (SELECT pair, CASE {sql_pick_int(90, "reasoning", 0, 5, "pair")}
   WHEN 0 THEN label || '</think>' || prediction
   WHEN 1 THEN label || ' {SQL_MARK} ' || prediction
   WHEN 2 THEN label || ' {SQL_MARK} ' || prediction || '{SQL_MARK}</think>' || chr(10) || 'Final answer: yes'
   ELSE label || ' {SQL_MARK} ' || prediction || '</think>' || chr(10) || 'Final answer: 12' END AS reasoning FROM pairs),
cut AS (SELECT pair, strpos(reasoning, '{SQL_MARK}') AS a, reasoning FROM rs),
gen AS (SELECT pair, substr(reasoning, 1, a - 1) || '{SQL_MARK}' AS prompt, substr(reasoning, a + {len(MARK)}) AS g FROM cut WHERE a > 0),
split_ AS (SELECT pair, prompt, '<think>' || chr(10) || substr(g, 1, strpos(g, '</think>') - 1) || '</think>' || substr(g, strpos(g, '</think>') + 8) AS completion
  FROM gen WHERE contains(g, '</think>'))"""


@query("cot_split", f"WITH {SQL_REASONING} SELECT pair, prompt, completion FROM split_")
def cot_split(spark, sf_dir):
    return prep.cot_split(reasoning_texts(spark, sf_dir), "reasoning")


SQL_TOKEN = prep.TOKEN


@query("length_filter", f"""
WITH {SQL_REASONING} SELECT pair, len(regexp_extract_all(prompt, '{SQL_TOKEN}')) AS prompt_tokens FROM split_
WHERE len(regexp_extract_all(prompt, '{SQL_TOKEN}')) < 60 AND len(regexp_extract_all(completion, '{SQL_TOKEN}')) > 0
""")
def length_filter(spark, sf_dir):
    kept = prep.length_filter(prep.cot_split(reasoning_texts(spark, sf_dir), "reasoning"), limit=60)
    return kept.select("pair", prep.token_estimate(F.col("prompt")).cast("long").alias("prompt_tokens"))


SIZES = [2, 3, 5, 10, 20]
GRID_METHODS = ["average", "sum", "superlative", "extractive"]
VARIANTS = ["unit_converted", "not_unit_converted", "relational"]


@query("source_grid_union", f"""
WITH d AS (SELECT item.conv_id, item.turn, item.role, {sql_pick(91, "size", SIZES, "conv_id", "turn")} AS num_tables,
  {sql_pick(91, "method", GRID_METHODS, "conv_id", "turn")} AS method, {sql_pick(91, "variant", VARIANTS, "conv_id", "turn")} AS perturbation FROM conversations item)
SELECT conv_id, turn, role, CAST(num_tables AS INTEGER) AS num_tables, 'environmental' AS domain, method, perturbation FROM d
WHERE method IN ('average','sum','superlative') AND perturbation IN ('unit_converted','not_unit_converted')
""")
def source_grid_union(spark, sf_dir):
    """A grid of stored settings read as one set; other folders are not opened."""
    data = load(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", pick(91, "size", SIZES, "conv_id", "turn").alias("num_tables"),
        F.lit("environmental").alias("domain"), pick(91, "method", GRID_METHODS, "conv_id", "turn").alias("method"),
        pick(91, "variant", VARIANTS, "conv_id", "turn").alias("perturbation"),
    )
    path = scratch_path(spark, "grid")
    files.write_dataset(data, path)
    return spark.read.parquet(path).filter(
        F.col("num_tables").isin(SIZES)
        & F.col("method").isin(GRID_METHODS[:3])
        & F.col("perturbation").isin(VARIANTS[:2])
    )


def question_predicates(spark, sf_dir):
    """Two queries per table: a lookup, then an average over three cells that depends on it."""
    rel = order_tables(spark, sf_dir)
    first = labels.sampled_cells(rel, "table_id", TUPLE, "price", 1, "ask-first").withColumn("step", F.lit(1))
    last = labels.sampled_cells(rel, "table_id", TUPLE, "price", 3, "ask-last").withColumn("step", F.lit(2))
    parts = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.lit(name).alias("col"), F.col(c).alias("value"))
            for i, (c, name) in enumerate(zip(TUPLE, ["OrderStatus", "OrderPriority", "orderYear"]))
        ]
    )
    rows = first.unionByName(last).select("table_id", "step", F.col("rn").alias("branch"), F.explode(parts).alias("p"))
    depends = (F.col("step") == 2) & (F.col("p.col") == "OrderStatus") & (F.col("table_id") % 2 == 0)
    return rows.select(
        "table_id", "step", "branch", "p.pos", "p.col", F.lit("=").alias("op"),
        F.when(depends, PLACEHOLDER).otherwise(F.col("p.value")).alias("value"), (F.col("step") == 2).alias("is_last"),
    )


SQL_ASK = f"""{sql_cells("ask-first", 1).replace("cells AS", "firsts AS")}, lasts AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY {sql_digest(42, "ask-last", "table_id", "status", "priority", "year")},
    status, priority, year) AS rn FROM uniq) WHERE rn <= 3)"""


@query("templated_question", f"""
WITH {SQL_ASK}, con AS (SELECT table_id, '1) order status is "' || status || '"' || chr(10) || '2) order priority is "' || priority || '"' || chr(10)
  || '3) order year is "' || year || '"' AS con FROM firsts),
br AS (SELECT table_id, rn, CASE WHEN table_id % 2 = 0 THEN '' ELSE 'the order status is "' || status || '", ' END || 'the order priority is "' || priority
  || '" and the order year is "' || year || '"' AS b FROM lasts),
ac AS (SELECT table_id, string_agg('(' || rn || ') ' || b, '; ' ORDER BY rn) AS ac FROM br GROUP BY table_id)
SELECT table_id, 'Considering the following constraints:' || chr(10) || con || chr(10) || chr(10) || 'what is the average value of order price where ' || ac || '?' AS text
FROM con JOIN ac USING (table_id)
""")
def templated_question(spark, sf_dir):
    preds = question_predicates(spark, sf_dir)
    last = order_tables(spark, sf_dir).select("table_id").distinct().select(
        "table_id", F.lit("AVG").alias("aggregate"), F.lit("OrderPrice").alias("target")
    )
    asked = last.join(preds.select("table_id").distinct(), "table_id", "left_semi")
    return questions.templated(preds, "table_id", asked)

"""Questions chained over tables, from step rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.numbers import sql_plain
from tabloom.functions.sampling import sql_digest
from tabloom.operators import chains
from tabloom.plans.registry import query
from tabloom.session import materialise
from tabloom.sources.tables import SQL_LINE_KEY, TABLES, line_key, load

#: (chain, step, relation, key column, answer column, columns shown)
STEPS = [
    ("customers", 1, "nation", "n_regionkey", "n_nationkey", ["n_name", "n_nationkey"]),
    ("customers", 2, "customer", "c_nationkey", "c_custkey", ["c_name", "c_mktsegment"]),
    ("customers", 3, "orders", "o_custkey", "o_totalprice", ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]),
    ("suppliers", 1, "part", "p_brand", "p_partkey", ["p_name", "p_type", "p_size"]),
    ("suppliers", 2, "lineitem", "l_partkey", "l_suppkey", ["l_returnflag", "l_linestatus", "l_linenumber"]),
    ("suppliers", 3, "supplier", "s_suppkey", "s_nationkey", ["s_name", "s_nationkey"]),
    ("suppliers", 4, "customer", "c_nationkey", "c_acctbal", ["c_name", "c_mktsegment", "c_nationkey"]),
]
LONGEST = 4
#: Row keys in SQL; those of line items are made by ``line_key``.
ROW_KEYS = {
    "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey",
    "lineitem": SQL_LINE_KEY,
}
SEED = 31


def _walked(spark, sf_dir):
    keys = {r: line_key() if r == "lineitem" else F.col(key) for r, key in ROW_KEYS.items()}
    store = chains.row_store({r: load(spark, sf_dir, r) for r in ROW_KEYS}, keys)
    steps = spark.createDataFrame(STEPS, chains.STEPS)
    regions = load(spark, sf_dir, "region").select(F.lit("customers").alias("chain"), F.col("r_name").alias("question"), F.col("r_regionkey").cast("string").alias("key"))
    brands = load(spark, sf_dir, "part").select(F.lit("suppliers").alias("chain"), F.col("p_brand").alias("question"), F.col("p_brand").alias("key")).distinct()
    starts = materialise(regions.unionByName(brands), "chain-starts")
    return chains.walk(store, steps, starts, SEED, LONGEST), steps, starts


def _sql_walk() -> str:
    """Every chain written out as joins of its own tables."""
    text = lambda c: f"CAST({c} AS VARCHAR)"
    parts = [
        "customers_at1 AS (SELECT r_name AS question, CAST(r_regionkey AS VARCHAR) AS key FROM region)",
        "suppliers_at1 AS (SELECT DISTINCT p_brand AS question, p_brand AS key FROM part)",
    ]
    rows, picks, lasts = [], [], []
    for i, (chain, step, relation, key, answer, shown) in enumerate(STEPS):
        final = i + 1 == len(STEPS) or STEPS[i + 1][0] != chain
        listed = f"[{', '.join(text(c) for c in shown)}]"
        parts.append(
            f"{chain}_rows{step} AS MATERIALIZED (SELECT question, a.key, {text(ROW_KEYS[relation])} AS row, {text(answer)} AS answer, {listed} AS shown "
            f"FROM {chain}_at{step} a JOIN {relation} ON {text(key)} = a.key)"
        )
        rows.append(f"SELECT '{chain}' AS chain, question, {step} AS step, row, shown FROM {chain}_rows{step}")
        if final:
            lasts.append(f"SELECT '{chain}' AS chain, question, {step} AS step, row, answer AS value FROM {chain}_rows{step} WHERE answer IS NOT NULL")
            continue
        h = sql_digest(SEED, "chain", "chain", "step", "answer")
        parts.append(
            f"{chain}_pick{step} AS (SELECT question, row, answer FROM (SELECT *, '{chain}' AS chain, {step} AS step FROM {chain}_rows{step}) "
            f"WHERE answer IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question ORDER BY {h}, row) = 1)"
        )
        parts.append(f"{chain}_at{step + 1} AS (SELECT question, answer AS key FROM {chain}_pick{step})")
        picks.append(f"SELECT '{chain}' AS chain, question, {step} AS step, row, answer FROM {chain}_pick{step}")
    parts += [f"all_rows AS ({' UNION ALL '.join(rows)})", f"picks AS ({' UNION ALL '.join(picks)})", f"lasts AS ({' UNION ALL '.join(lasts)})"]
    parts.append("routes AS (SELECT chain, question, string_agg(answer, ' > ' ORDER BY step) AS path FROM picks GROUP BY ALL)")
    return ",\n".join(parts)


def sql_average(source: str) -> str:
    mean = "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value)"
    return f"SELECT chain, question, count(*) AS n, {sql_plain(mean)} AS label FROM {source} GROUP BY ALL"


@query("fk_chain_steps", f"""
WITH {_sql_walk()}, answers AS ({sql_average("lasts")})
SELECT chain, question, path, n AS rows_, label FROM answers JOIN routes USING (chain, question)
""")
def fk_chain_steps(spark, sf_dir):
    """Two chains over different tables: regions to their customers' orders, and brands to the customers near a supplier."""
    walked, _, _ = _walked(spark, sf_dir)
    answers = chains.averages(chains.asked_rows(walked, SEED))
    return answers.join(chains.paths(walked), ["chain", "question"]).select("chain", "question", "path", F.col("rows").alias("rows_"), "label")


@query("dataset_fk", f"""
WITH {_sql_walk()},
asked AS MATERIALIZED (SELECT * FROM lasts QUALIFY row_number() OVER (PARTITION BY chain, question ORDER BY {sql_digest(SEED, "asked", "chain", "row")}, row) <= 4),
answers AS ({sql_average("asked")}),
needed AS (SELECT DISTINCT chain, question, step, row FROM (SELECT chain, question, step, row FROM picks UNION ALL SELECT chain, question, step, row FROM asked)),
ranked AS (SELECT a.*, n.row IS NOT NULL AS needed, row_number() OVER (PARTITION BY a.chain, a.question, a.step ORDER BY n.row IS NOT NULL DESC, a.row) AS rn
  FROM all_rows a LEFT JOIN needed n ON n.chain = a.chain AND n.question = a.question AND n.step = a.step AND n.row = a.row),
shown_rows AS (SELECT * FROM ranked WHERE rn <= 100 AND (needed OR rn <= greatest(100 // len(shown), 1))),
digests AS (SELECT chain, question, count(DISTINCT step) AS tables_, count(*) AS table_rows,
    md5(string_agg(concat_ws('#', step, array_to_string(shown, '|')), chr(10) ORDER BY step, row)) AS tables_digest FROM shown_rows GROUP BY ALL)
SELECT chain, question, path, label, tables_, table_rows, tables_digest FROM answers JOIN routes USING (chain, question) JOIN digests USING (chain, question)
""")
def dataset_fk(spark, sf_dir):
    """Chained samples: every answer is the key of the next table, the last question averages up to four rows.

    Tables are cut to 100 cells around the needed rows; their digest covers every row shown.
    """
    walked, _, _ = _walked(spark, sf_dir)
    asked = materialise(chains.asked_rows(walked, SEED, 4), "asked")
    shown = chains.shown_rows(walked, asked)
    line = F.concat_ws("#", F.col("step").cast("string"), F.array_join("shown", "|"))
    lines = F.array_sort(F.collect_list(F.struct("step", "row", line.alias("line"))))
    digests = shown.groupBy("chain", "question").agg(
        F.count_distinct("step").alias("tables_"),
        F.count(F.lit(1)).alias("table_rows"),
        F.md5(F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("tables_digest"),
    )
    answers = chains.averages(asked).join(chains.paths(walked), ["chain", "question"])
    return answers.join(digests, ["chain", "question"]).select("chain", "question", "path", "label", "tables_", "table_rows", "tables_digest")


@query("dataset_fk_texts")
def dataset_fk_texts(spark, sf_dir):
    """The same samples as texts: the question, and all tables as HTML."""
    walked, steps, starts = _walked(spark, sf_dir)
    asked = materialise(chains.asked_rows(walked, SEED, 4), "asked")
    texts = chains.questions(walked, asked, steps, starts).withColumnRenamed("text", "question_text")
    tables = chains.documents(chains.shown_rows(walked, asked), steps)
    made = texts.join(tables, ["chain", "question"]).join(chains.averages(asked), ["chain", "question"])
    return made.select("chain", "question", "question_text", "label", F.md5("text").alias("text_digest"))


#: Columns that hold whole numbers, where keys are looked for.
KEY_COLUMNS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"],
    "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "events": ["event_id", "user_id"],
    "documents": ["doc_id", "n_chars"], "embeddings": ["vec_id", "label"], "pages": ["page_id"], "benchmark": ["item_id"],
    "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn"],
}


def _sql_inclusions() -> str:
    values = " UNION ALL ".join(
        f"SELECT '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} GROUP BY {c}" for t in TABLES for c in KEY_COLUMNS[t]
    )
    return f"""WITH vals AS MATERIALIZED ({values}),
parents AS (SELECT t, c FROM vals GROUP BY t, c HAVING max(n) = 1 AND bool_and(v IS NOT NULL)),
sizes AS (SELECT t, c, count(v) AS size FROM vals GROUP BY t, c),
met AS (SELECT a.t AS ct, a.c AS cc, b.t AS pt, b.c AS pc, count(*) AS n FROM vals a JOIN vals b ON a.v = b.v AND (a.t, a.c) <> (b.t, b.c) GROUP BY ALL)
SELECT ct AS child_relation, cc AS child_column, pt AS parent_relation, pc AS parent_column FROM met
JOIN sizes ON sizes.t = ct AND sizes.c = cc JOIN parents ON parents.t = pt AND parents.c = pc WHERE n = size"""


@query("fk_inclusions", _sql_inclusions())
def fk_inclusions(spark, sf_dir):
    """Possible foreign keys among all whole-number columns of all tables, by inclusion of their values."""
    return chains.inclusions({t: load(spark, sf_dir, t) for t in TABLES}, {t: KEY_COLUMNS[t] for t in TABLES})

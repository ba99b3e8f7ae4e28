"""Scalar expressions and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import numbers, text
from tabloom.functions.sampling import digest, pick, pick_int, sql_digest, sql_pick, sql_pick_int
from tabloom.operators import scoring
from tabloom.operators.ranking import ordered_positions
from tabloom.plans.registry import query
from tabloom.sources.tables import load, spread

METHODS = ["average", "sum", "percentage_change"]


def model_outputs(spark, sf_dir):
    """A model answer per order: the price (or yes/no for pending orders) in many spellings."""
    price = numbers.plain(F.col("o_totalprice"))
    truth = F.when(F.col("o_orderstatus") == "P", F.when(F.col("o_totalprice") > 250000, "yes").otherwise("no")).otherwise(price)
    orders = spread(load(spark, sf_dir, "orders"), "o_orderkey").withColumn("answer", truth).withColumn(
        "variant", pick_int(17, "variant", 0, 8, "o_orderkey")
    )
    answer, variant = F.col("answer"), F.col("variant")
    wrong = F.when(F.col("o_orderstatus") == "P", "maybe").otherwise(numbers.plain(F.col("o_totalprice") + 1))
    output = (
        F.when(variant == 0, F.concat(F.lit("Let us see.\nFinal answer: "), answer))
        .when(variant == 1, F.concat(F.lit("*so* **Final answer:** "), answer))
        .when(variant == 2, F.concat(F.lit("final ANSWER: `"), answer, F.lit("`")))
        .when(variant == 3, F.concat(F.lit("Step 1.\n> quoted\nFinal answer: 7\nFinal answer: "), answer, F.lit(" % ")))
        .when(variant == 4, F.lit("I do not know"))
        .when(variant == 5, F.concat(F.lit("Final answer: "), wrong))
        .when(variant == 6, F.concat(F.lit("Final answer: "), F.format_number("o_totalprice", 2)))
        .when(variant == 7, F.concat(F.lit("```python\nprint(1)\n```\nFinal answer: "), F.upper(answer), F.lit(". Because.")))
        .otherwise(F.concat(F.lit("Final answer: The answer is "), answer))
    )
    label = F.when(pick_int(18, "list", 0, 3, "o_orderkey") == 0, F.concat(F.lit("['"), answer, F.lit("']"))).otherwise(answer)
    return orders.select(
        F.col("o_orderkey").alias("sample_id"),
        F.col("o_orderstatus").alias("dataset"),
        pick(19, "method", METHODS, "o_orderkey").alias("method"),
        label.alias("label"),
        output.alias("output"),
    )


ANSWER = f"""CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_totalprice > 250000 THEN 'yes' ELSE 'no' END
  ELSE {numbers.sql_plain("o_totalprice")} END"""
SQL_OUTPUTS = f"""base AS (SELECT *, {ANSWER} AS answer, {sql_pick_int(17, "variant", 0, 8, "o_orderkey")} AS variant,
  CASE WHEN o_orderstatus = 'P' THEN 'maybe' ELSE {numbers.sql_plain("o_totalprice + 1")} END AS wrong FROM orders),
outputs AS (SELECT o_orderkey AS sample_id, o_orderstatus AS dataset, {sql_pick(19, "method", METHODS, "o_orderkey")} AS method,
  CASE WHEN {sql_pick_int(18, "list", 0, 3, "o_orderkey")} = 0 THEN '[''' || answer || ''']' ELSE answer END AS label,
  CASE variant WHEN 0 THEN 'Let us see.' || chr(10) || 'Final answer: ' || answer
   WHEN 1 THEN '*so* **Final answer:** ' || answer
   WHEN 2 THEN 'final ANSWER: `' || answer || '`'
   WHEN 3 THEN 'Step 1.' || chr(10) || '> quoted' || chr(10) || 'Final answer: 7' || chr(10) || 'Final answer: ' || answer || ' % '
   WHEN 4 THEN 'I do not know' WHEN 5 THEN 'Final answer: ' || wrong
   WHEN 6 THEN 'Final answer: ' || format('{{:,.2f}}', o_totalprice)
   WHEN 7 THEN '```python' || chr(10) || 'print(1)' || chr(10) || '```' || chr(10) || 'Final answer: ' || upper(answer) || '. Because.'
   ELSE 'Final answer: The answer is ' || answer END AS output FROM base)"""


def sql_strip(x):
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def sql_squeeze(x):
    return sql_strip(f"regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g')")


def sql_number(x, pattern=numbers.GROUPED_NUMBER):
    return f"TRY_CAST(replace(regexp_extract({x}, '{pattern}'), ',', '') AS DOUBLE)"


def sql_markdown(x):
    fences = f"""list_aggregate(list_transform(string_split({x}, '```'), lambda p, i: CASE
      WHEN i % 2 = 0 AND i < len(string_split({x}, '```')) THEN
        CASE WHEN contains(p, chr(10)) THEN regexp_replace(p, '^[^\\n]*\\n', '') ELSE '```' || p END
      WHEN i % 2 = 0 THEN '```' || p ELSE p END), 'string_agg', '')"""
    out = f"regexp_replace({fences}, '`([^`]*)`', '\\1', 'g')"
    out = f"regexp_replace({out}, '\\*\\*([^\\n]*?)\\*\\*', '\\1', 'g')"
    out = f"regexp_replace({out}, '\\*([^\\n]*?)\\*', '\\1', 'g')"
    out = f"regexp_replace({out}, '(?m)^>\\s?', '', 'g')"
    return sql_strip(f"replace({out}, 'python', '')")


def sql_marker(x, marker="final answer:"):
    return f"""CASE WHEN contains(lower({x}), '{marker}') THEN
      {sql_strip(f"right({x}, length(list_extract(string_split(lower({x}), '{marker}'), -1)))")} ELSE '' END"""


# RE2 has no Unicode word boundary, and neighbouring articles share a separator: two passes
SQL_ARTICLE = r"(^|[^\p{L}\p{N}_])(a|an|the)($|[^\p{L}\p{N}_])"
SQL_PUNCTUATION = text.PUNCTUATION.replace("'", "''")


def sql_normalize(x):
    out = f"regexp_replace(lower({x}), '{SQL_PUNCTUATION}', '', 'g')"
    for _ in range(2):
        out = f"regexp_replace({out}, '{SQL_ARTICLE}', '\\1 \\3', 'g')"
    return sql_squeeze(out)


def sql_first_element(x):
    return f"""CASE WHEN regexp_matches({x}, '^\\s*\\[[^\\n]*\\]\\s*$') THEN
      regexp_replace(regexp_replace(regexp_extract({x}, '^\\s*\\[\\s*(?:''([^'']*)''|"([^"]*)"|([^,\\]]*))'), '^\\s*\\[\\s*', ''),
        '^[''"]|[''"]$', '', 'g') ELSE {x} END"""


SQL_SCORED = f"""{SQL_OUTPUTS}, md AS (SELECT * EXCLUDE (output, label), {sql_markdown("output")} AS md, {sql_first_element("label")} AS label FROM outputs),
pred AS (SELECT * EXCLUDE (md), {sql_strip("replace(" + sql_marker("md") + ", '%', '')")} AS prediction FROM md),
nums AS (SELECT *, {sql_number("prediction")} AS p, {sql_number("label")} AS g FROM pred),
scored AS (SELECT sample_id, dataset, method, label, prediction, CASE
   WHEN p IS NOT NULL AND g IS NOT NULL AND method = 'percentage_change' THEN round(p, 2) = round(g, 2)
   WHEN p IS NOT NULL AND g IS NOT NULL THEN round(p, 6) = round(g, 6)
   ELSE lower({sql_strip("prediction")}) = lower({sql_strip("label")}) END AS match FROM nums)"""


def _docs(spark, sf_dir):
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("is_numeric_text", f"""
WITH {SQL_OUTPUTS} SELECT sample_id, TRY_CAST(replace(label, ',', '') AS DOUBLE) IS NOT NULL AS numeric FROM outputs
""")
def is_numeric_text(spark, sf_dir):
    return model_outputs(spark, sf_dir).select("sample_id", numbers.is_numeric_text(F.col("label")).alias("numeric"))


@query("first_number", f"""
SELECT doc_id, {sql_number("text")} AS grouped, {sql_number("text", numbers.LOOSE_NUMBER)} AS loose FROM documents
""")
def first_number(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id", numbers.first_number(t).alias("grouped"), numbers.first_number(t, numbers.LOOSE_NUMBER).alias("loose")
    )


@query("first_list_element", f"WITH {SQL_OUTPUTS} SELECT sample_id, {sql_first_element('label')} AS label FROM outputs")
def first_list_element(spark, sf_dir):
    return model_outputs(spark, sf_dir).select("sample_id", text.first_list_element(F.col("label")).alias("label"))


@query("normalize_answer", f"SELECT doc_id, {sql_normalize('text')} AS normal FROM documents")
def normalize_answer(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.normalize_answer(F.col("text")).alias("normal"))


@query("normalize_alnum", f"""
SELECT doc_id, regexp_replace(lower({sql_strip("text")}), '[^a-z0-9]+', '', 'g') AS normal FROM documents
""")
def normalize_alnum(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.normalize_alnum(F.col("text")).alias("normal"))


@query("yes_no_prefix", f"""
WITH {SQL_SCORED}, a AS (SELECT sample_id, regexp_replace(lower({sql_strip("prediction")}), '[^a-z0-9]+', '', 'g') AS s FROM pred)
SELECT sample_id, CASE WHEN starts_with(s, 'yes') THEN 'yes' WHEN starts_with(s, 'no') THEN 'no' ELSE s END AS answer FROM a
""")
def yes_no_prefix(spark, sf_dir):
    answer = text.yes_no_prefix(text.normalize_alnum(scoring.prediction_of(F.col("output"))))
    return model_outputs(spark, sf_dir).select("sample_id", answer.alias("answer"))


@query("strip_percent", f"""
WITH {SQL_OUTPUTS} SELECT sample_id, {sql_strip("replace(output, '%', '')")} AS bare FROM outputs
""")
def strip_percent(spark, sf_dir):
    return model_outputs(spark, sf_dir).select("sample_id", text.strip_percent(F.col("output")).alias("bare"))


@query("strip_markdown", f"""
WITH {SQL_OUTPUTS} SELECT 'o' || sample_id AS id, {sql_markdown("output")} AS bare FROM outputs
UNION ALL SELECT 'd' || doc_id, {sql_markdown("text")} FROM documents
""")
def strip_markdown(spark, sf_dir):
    outputs = model_outputs(spark, sf_dir).select(F.concat(F.lit("o"), "sample_id").alias("id"), F.col("output").alias("t"))
    docs = _docs(spark, sf_dir).select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("t"))
    return outputs.unionByName(docs).select("id", text.strip_markdown(F.col("t")).alias("bare"))


@query("after_last_marker", f"WITH {SQL_OUTPUTS} SELECT sample_id, {sql_marker('output')} AS answer FROM outputs")
def after_last_marker(spark, sf_dir):
    return model_outputs(spark, sf_dir).select(
        "sample_id", text.after_last_marker(F.col("output"), scoring.MARKER).alias("answer")
    )


@query("match_exact_rounded", f"WITH {SQL_SCORED} SELECT sample_id, prediction, label, match FROM scored")
def match_exact_rounded(spark, sf_dir):
    return scoring.scored(model_outputs(spark, sf_dir)).select("sample_id", "prediction", "label", "match")


SQL_TOLERANT = f"""{SQL_SCORED}, tn AS (SELECT *, {sql_number("prediction", numbers.LOOSE_NUMBER)} AS tp,
   {sql_number("label", numbers.LOOSE_NUMBER)} AS tg,
   regexp_replace(lower({sql_strip("prediction")}), '[^a-z0-9]+', '', 'g') AS sp,
   regexp_replace(lower({sql_strip("label")}), '[^a-z0-9]+', '', 'g') AS sg FROM pred),
mode AS (SELECT dataset, bool_and(tg IS NOT NULL) AS numeric FROM tn GROUP BY dataset),
tolerant AS (SELECT sample_id, dataset, CASE WHEN numeric THEN coalesce(abs(tp - tg) < 0.005, false) ELSE
   (CASE WHEN starts_with(sp, 'yes') THEN 'yes' WHEN starts_with(sp, 'no') THEN 'no' ELSE sp END)
   = (CASE WHEN starts_with(sg, 'yes') THEN 'yes' WHEN starts_with(sg, 'no') THEN 'no' ELSE sg END) END AS match
  FROM tn JOIN mode USING (dataset))"""


@query("match_tolerant", f"WITH {SQL_TOLERANT} SELECT sample_id, dataset, match FROM tolerant")
def match_tolerant(spark, sf_dir):
    scored = scoring.scored(model_outputs(spark, sf_dir)).drop("match")
    return scoring.tolerant_match(scored, ["dataset"], "prediction", "label").select("sample_id", "dataset", "match")


def turn_pairs(spark, sf_dir):
    """Each user turn with the assistant turn after it, keyed by a digest of both texts."""
    turns = load(spark, sf_dir, "conversations")
    users = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("label"))
    answers = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    pairs = users.join(answers, ["conv_id", "turn"])
    return pairs.withColumn("pair", digest(0, "pair", "conv_id", "turn", "label", "prediction")).dropDuplicates(["pair"])


SQL_TOKENS = f"""pairs AS (SELECT DISTINCT u.conv_id, u.turn, u.text AS label, a.text AS prediction,
    {sql_digest(0, "pair", "u.conv_id", "u.turn", "u.text", "a.text")} AS pair
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
tok AS (SELECT pair, 'p' AS side, unnest(string_split({sql_normalize("prediction")}, ' ')) AS token FROM pairs
  UNION ALL SELECT pair, 'g', unnest(string_split({sql_normalize("label")}, ' ')) FROM pairs),
cnt AS (SELECT pair, token, count(*) FILTER (WHERE side = 'p') AS p, count(*) FILTER (WHERE side = 'g') AS g
  FROM tok WHERE token <> '' GROUP BY pair, token),
tot AS (SELECT pairs.pair, coalesce(sum(p), 0)::DOUBLE AS p, coalesce(sum(g), 0)::DOUBLE AS g, coalesce(sum(least(p, g)), 0)::DOUBLE AS same
  FROM pairs LEFT JOIN cnt ON cnt.pair = pairs.pair GROUP BY pairs.pair),
f AS (SELECT pair, CASE WHEN p = 0 AND g = 0 THEN 1.0::DOUBLE WHEN p = 0 OR g = 0 OR same = 0 THEN 0.0::DOUBLE
  ELSE 2.0::DOUBLE * (same / p) * (same / g) / (same / p + same / g) END AS f1 FROM tot)"""


@query("token_f1", f"WITH {SQL_TOKENS} SELECT pair, f1 FROM f")
def token_f1(spark, sf_dir):
    return scoring.token_f1(turn_pairs(spark, sf_dir), ["pair"], "prediction", "label")


@query("mean_f1", f"""
WITH {SQL_TOKENS} SELECT count(*) AS samples, CAST(sum(CAST(f1 AS DECIMAL(18,9))) AS DOUBLE) / count(*) AS mean_f1 FROM f
""")
def mean_f1(spark, sf_dir):
    scores = scoring.token_f1(turn_pairs(spark, sf_dir), ["pair"], "prediction", "label")
    exact = F.sum(F.col("f1").cast("decimal(18,9)")).cast("double")
    return scores.agg(F.count(F.lit(1)).alias("samples"), (exact / F.count(F.lit(1))).alias("mean_f1"))


@query("accuracy", f"""
WITH {SQL_SCORED} SELECT dataset, count(*) AS samples, CAST(count(*) FILTER (WHERE match) AS DOUBLE) / count(*) AS accuracy
FROM scored GROUP BY dataset
""")
def accuracy(spark, sf_dir):
    return scoring.accuracy(scoring.scored(model_outputs(spark, sf_dir)), ["dataset"])


@query("accuracy_tolerant", f"""
WITH {SQL_TOLERANT} SELECT dataset, count(*) AS samples, CAST(count(*) FILTER (WHERE match) AS DOUBLE) / count(*) AS accuracy
FROM tolerant GROUP BY dataset
""")
def accuracy_tolerant(spark, sf_dir):
    scored = scoring.scored(model_outputs(spark, sf_dir)).drop("match")
    return scoring.accuracy(scoring.tolerant_match(scored, ["dataset"], "prediction", "label"), ["dataset"])


@query("camel_to_words", """
SELECT p_partkey, lower(p_name) || ' part ' || p_size AS words FROM part
""")
def camel_to_words(spark, sf_dir):
    camel = F.concat(F.regexp_replace(F.initcap("p_name"), " ", ""), F.lit("Part"), F.col("p_size").cast("string"))
    return load(spark, sf_dir, "part").select("p_partkey", text.camel_to_words(camel).alias("words"))


OPS = list(text.OPERATOR_WORDS)
SQL_OP_WORDS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.OPERATOR_WORDS.items()) + "}"


@query("predicate_to_text", f"""
WITH o AS (SELECT *, {sql_pick(20, "op", OPS, "p_partkey")} AS op FROM part)
SELECT p_partkey, 'retail price ' || {SQL_OP_WORDS}[op] || ' "' || p_name || '"' AS words FROM o
""")
def predicate_to_text(spark, sf_dir):
    op = pick(20, "op", OPS, "p_partkey")
    return load(spark, sf_dir, "part").select(
        "p_partkey", text.predicate_text(F.lit("RetailPrice"), op, F.col("p_name")).alias("words")
    )


REPLACEMENTS = {"the": "[t]", "then": "[n]", "and": "&", ". ": " | ", "on": "ON", "ion": "+"}


@query("replace_many", """
SELECT doc_id, list_aggregate(list_transform(list_zip(string_split_regex(text, 'then|the|and|ion|\\. |on'),
    regexp_extract_all(text, 'then|the|and|ion|\\. |on')), lambda z: z[1] || coalesce(MAP {'the': '[t]', 'then': '[n]', 'and': '&',
    '. ': ' | ', 'on': 'ON', 'ion': '+'}[z[2]], '')), 'string_agg', '') AS replaced FROM documents
""")
def replace_many(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.replace_many(F.col("text"), REPLACEMENTS).alias("replaced"))


@query("strip_quotes", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE text || '"' END AS bare FROM documents
""")
def strip_quotes(spark, sf_dir):
    quoted = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('"'), "text", F.lit('"'))).otherwise(F.concat("text", F.lit('"')))
    return _docs(spark, sf_dir).select("doc_id", text.strip_quotes(quoted).alias("bare"))


def sql_label(x):
    out = f"translate(lower({x}), '—–', '--')"
    out = f"regexp_replace({out}, '[_/]+', ' ', 'g')"
    return sql_squeeze(f"regexp_replace({out}, '{text.LABEL_DROP}', ' ', 'g')")


@query("normalize_label", f"SELECT doc_id, {sql_label('text')} AS normal FROM documents")
def normalize_label(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.normalize_label(F.col("text")).alias("normal"))


@query("token_sort", f"""
SELECT doc_id, list_aggregate(list_sort(string_split({sql_label('text')}, ' ')), 'string_agg', ' ') AS sorted FROM documents
""")
def token_sort(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.token_sort(text.normalize_label(F.col("text"))).alias("sorted"))


@query("paren_parts", f"""
SELECT doc_id, list_aggregate(list_append(list_transform(regexp_extract_all(text, '\\(([^\\n]*?)\\)', 1), lambda p: {sql_strip("p")}),
  {sql_squeeze("regexp_replace(text, '\\([^\\n]*?\\)', ' ', 'g')")}), 'string_agg', '|') AS parts FROM documents
""")
def paren_parts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(text.paren_parts(F.col("text")), "|").alias("parts"))


@query("fix_mojibake", "SELECT doc_id, text AS repaired FROM documents")
def fix_mojibake(spark, sf_dir):
    """Texts read with the wrong character set come back as they were."""
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return _docs(spark, sf_dir).select("doc_id", text.fix_mojibake(broken).alias("repaired"))


@query("count_decimals", """
SELECT event_id, length(string_split(CAST(value AS VARCHAR), '.')[2]) AS decimals FROM events
""")
def count_decimals(spark, sf_dir):
    decimals = numbers.decimals_in(F.col("value").cast("string"))
    return load(spark, sf_dir, "events").select("event_id", decimals.cast("long").alias("decimals"))


@query("decimal_places_of_first", """
SELECT user_id, min_by(length(string_split(CAST(value AS VARCHAR), '.')[2]), event_id) AS decimals FROM events GROUP BY user_id
""")
def decimal_places_of_first(spark, sf_dir):
    first = F.min_by(numbers.decimals_in(F.col("value").cast("string")), "event_id")
    return load(spark, sf_dir, "events").groupBy("user_id").agg(first.cast("long").alias("decimals"))


PROMPT = """Data below, question after it. Give the value only.
{table}
==
{question}"""


@query("prompt_render", """
SELECT conv_id, turn, md5('Data below, question after it. Give the value only.' || chr(10) || text || chr(10) || '==' || chr(10) || role) AS prompt
FROM conversations
""")
def prompt_render(spark, sf_dir):
    prompt = text.render_template(PROMPT, question=F.col("role"), table=F.col("text"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(prompt).alias("prompt"))


SQL_WORDS = "len(string_split_regex(" + sql_strip("text") + ", '[\\s\\p{Z}]+'))"


@query("token_usage_totals", f"""
WITH w AS (SELECT conv_id, role, {SQL_WORDS} AS n, length(text) AS chars FROM conversations)
SELECT conv_id, CAST(coalesce(sum(n) FILTER (WHERE role = 'user'), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(n) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS output_tokens,
  count(*) AS calls, CAST(sum(chars + 1) AS BIGINT) AS text_chars,
  CAST(coalesce(sum(least(chars, 200)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS content_used,
  CAST(coalesce(sum(chars) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS total_content,
  count(*) FILTER (WHERE role = 'assistant') AS num_tables FROM w GROUP BY conv_id
""")
def token_usage_totals(spark, sf_dir):
    """Usage per conversation; answers of the assistant are the calls that report how much of a table they used."""
    words = F.size(F.split(text.strip(F.col("text")), text.BLANK))
    role, chars = F.col("role"), F.length("text")
    answered = role == "assistant"
    log = load(spark, sf_dir, "conversations").select(
        "conv_id",
        F.when(role == "user", words).otherwise(0).alias("input_tokens"),
        F.when(answered, words).otherwise(0).alias("output_tokens"),
        (chars + 1).alias("chars"),
        F.when(answered, F.least(chars, F.lit(200))).alias("content_used"),
        F.when(answered, chars).alias("total_content"),
    )
    return scoring.usage_totals(log, ["conv_id"])


@query("token_usage_text", f"""
WITH o AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, {sql_digest(0, "turn", "role", "text")}) - 1 AS pos FROM conversations)
SELECT conv_id, pos // 64 AS part, md5(string_agg(chr(10) || text, '' ORDER BY pos)) AS transcript FROM o GROUP BY ALL
""")
def token_usage_text(spark, sf_dir):
    """Transcripts in order, in parts of 64 turns, so that a long one is never a single row."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text", digest(0, "turn", "role", "text").alias("_h"))
    placed = ordered_positions(turns, ["conv_id"], "turn", "_h").withColumn("part", F.expr("position div 64"))
    lines = F.array_sort(F.collect_list(F.struct("position", "text")))
    joined = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("\n"), x["text"])), "")
    return placed.groupBy("conv_id", "part").agg(F.md5(joined).alias("transcript"))

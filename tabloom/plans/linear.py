"""Rules between rows: links of several terms, and the repair of linear rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import links, rules
from tabloom.operators.links import LinearRule
from tabloom.plans.registry import query
from tabloom.plans.synthesis import BOUND_RULES, DOMAIN, SQL_BOUNDS, SQL_RULE_LINES, rule_lines
from tabloom.session import materialise

#: Prices of lines of one order by size class, in cents. Several lines can share a class, so some are ambiguous.
PACK_RULES = [
    LinearRule("p1", (("pack = 1", 1), ("pack = 2", 1), ("pack = 3", -1)), ">=", 0),
    LinearRule("p2", (("pack = 3", 1), ("pack = 4", -1)), ">=", 500_000),
    LinearRule("p3", (("pack = 5", 2), ("pack = 4", -1)), "<=", 9_000_000),
]
#: Rounds written out in the SQL; the query itself goes on until nothing changes, which on these rules takes fewer.
SQL_ROUNDS = 8


def sql_links(rule_list, source: str, row: str, key: str) -> str:
    """CTEs ``<rule>_links(r0, r1, ...)`` and ``<rule>_gone(row)`` of all rules, from the relation ``source``."""
    parts, alive = [], source
    for rule in rule_list:
        tests = [f"coalesce({s}, false)" for s, _ in rule.terms]
        n, name = len(tests), rule.id
        firsts = ", ".join(f"min({row}) FILTER (WHERE {t}) AS f{i}" for i, t in enumerate(tests) if i)

        def groups(of, firsts=firsts, tests=tests):
            return f"SELECT {key} AS k, {firsts} FROM {of} GROUP BY {key} HAVING bool_or({tests[0]})"

        odd = " OR ".join(
            f"({t} AND {row} <> f{i}{''.join(f' AND f{j} IS NOT NULL' for j in range(1, i))})" for i, t in enumerate(tests) if i
        )
        same = f"{key} IS NOT DISTINCT FROM k"
        parts += [
            f"{name}_groups AS ({groups(alive)})",
            f"{name}_gone AS (SELECT {row} AS gone FROM {alive} JOIN {name}_groups ON {same} WHERE {odd})",
            f"{name}_left AS (SELECT * FROM {alive} WHERE {row} NOT IN (SELECT gone FROM {name}_gone))",
            f"{name}_first AS ({groups(f'{name}_left')})",
            f"{name}_links AS (SELECT {row} AS r0, {', '.join(f'f{i} AS r{i}' for i in range(1, n))} FROM {name}_left "
            f"JOIN {name}_first ON {same} WHERE {tests[0]} AND {' AND '.join(f'f{i} IS NOT NULL' for i in range(1, n))})",
        ]
        alive = f"{name}_left"
    return ",\n".join(parts)


FLAG_RULES = [
    LinearRule("flags", (("flag = 'R'", 1), ("flag = 'A'", 1), ("flag = 'N'", -1)), ">=", 0),
    LinearRule("pairs", (("flag = 'N'", 1), ("flag = 'R'", 1)), ">=", 0),
]
SQL_FLAG_LINES = f"{SQL_RULE_LINES}, fl AS (SELECT row_key, order_id, flag, price FROM rl)"


def flag_lines(spark, sf_dir):
    return rule_lines(spark, sf_dir).select("row_key", "order_id", "flag", "price")


@query("inter_row_link_terms", f"""
WITH {SQL_FLAG_LINES},
{sql_links(FLAG_RULES, "fl", "row_key", "order_id")}
SELECT 'flags' AS rule_id, r0 AS first_row, concat_ws(' ', r0, r1, r2) AS rows_ FROM flags_links
UNION ALL SELECT 'pairs', r0, concat_ws(' ', r0, r1) FROM pairs_links
""")
def inter_row_link_terms(spark, sf_dir):
    """Links of a three-term and a two-term rule over all other columns; what the first rule removes, the second misses."""
    found, _ = links.link_rows(flag_lines(spark, sf_dir), FLAG_RULES, "row_key", "price")
    return found.select("rule_id", F.col("rows")[0].alias("first_row"), F.concat_ws(" ", "rows").alias("rows_"))


@query("inter_row_ambiguous", f"""
WITH {SQL_FLAG_LINES},
{sql_links(FLAG_RULES, "fl", "row_key", "order_id")}
SELECT 'flags' AS rule_id, gone AS row_key FROM flags_gone UNION ALL SELECT 'pairs', gone FROM pairs_gone
""")
def inter_row_ambiguous(spark, sf_dir):
    """Rows that the rules cannot tell apart from a linked one, with the rule that removes them."""
    _, removed = links.link_rows(flag_lines(spark, sf_dir), FLAG_RULES, "row_key", "price")
    return removed.select("rule_id", "row_key")


SQL_PACKS = f"""{SQL_BOUNDS}, packs AS MATERIALIZED (
  SELECT row_key, order_id, CAST(ceil(quantity / 10.0) AS INTEGER) AS pack, CAST(round(lo * 100) AS BIGINT) AS lo,
         CAST(round(hi * 100) AS BIGINT) AS hi FROM bd)"""


def packs(spark, sf_dir):
    bounded = rules.bounds(rule_lines(spark, sf_dir), BOUND_RULES, "price", *DOMAIN)

    def cents(column: str):
        return F.round(F.col(column) * 100).cast("long")

    return bounded.select(
        "row_key",
        "order_id",
        F.ceil(F.col("quantity") / 10.0).cast("int").alias("pack"),
        cents("price").alias("price"),
        cents("price_lo").alias("lo"),
        cents("price_hi").alias("hi"),
    )


def _sql_repair(rule_list) -> str:
    """Bounds after SQL_ROUNDS synchronous rounds of what every link leaves to each of its rows."""
    terms = " UNION ALL ".join(
        f"SELECT '{r.id}|' || r0 AS link, r{i} AS r, {i} AS pos, {c}::BIGINT AS coef, "
        f"{r.limits()[0] if r.limits()[0] is not None else 'NULL'}::BIGINT AS low, {r.limits()[1] if r.limits()[1] is not None else 'NULL'}::BIGINT AS high "
        f"FROM {r.id}_links" for r in rule_list for i, (_, c) in enumerate(r.terms)
    )
    gone = " UNION ALL ".join(f"SELECT gone FROM {r.id}_gone" for r in rule_list)
    ctes = [
        f"gone AS ({gone})",
        f"terms AS MATERIALIZED ({terms})",
        "v0 AS MATERIALIZED (SELECT row_key AS r, lo, hi, lo <= hi AS alive FROM packs WHERE row_key NOT IN (SELECT gone FROM gone))",
    ]
    for i in range(SQL_ROUNDS):
        ctes += [
            f"""s{i} AS (SELECT t.*, v.lo, v.hi, bool_and(alive) OVER w AS active,
              sum(least(coef * lo, coef * hi)) OVER w AS least, sum(greatest(coef * lo, coef * hi)) OVER w AS most
              FROM terms t JOIN v{i} v ON t.r = v.r WINDOW w AS (PARTITION BY link))""",
            f"""b{i} AS (SELECT *, coalesce(least > high, false) OR coalesce(most < low, false) AS broken,
              (high - least + least(coef * lo, coef * hi))::DOUBLE / coef AS by_high, (low - most + greatest(coef * lo, coef * hi))::DOUBLE / coef AS by_low
              FROM s{i} WHERE active)""",
            f"""g{i} AS (SELECT r, bool_or(broken AND pos = 0) AS out,
              max(CASE WHEN NOT broken THEN ceil(CASE WHEN coef > 0 THEN by_low ELSE by_high END) END)::BIGINT AS to_lo,
              min(CASE WHEN NOT broken THEN floor(CASE WHEN coef > 0 THEN by_high ELSE by_low END) END)::BIGINT AS to_hi FROM b{i} GROUP BY r)""",
            f"""v{i + 1} AS MATERIALIZED (SELECT v.r, CASE WHEN alive THEN greatest(lo, to_lo) ELSE lo END AS lo,
              CASE WHEN alive THEN least(hi, to_hi) ELSE hi END AS hi,
              alive AND NOT coalesce(out, false) AND greatest(lo, to_lo) <= least(hi, to_hi) AS alive FROM v{i} v LEFT JOIN g{i} USING (r))""",
        ]
    return ",\n".join(ctes)


@query("rule_repair_linear", f"""
WITH {SQL_PACKS},
{sql_links(PACK_RULES, "packs", "row_key", "order_id")},
{_sql_repair(PACK_RULES)}
SELECT r AS row_key, lo, hi, CASE WHEN alive THEN 'kept' ELSE 'unsatisfiable' END AS state, alive AS in_bounds, 0 AS broken_links
FROM v{SQL_ROUNDS}
UNION ALL SELECT DISTINCT gone, NULL, NULL, 'ambiguous', false, 0 FROM gone
""")
def rule_repair_linear(spark, sf_dir):
    """Bounds that sums and differences of prices leave, and whether the redrawn prices meet bounds and rules.

    ``broken_links`` counts the links that the new values of a row break, as first row.
    """
    lines = packs(spark, sf_dir)
    made, removed = links.linked_parts(lines, PACK_RULES, "row_key", "price", ["lo", "hi"])
    found = links.repair(lines, PACK_RULES, "row_key", "price", "lo", "hi", 53, linked=(made, removed))
    values = found.select(F.col("row_key").alias("row"), "value", (F.col("state") == "kept").alias("alive"))
    broken = links.unmet(links._terms(made, PACK_RULES), values).groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    broken = materialise(broken, "broken-links")
    inside = (F.col("state") == "kept") & F.col("value").between(F.col("lo"), F.col("hi"))
    return found.join(broken, F.col("row_key") == F.col("row"), "left").select(
        "row_key", "lo", "hi", "state", F.coalesce(inside, F.lit(False)).alias("in_bounds"), F.coalesce("n", F.lit(0)).cast("int").alias("broken_links")
    )

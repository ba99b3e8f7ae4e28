"""Table synthesis and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.sampling import sql_pick_int, sql_uniform, uniform
from tabloom.operators import fill, rules
from tabloom.operators.joins import domain_product
from tabloom.operators.views import part_specs
from tabloom.plans.projections import SQL_SPECS
from tabloom.plans.registry import query
from tabloom.sources.tables import SQL_LINE_KEY, line_key, load


@query("dense_fill", f"""
WITH {SQL_SPECS}, b AS (SELECT *, unnest(brand_domain) AS brand FROM specs),
g AS (SELECT *, unnest(type_domain) AS type FROM b),
c AS (SELECT *, CAST(round(price_lo * 100) AS BIGINT) AS lo, CAST(round(price_hi * 100) AS BIGINT) AS hi FROM g)
SELECT table_id, brand, type, least(lo + CAST(floor({sql_uniform(41, "fill", "table_id", "brand", "type")} * (hi - lo + 1)) AS BIGINT), hi) / 100.0::DOUBLE AS value FROM c
""")
def dense_fill(spark, sf_dir):
    specs = part_specs(spark, sf_dir)
    return fill.dense_fill(specs, {"brand": "brand_domain", "type": "type_domain"}, "price_lo", "price_hi", 41).select(
        "table_id", "brand", "type", "value"
    )


@query("dense_fill_decimals", f"""
WITH {SQL_SPECS}, b AS (SELECT *, unnest(brand_domain) AS brand FROM specs), g AS (SELECT *, unnest(type_domain) AS type, pow(10.0::DOUBLE, table_id % 4) AS scale FROM b),
c AS (SELECT *, CAST(round(price_lo * scale) AS BIGINT) AS lo, CAST(round(price_hi * scale) AS BIGINT) AS hi FROM g)
SELECT table_id, brand, type, least(lo + CAST(floor({sql_uniform(41, "fill", "table_id", "brand", "type")} * (hi - lo + 1)) AS BIGINT), hi) / scale AS value FROM c
""")
def dense_fill_decimals(spark, sf_dir):
    """Values of none to three decimals, as each table's unit wants them."""
    specs = part_specs(spark, sf_dir)
    domains = {"brand": "brand_domain", "type": "type_domain"}
    return fill.dense_fill(specs, domains, "price_lo", "price_hi", 41, F.col("table_id") % 4).select("table_id", "brand", "type", "value")


def sql_long(lo, hi, u):
    return f"least({lo} + CAST(floor({u} * ({hi} - {lo} + 1)) AS BIGINT), {hi})"


@query("dense_fill_fk", f"""
WITH {SQL_SPECS}, k AS (SELECT table_id, type_domain, unnest(list_distinct([size_lo::BIGINT, {", ".join(
    sql_long("size_lo::BIGINT", "size_hi::BIGINT", sql_uniform(42, f"fk-{i}", "table_id")) for i in range(4))}])) AS size FROM specs)
SELECT table_id, size, unnest(type_domain) AS type FROM k
""")
def dense_fill_fk(spark, sf_dir):
    """Skeleton whose integer key domain is the key to keep and four random values."""
    specs = part_specs(spark, sf_dir).withColumn(
        "size_domain", fill.fk_domain(F.col("size_lo"), F.col("size_lo"), F.col("size_hi"), 42, "table_id")
    )
    return domain_product(specs, {"size": "size_domain", "type": "type_domain"}).select("table_id", "size", "type")


@query("random_fill", f"""
WITH {SQL_SPECS}, r AS (SELECT *, unnest(range(1, {sql_pick_int(43, "rows", 2, 10, "table_id")} + 1)) AS row_id FROM specs),
b AS (SELECT *, size_lo::BIGINT AS lo, CASE WHEN size_hi = 50 THEN 4000000000 ELSE size_hi END::BIGINT AS hi FROM r)
SELECT table_id, row_id, name_domain[CAST(floor({sql_uniform(43, "name", "table_id", "row_id")} * len(name_domain)) AS INTEGER) + 1] AS name,
  {sql_long("lo", "hi", sql_uniform(43, "size", "table_id", "row_id"))} AS size FROM b
""")
def random_fill(spark, sf_dir):
    """Random rows from domains; an upper bound of 50 stands for an unbounded domain here."""
    open_end = F.when(F.col("size_hi") == 50, float("inf")).otherwise(F.col("size_hi").cast("double"))
    size = fill.uniform_long(
        fill.finite(F.col("size_lo").cast("double")), fill.finite(open_end), uniform(43, "size", "table_id", "row_id")
    )
    name = fill.choice(F.col("name_domain"), uniform(43, "name", "table_id", "row_id"))
    return fill.random_fill(part_specs(spark, sf_dir), {"name": name, "size": size}, 2, 10, 43)


ROW_RULES = [
    ("r1", "flag = 'R' AND line_status = 'F'", "quantity <= 45"),
    ("r2", "quantity >= 40", "discount <= 0.08"),
    ("r3", "discount > 0.09 OR tax > 0.07", "price >= 5000"),
    ("r4", "price < 2000", "line <> 7"),
]


def rule_lines(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(
        line_key().alias("row_key"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line_status"),
    )


SQL_RULE_LINES = f"""rl AS (SELECT {SQL_LINE_KEY} AS row_key, l_orderkey AS order_id,
  l_linenumber AS line, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
  l_returnflag AS flag, l_linestatus AS line_status FROM lineitem)"""


@query("rule_predicate_eval", f"""
WITH {SQL_RULE_LINES} SELECT row_key, (flag = 'R' AND (quantity <> 10 OR price >= 20000)) OR discount < 0.02 AS mask FROM rl
""")
def rule_predicate_eval(spark, sf_dir):
    """A nested condition evaluated to a mask by Spark's own expressions."""
    condition = F.expr("(flag == 'R' and (quantity != 10 or price >= 20000)) or discount < 0.02")
    return rule_lines(spark, sf_dir).select("row_key", condition.alias("mask"))


@query("rule_audit_intra", f"WITH {SQL_RULE_LINES} " + " UNION ALL ".join(
    f"SELECT row_key, '{r}' AS rule_id FROM rl WHERE ({c}) AND NOT ({e})" for r, c, e in ROW_RULES))
def rule_audit_intra(spark, sf_dir):
    return rules.violations(rule_lines(spark, sf_dir), ["row_key"], ROW_RULES)


SQL_CONDITIONS = {r: c for r, c, _ in ROW_RULES}
FEEDS = rules.upstream(ROW_RULES, ["flag", "line_status", "quantity", "discount", "tax", "price", "line"])


@query("rule_candidate_rows", f"WITH {SQL_RULE_LINES} " + " UNION ALL ".join(
    f"SELECT row_key, '{r}' AS rule_id FROM rl WHERE " + " OR ".join(f"({SQL_CONDITIONS[i]})" for i in [r, *sources])
    for r, sources in {"r1": [], "r2": ["r1"], "r3": ["r1", "r2"], "r4": ["r1", "r2", "r3"]}.items()))
def rule_candidate_rows(spark, sf_dir):
    return rules.candidates(rule_lines(spark, sf_dir), ["row_key"], ROW_RULES)


@query("rule_dependency_closure", f"""
WITH RECURSIVE {SQL_RULE_LINES}, edge(src, dst) AS (VALUES ('r1','r2'), ('r2','r3'), ('r3','r4')),
closure(src, dst) AS (SELECT src, dst FROM edge UNION SELECT c.src, e.dst FROM closure c JOIN edge e ON c.dst = e.src),
n AS ({" UNION ALL ".join(f"SELECT '{r}' AS src, count(*) AS matching FROM rl WHERE {c}" for r, c, _ in ROW_RULES)})
SELECT closure.dst AS rule_id, closure.src AS upstream_id, matching FROM closure JOIN n ON n.src = closure.src
""")
def rule_dependency_closure(spark, sf_dir):
    """Upstream rules of every rule with the number of rows that may trigger them."""
    hits = rule_lines(spark, sf_dir).select(
        F.explode(rules.matches([(r, F.expr(c)) for r, c, _ in ROW_RULES])).alias("upstream_id")
    )
    counts = hits.groupBy("upstream_id").agg(F.count(F.lit(1)).alias("matching"))
    downstream = F.create_map(
        *[
            x
            for source in SQL_CONDITIONS
            for x in (F.lit(source), F.array(*[F.lit(r) for r in FEEDS if source in FEEDS[r]]).cast("array<string>"))
        ]
    )
    return counts.select(F.explode(downstream[F.col("upstream_id")]).alias("rule_id"), "upstream_id", "matching")


BOUND_RULES = [
    ("b1", "flag = 'R'", "<=", 60000.0),
    ("b2", "quantity >= 40", ">=", 30000.0),
    ("b3", "discount = 0.1", "<=", 25000.0),
    ("b4", "tax > 0.06", ">=", 1000.0),
]
DOMAIN = (900.0, 105000.0)
SQL_BOUNDS = f"""{SQL_RULE_LINES}, bd AS (SELECT *, greatest(900.0::DOUBLE, CASE WHEN quantity >= 40 THEN 30000.0::DOUBLE END, CASE WHEN tax > 0.06 THEN 1000.0::DOUBLE END) AS lo,
  least(105000.0::DOUBLE, CASE WHEN flag = 'R' THEN 60000.0::DOUBLE END, CASE WHEN discount = 0.1 THEN 25000.0::DOUBLE END) AS hi FROM rl)"""


@query("rule_bounds_intra", f"WITH {SQL_BOUNDS} SELECT row_key, lo AS price_lo, hi AS price_hi FROM bd WHERE lo <= hi")
def rule_bounds_intra(spark, sf_dir):
    """Bounds per row; a row with an empty interval cannot satisfy its rules and is dropped."""
    bounded = rules.bounds(rule_lines(spark, sf_dir), BOUND_RULES, "price", *DOMAIN)
    return bounded.filter("price_lo <= price_hi").select("row_key", "price_lo", "price_hi")


@query("rule_audit_inter", f"""
WITH {SQL_RULE_LINES}, b AS (SELECT order_id, min_by(price, row_key) AS v, min(row_key) AS r FROM rl WHERE line = 2 GROUP BY order_id),
c AS (SELECT order_id, min_by(price, row_key) AS v, min(row_key) AS r FROM rl WHERE line = 3 GROUP BY order_id)
SELECT rl.row_key AS a_row, b.r AS b_row, c.r AS c_row FROM rl JOIN b ON rl.order_id = b.order_id JOIN c ON rl.order_id = c.order_id
WHERE rl.line = 1 AND NOT (rl.price + b.v >= c.v * 1.5::DOUBLE)
""")
def rule_audit_inter(spark, sf_dir):
    """Orders where line 1 + line 2 is less than one and a half times line 3."""
    selectors = {n: F.col("line") == i for i, n in enumerate("abc", start=1)}
    rule = F.col("a_value") + F.col("b_value") >= F.col("c_value") * F.lit(1.5)
    return rules.linked_violations(rule_lines(spark, sf_dir), ["order_id"], "row_key", "price", selectors, rule).select(
        "a_row", "b_row", "c_row"
    )


STEPS = [1, 2, 3, 4, 5, 6, 7]


def _sql_chain():
    cols = ", ".join(
        f"min(row_key) FILTER (WHERE line = {s}) AS r{i}, min_by(lo, row_key) FILTER (WHERE line = {s}) AS lo{i}, "
        f"min_by(hi, row_key) FILTER (WHERE line = {s}) AS hi{i}" for i, s in enumerate(STEPS)
    )
    n = len(STEPS)
    ctes = [f"ch AS (SELECT order_id, {cols} FROM cents GROUP BY order_id)"]
    previous, above = "ch", "NULL::BIGINT"
    for i in range(n):
        lo = "greatest(" + ", ".join(f"lo{j}" for j in range(i, n)) + ", NULL::BIGINT)"
        hi = "least(" + ", ".join(f"hi{j}" for j in range(i + 1)) + ", NULL::BIGINT)"
        top = f"least({hi}, {above})"
        u = sql_uniform(51, "repair", f"r{i}")
        ctes.append(
            f"c{i} AS (SELECT *, r{i} IS NOT NULL AND {lo} <= {hi} AS ok{i}, CASE WHEN r{i} IS NOT NULL AND {lo} <= {hi} THEN "
            f"least({lo} + CAST(floor({u} * ({top} - {lo} + 1)) AS BIGINT), {top}) END AS v{i} FROM {previous})"
        )
        previous, above = f"c{i}", f"coalesce(v{i}, {above})"
    rows = " UNION ALL ".join(
        f"SELECT order_id, r{i} AS row_key, {i + 1} AS step, v{i} AS value, CASE WHEN ok{i} THEN 'kept' ELSE 'unsatisfiable' END AS state "
        f"FROM c{n - 1} WHERE r{i} IS NOT NULL" for i in range(n)
    )
    return ctes, rows


_CHAIN, _CHAIN_ROWS = _sql_chain()


@query("rule_repair", f"""
WITH {SQL_BOUNDS}, cents AS (SELECT *, CAST(round(lo * 100) AS BIGINT) AS loc, CAST(round(hi * 100) AS BIGINT) AS hic FROM bd WHERE lo <= hi),
{", ".join(_CHAIN).replace("min_by(lo, row_key)", "min_by(loc, row_key)").replace("min_by(hi, row_key)", "min_by(hic, row_key)")}
{_CHAIN_ROWS}
""")
def rule_repair(spark, sf_dir):
    """Prices redrawn so that row rules hold and line n costs at least as much as line n + 1."""
    bounded = rules.bounds(rule_lines(spark, sf_dir), BOUND_RULES, "price", *DOMAIN).filter("price_lo <= price_hi")
    cents = bounded.withColumn("lo", F.round(F.col("price_lo") * 100).cast("long")).withColumn(
        "hi", F.round(F.col("price_hi") * 100).cast("long")
    )
    return rules.repair_chain(cents, ["order_id"], "row_key", "line", STEPS, "lo", "hi", 51).select(
        "order_id", "row_key", "step", "value", "state"
    )

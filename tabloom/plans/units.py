"""Unit queries over events, whose type decides the unit of their value."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.sampling import pick, sql_pick, sql_uniform
from tabloom.operators import units
from tabloom.operators.views import random_subset
from tabloom.plans.registry import query
from tabloom.plans.scalars import sql_label
from tabloom.sources.tables import load

CASES = {
    "purchase": ("finance", "k", "million"),
    "click": ("finance", "bps", "percent"),
    "view": ("finance", "count", "share"),
    "error": ("healthcare", "milligram", "kg"),
    "signup": ("healthcare", "degF", "celsius"),
}


def measured(spark, sf_dir):
    """Events with the domain and units of their type; some values are null tokens."""
    entry = F.create_map(
        *[
            x
            for k, (d, f, t) in CASES.items()
            for x in (F.lit(k), F.struct(F.lit(d).alias("domain"), F.lit(f).alias("from_unit"), F.lit(t).alias("to_unit")))
        ]
    )
    events = load(spark, sf_dir, "events").withColumn("e", entry[F.col("event_type")])
    text = F.when(pick(30, "missing", [0, 0, 0, 0, 0, 0, 0, 1], "event_id") == 1, "n.a.").otherwise(F.col("value").cast("string"))
    return events.select("event_id", "user_id", "value", "e.domain", "e.from_unit", "e.to_unit", text.alias("shown"))


SQL_CASES = "(VALUES " + ", ".join(f"('{k}','{d}','{f}','{t}')" for k, (d, f, t) in CASES.items()) + ") c(event_type, domain, from_unit, to_unit)"


def sql_double(x):
    return "NULL::DOUBLE" if x is None else f"CAST('{x!r}' AS DOUBLE)"


SQL_UNITS = "u(ordinal, domain, unit, canonical_unit, kind, factor, \"offset\", aliases) AS (VALUES " + ", ".join(
    f"({i}, '{d}', '{u}', '{c}', '{k}', {sql_double(f)}, {sql_double(o)}, [{', '.join(repr(a) for a in al)}])"
    for i, (d, u, c, k, f, o, al) in enumerate(units.UNITS)
) + ")"
SQL_MEASURED = f"""{SQL_UNITS}, m AS (SELECT event_id, user_id, value, domain, from_unit, to_unit,
    CASE WHEN {sql_pick(30, "missing", [0, 0, 0, 0, 0, 0, 0, 1], "event_id")} = '1' THEN 'n.a.' ELSE CAST(value AS VARCHAR) END AS shown
  FROM events JOIN {SQL_CASES} USING (event_type)),
names AS (SELECT domain, name, max_by({{'kind': kind, 'factor': factor, 'offset': coalesce("offset", 0)}}, ordinal) AS e
  FROM (SELECT *, unnest(list_distinct(list_concat([unit], aliases))) AS name FROM u) GROUP BY domain, name)"""
SQL_CONVERTED = f"""{SQL_MEASURED}, r AS (SELECT m.*, f.e.kind AS kind, f.e.factor AS f1, f.e."offset" AS o1, t.e.factor AS f2, t.e."offset" AS o2,
    coalesce(f.e.kind = t.e.kind AND f.e.factor IS NOT NULL AND t.e.factor IS NOT NULL, false) AS convertible
  FROM m LEFT JOIN names f ON f.domain = m.domain AND f.name = m.from_unit LEFT JOIN names t ON t.domain = m.domain AND t.name = m.to_unit)"""


def sql_roundtrip(value, text):
    scale = f"pow(10.0::DOUBLE, CASE WHEN contains({text}, '.') THEN length(string_split({text}, '.')[2]) ELSE 0 END)"
    there = f"(({value} * f1 + o1 - o2) / f2)"
    cases = " ".join(
        f"WHEN round_even((((round_even({there} * {10.0**i!r}::DOUBLE, 0) / {10.0**i!r}::DOUBLE) * f2 + o2) - o1) / f1 * {scale}, 0) = round_even({value} * {scale}, 0) THEN {i}"
        for i in range(13)
    )
    return f"CASE {cases} ELSE -1 END"


@query("units_dimension", f"""
WITH {SQL_MEASURED} SELECT m.domain, e.kind AS kind, from_unit, count(*) AS measurements
FROM m JOIN names ON names.domain = m.domain AND name = from_unit GROUP BY ALL
""")
def units_dimension(spark, sf_dir):
    """How many values are measured in each unit of the dimension."""
    found = units.names(units.dimension(spark)).select("domain", F.col("name").alias("from_unit"), F.col("entry.kind").alias("kind"))
    counts = measured(spark, sf_dir).groupBy("domain", "from_unit").agg(F.count(F.lit(1)).alias("measurements"))
    return counts.join(units.sized(found), ["domain", "from_unit"]).select("domain", "kind", "from_unit", "measurements")


@query("unit_lookup_join", f"WITH {SQL_CONVERTED} SELECT event_id, kind, convertible, f1, o1, f2, o2 FROM r")
def unit_lookup_join(spark, sf_dir):
    return units.lookup(measured(spark, sf_dir), units.dimension(spark)).select(
        "event_id", "kind", "convertible", "f1", "o1", "f2", "o2"
    )


@query("unit_convert", f"""
WITH {SQL_CONVERTED} SELECT event_id, shown, CASE WHEN convertible THEN (TRY_CAST(shown AS DOUBLE) * f1 + o1 - o2) / f2 END AS converted FROM r
""")
def unit_convert(spark, sf_dir):
    resolved = units.lookup(measured(spark, sf_dir), units.dimension(spark))
    value = units.converted(F.col("shown").try_cast("double"))
    return resolved.select("event_id", "shown", F.when(F.col("convertible"), value).alias("converted"))


@query("unit_roundtrip_decimals", f"""
WITH {SQL_CONVERTED} SELECT event_id, {sql_roundtrip("value", "CAST(value AS VARCHAR)")} AS decimals FROM r WHERE convertible
""")
def unit_roundtrip_decimals(spark, sf_dir):
    resolved = units.lookup(measured(spark, sf_dir), units.dimension(spark)).filter("convertible")
    return resolved.select(
        "event_id", units.roundtrip_decimals(F.col("value"), units.scale_of(F.col("value").cast("string"))).alias("decimals")
    )


SQL_MEMBER = """places AS (SELECT domain, kind, min(ordinal) AS place, max(canonical_unit) AS canonical FROM u GROUP BY ALL),
listed AS (SELECT domain, kind, canonical AS name, place, true AS is_canonical FROM places
  UNION ALL SELECT x.domain, x.kind, x.name, p.place, false FROM (SELECT domain, kind, unnest(list_concat([unit], aliases)) AS name FROM u) x
    JOIN places p ON p.domain = x.domain AND p.kind = x.kind),
member AS (SELECT domain, name, coalesce(min_by(kind, place) FILTER (WHERE is_canonical), max_by(kind, place) FILTER (WHERE NOT is_canonical)) AS kind
  FROM listed GROUP BY ALL)"""


@query("unit_membership", f"""
WITH {SQL_MEASURED}, {SQL_MEMBER} SELECT event_id, member.kind AS kind FROM m JOIN member ON member.domain = m.domain AND name = to_unit
""")
def unit_membership(spark, sf_dir):
    member = units.membership(units.dimension(spark)).withColumnRenamed("name", "to_unit")
    return measured(spark, sf_dir).join(units.sized(member), ["domain", "to_unit"]).select("event_id", "kind")


SQL_TARGETS = f"""{SQL_MEMBER}, wanted AS (SELECT domain, name,
    CASE WHEN kind = 'CurrencyRepresentation' THEN 'DecimalScale' ELSE kind END AS tk,
    CASE WHEN kind = 'CurrencyRepresentation' THEN 'unit' ELSE name END AS surrogate FROM member),
targets AS (SELECT w.domain, w.name, w.surrogate, list_sort(list_distinct(flatten(list(list_concat([u.unit], u.aliases))))) AS targets
  FROM wanted w JOIN u ON u.domain = w.domain AND u.kind = w.tk AND u.factor <> 0 AND u.factor <> 1
   AND u.unit <> w.surrogate AND NOT list_contains(u.aliases, w.surrogate) GROUP BY ALL)"""


@query("unit_random_target", f"""
WITH {SQL_MEASURED}, {SQL_TARGETS} SELECT event_id, from_unit, surrogate,
  targets[CAST(floor({sql_uniform(33, "target", "event_id")} * len(targets)) AS INTEGER) + 1] AS to_unit
FROM m LEFT JOIN targets ON targets.domain = m.domain AND name = from_unit
""")
def unit_random_target(spark, sf_dir):
    rows = measured(spark, sf_dir).drop("to_unit")
    return units.random_target(rows, units.dimension(spark), "from_unit", 33, "target", "event_id").select(
        "event_id", "from_unit", "surrogate", "to_unit"
    )


@query("unit_sample", f"""
WITH {SQL_UNITS}, us AS (SELECT DISTINCT user_id FROM events), h AS (SELECT user_id, domain, unit, row_number() OVER (PARTITION BY user_id, domain
  ORDER BY md5(concat_ws('|', '34', 'units-' || domain, user_id, unit))) AS rn FROM us,
  (SELECT DISTINCT domain, unit FROM u WHERE domain <> 'finance' OR (kind = 'CurrencyRepresentation' AND len(aliases) > 0)))
SELECT user_id, domain, string_agg(unit, ',' ORDER BY unit) AS units FROM h WHERE rn <= 5 GROUP BY ALL
""")
def unit_sample(spark, sf_dir):
    """Five random units of each domain for every user; the finance domain offers its currencies."""
    users = load(spark, sf_dir, "events").select("user_id").distinct()
    picks = [
        F.struct(F.lit(d).alias("domain"), F.array_join(random_subset(F.lit(units.sample_from(d)), 5, 34, f"units-{d}", "user_id"), ",").alias("units"))
        for d in sorted({u[0] for u in units.UNITS})
    ]
    return users.select("user_id", F.explode(F.array(*picks)).alias("p")).select("user_id", "p.*")


@query("canonical_unit_pick", """
WITH p AS (SELECT p_type AS kind, p_name || p_partkey AS id, p_size AS mult, CASE WHEN p_retailprice > 950 THEN 1.0 END AS off,
  CASE WHEN p_brand <> 'Brand#1' THEN p_brand END AS code FROM part)
SELECT kind, id AS canonical FROM p QUALIFY row_number() OVER (PARTITION BY kind ORDER BY
  CASE WHEN mult = 1 AND coalesce(off, 0) = 0 THEN 0 ELSE 1 END, CASE WHEN code IS NOT NULL THEN 0 ELSE 1 END, length(id), id) = 1
""")
def canonical_unit_pick(spark, sf_dir):
    entries = load(spark, sf_dir, "part").select(
        F.col("p_type").alias("kind"), F.concat("p_name", "p_partkey").alias("id"), F.col("p_size").alias("multiplier"),
        F.when(F.col("p_retailprice") > 950, 1.0).alias("offset"),
        F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).alias("code"),
    )
    return units.canonical_pick(entries, "kind", "id", "multiplier", "offset", "code")


@query("alias_enrichment", f"""
WITH e AS (SELECT c_custkey, 'nation ' || c_nationkey AS label, c_mktsegment AS alias FROM customer),
n AS (SELECT 'N' || n_nationkey AS code, n_name AS name FROM nation)
SELECT c_custkey, label, list_aggregate(list_sort(list_distinct([alias, code, name])), 'string_agg', ',') AS aliases
FROM e JOIN n ON {sql_label("n.name")} = {sql_label("e.label")}
""")
def alias_enrichment(spark, sf_dir):
    entries = load(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("nation "), "c_nationkey").alias("label"), F.array("c_mktsegment").alias("aliases")
    )
    codes = load(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("name"))
    return units.enrich_aliases(entries, codes, "c_custkey", "label", "aliases").select(
        "c_custkey", "label", F.array_join("aliases", ",").alias("aliases")
    )


def sql_conversion(rows: str, seed: int, tries: int = 5) -> str:
    """CTEs res, chk and ok(table_id, attempt) of the relation ``rows`` (table_id, domain, from_unit, shown)."""
    return f"""tries AS (SELECT DISTINCT table_id, domain, from_unit, a.attempt FROM {rows}, (SELECT unnest(range({tries})) AS attempt) a),
tg AS (SELECT table_id, t.domain, attempt, surrogate, targets[CAST(floor({sql_uniform(seed, "convert-table", "table_id", "attempt")} * len(targets)) AS INTEGER) + 1] AS to_unit
  FROM tries t JOIN targets ON targets.domain = t.domain AND name = from_unit),
res AS (SELECT table_id, attempt, to_unit, f.e.factor AS f1, f.e."offset" AS o1, t.e.factor AS f2, t.e."offset" AS o2 FROM tg
  JOIN names f ON f.domain = tg.domain AND f.name = surrogate JOIN names t ON t.domain = tg.domain AND t.name = to_unit
  WHERE f.e.kind = t.e.kind AND f.e.factor IS NOT NULL AND t.e.factor IS NOT NULL),
chk AS (SELECT tab.table_id, attempt, min(d) AS worst, max(d) AS decimals FROM (
    SELECT tab.table_id, attempt, CASE WHEN TRY_CAST(shown AS DOUBLE) IS NOT NULL THEN {sql_roundtrip("TRY_CAST(shown AS DOUBLE)", "shown")} END AS d
    FROM {rows} tab JOIN res ON res.table_id = tab.table_id) tab GROUP BY ALL),
ok AS (SELECT table_id, min(attempt) AS attempt FROM chk WHERE worst >= 0 GROUP BY table_id)"""


@query("convert_table_units", f"""
WITH {SQL_MEASURED}, {SQL_TARGETS},
tab AS (SELECT event_id, user_id || '-' || from_unit AS table_id, domain, from_unit, shown FROM m),
{sql_conversion("tab", 35)}
SELECT event_id, tab.table_id, res.to_unit, chk.decimals, (TRY_CAST(shown AS DOUBLE) * f1 + o1 - o2) / f2 AS converted,
  CASE WHEN res.to_unit IS NULL THEN 'no target converts the table' END AS reason
FROM tab LEFT JOIN ok ON ok.table_id = tab.table_id LEFT JOIN res ON res.table_id = ok.table_id AND res.attempt = ok.attempt
LEFT JOIN chk ON chk.table_id = ok.table_id AND chk.attempt = ok.attempt
""")
def convert_table_units(spark, sf_dir):
    rows = measured(spark, sf_dir).select(
        "event_id", F.concat_ws("-", "user_id", "from_unit").alias("table_id"), "domain", "from_unit", "shown"
    )
    return units.convert_tables(rows, units.dimension(spark), "table_id", "shown", "from_unit", 35).select(
        "event_id", "table_id", "to_unit", "decimals", "converted", "reason"
    )


@query("conversion_direction", f"""
WITH {SQL_CONVERTED} SELECT from_unit, to_unit, count(*) FILTER (WHERE (value * f1 + o1 - o2) / f2 > value) AS going_up,
  count(*) AS conversions FROM r WHERE convertible GROUP BY ALL
""")
def conversion_direction(spark, sf_dir):
    resolved = units.lookup(measured(spark, sf_dir), units.dimension(spark)).filter("convertible")
    up = units.converted(F.col("value")) > F.col("value")
    return resolved.groupBy("from_unit", "to_unit").agg(
        F.count(F.when(up, 1)).alias("going_up"), F.count(F.lit(1)).alias("conversions")
    )

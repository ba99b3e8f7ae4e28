"""Row rules and rules between linked rows: audit, bounds, repair.

A row rule is ``(id, condition, consequence)`` in Spark SQL; the consequence of a bound rule is
``(column, operator, number)``.  Rules are literals of a plan: all of them are evaluated in one scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.sampling import uniform

QUOTED = re.compile(r"'[^']*'|\"[^\"]*\"")
WORD = re.compile(r"[A-Za-z_]\w*")


def columns_of(expression: str, columns: Sequence[str]) -> list[str]:
    """Columns an expression mentions, in order."""
    words = WORD.findall(QUOTED.sub(" ", expression))
    return [c for c in dict.fromkeys(words) if c in columns]


def upstream(rules: Sequence[tuple[str, str, str]], columns: Sequence[str]) -> dict[str, set[str]]:
    """Rules that can change the condition of each rule, directly or through others.

    Rule i feeds rule j if it writes a column j's condition reads.  The list of rules is part of the
    plan, so this runs while the plan is built.
    """
    reads = {r: set(columns_of(cond, columns)) for r, cond, _ in rules}
    writes = {r: set(columns_of(expr, columns)) for r, _, expr in rules}
    feeds = {j: {i for i in writes if i != j and writes[i] & reads[j]} for j in reads}
    grown = True
    while grown:
        grown = False
        for j, sources in feeds.items():
            more = set().union(*[feeds[i] for i in sources]) - sources if sources else set()
            if more:
                sources |= more
                grown = True
    return feeds


def matches(rules: Sequence[tuple[str, Column]], name: str = "rule_id") -> Column:
    """Array of the ids whose condition holds, for one explode."""
    flags = F.array(*[F.struct(F.lit(r).alias("id"), F.coalesce(cond, F.lit(False)).alias("hit")) for r, cond in rules])
    return F.transform(F.filter(flags, lambda f: f["hit"]), lambda f: f["id"]).alias(name)


def violations(df: DataFrame, row: Sequence[str], rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``(row, rule_id)`` where the condition holds and the consequence does not."""
    broken = [(r, F.expr(f"({cond}) AND NOT ({expr})")) for r, cond, expr in rules]
    return df.select(*row, F.explode(matches(broken)).alias("rule_id"))


def candidates(df: DataFrame, row: Sequence[str], rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``(row, rule_id)`` where the rule's condition holds or that of a rule that can trigger it."""
    feeds = upstream(rules, df.columns)
    conditions = {r: cond for r, cond, _ in rules}
    any_of = [
        (r, F.expr(" OR ".join(f"({conditions[i]})" for i in [r, *sorted(feeds[r])]))) for r in conditions
    ]
    return df.select(*row, F.explode(matches(any_of)).alias("rule_id"))


def bounds(df: DataFrame, rules: Sequence[tuple[str, str, str, float]], column: str, lo: float, hi: float) -> DataFrame:
    """Tightest bounds of ``column`` from its domain and the rules whose condition holds.

    ``rules`` are ``(id, condition, operator, limit)`` with ``>=`` or ``<=``.
    """
    lower, upper = [F.lit(lo)], [F.lit(hi)]
    for _, cond, op, limit in rules:
        side = lower if op == ">=" else upper
        side.append(F.when(F.expr(cond), F.lit(float(limit))))
    greatest = F.greatest(*lower) if len(lower) > 1 else lower[0]
    least = F.least(*upper) if len(upper) > 1 else upper[0]
    return df.withColumn(f"{column}_lo", greatest).withColumn(f"{column}_hi", least)


def linked_terms(df: DataFrame, key: Sequence[str], row: str, value: str, selectors: dict[str, Column]) -> DataFrame:
    """First row of every selector per key, as one aggregate: ``<name>_row`` and ``<name>_value``."""
    terms = []
    for name, selector in selectors.items():
        terms.append(F.min(F.when(selector, F.col(row))).alias(f"{name}_row"))
        terms.append(F.min_by(F.when(selector, F.col(value)), F.when(selector, F.col(row))).alias(f"{name}_value"))
    return df.groupBy(*key).agg(*terms)


def linked_violations(
    df: DataFrame, key: Sequence[str], row: str, value: str, selectors: dict[str, Column], rule: Column
) -> DataFrame:
    """Links of all terms of a rule that break it.

    Every row of the first selector is linked to the first row of the other ones; ``rule`` is an
    expression over ``<name>_value``.
    """
    first, *others = selectors
    terms = linked_terms(df, key, row, value, {n: selectors[n] for n in others})
    lefts = df.filter(selectors[first]).select(
        *key, F.col(row).alias(f"{first}_row"), F.col(value).alias(f"{first}_value")
    )
    links = lefts.join(terms.dropna(subset=[f"{n}_row" for n in others]), list(key))
    return links.filter(~rule)


def repair_chain(
    df: DataFrame,
    key: Sequence[str],
    row: str,
    selector: str,
    steps: Sequence,
    lower: str,
    upper: str,
    seed: int,
) -> DataFrame:
    """New values with value(step 1) >= value(step 2) >= ... inside the bounds of each row.

    The first row of a step per key takes part, further ones are ambiguous and dropped.  A row whose
    bounds cannot meet those of the steps around it is dropped as unsatisfiable.  The number of steps
    is fixed by the rules, so a chain is one aggregated row and needs no ordered group.  Bounds and
    values are integers (cents).
    """
    entry = F.struct(F.col(row).alias("row"), F.col(lower).alias("lo"), F.col(upper).alias("hi"))
    chains = df.groupBy(*key).agg(
        *[F.min_by(F.when(F.col(selector) == s, entry), F.when(F.col(selector) == s, F.col(row))).alias(f"s{i}")
          for i, s in enumerate(steps)]
    )
    n = len(steps)
    los = [F.col(f"s{i}.lo") for i in range(n)]
    his = [F.col(f"s{i}.hi") for i in range(n)]
    out, above = [], F.lit(None).cast("long")
    tight_lo = [F.greatest(*los[i:], F.lit(None)) for i in range(n)]
    tight_hi = [F.least(*his[: i + 1], F.lit(None)) for i in range(n)]
    for i in range(n):
        chains = chains.withColumn(f"_ok{i}", F.col(f"s{i}").isNotNull() & (tight_lo[i] <= tight_hi[i]))
        top = F.least(tight_hi[i], above)
        u = uniform(seed, "repair", F.col(f"s{i}.row"))
        drawn = tight_lo[i] + F.floor(u * (top - tight_lo[i] + 1))
        chains = chains.withColumn(f"_v{i}", F.when(F.col(f"_ok{i}"), F.least(drawn, top)))
        above = F.coalesce(F.col(f"_v{i}"), above)
        out.append(
            F.struct(
                F.col(f"s{i}.row").alias("row"),
                F.lit(i + 1).alias("step"),
                F.col(f"_v{i}").alias("value"),
                F.when(F.col(f"_ok{i}"), "kept").otherwise("unsatisfiable").alias("state"),
            )
        )
    return (
        chains.select(*key, F.explode(F.array(*out)).alias("c"))
        .select(*key, "c.*")
        .filter(F.col("row").isNotNull())
        .withColumnRenamed("row", row)
    )

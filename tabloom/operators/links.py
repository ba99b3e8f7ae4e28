"""Linear rules between rows: links of any number of terms, tightest bounds, and a redraw that meets them.

A rule is a sum of terms compared with a constant. A term is a row selector with a whole coefficient; it stands for the
value of the first row that the selector picks among the rows that agree in all other columns. Every row of the first
selector makes a link of its own.

Values and bounds are integers (cents, say). Everything that changes is a table of rows (variables); a round joins it to
the terms of the links, whose sums are taken over the few terms of a link, and aggregates what the links say per row. So
neither a long chain of links nor a row in a million links is ever one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.arrays import let
from tabloom.functions.sampling import digest, uniform
from tabloom.operators import parts
from tabloom.operators.rules import columns_of
from tabloom.session import materialise


#: Rows that agree in the key of all rules, up to which one task holds them together.
MOST_TOGETHER = 100_000


class LinearRule(NamedTuple):
    """sum(coefficient * first value of selector) OP constant, with OP one of <= >= < > =."""

    id: str
    terms: tuple[tuple[str, int], ...]
    op: str
    constant: int

    def limits(self) -> tuple[int | None, int | None]:
        """Least and greatest sum of whole values."""
        c = self.constant
        return {"<=": (None, c), "<": (None, c - 1), ">=": (c, None), ">": (c + 1, None), "=": (c, c)}[self.op]


def selector_columns(rule: LinearRule, columns: Sequence[str]) -> list[str]:
    """Columns that the selectors of a rule read; all selectors must read the same ones."""
    read = [columns_of(selector, columns) for selector, _ in rule.terms]
    if any(set(r) != set(read[0]) for r in read):
        raise ValueError(f"rule {rule.id}: its selectors read different columns")
    if not read[0]:
        raise ValueError(f"rule {rule.id}: its selectors read no column")
    return read[0]


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)], F.lit(True))


def first_matches(df: DataFrame, rule: LinearRule, row: str, key: Sequence[str]) -> DataFrame:
    """The rows that some term picks, each with the first match of every further term among the rows of its key.

    ``_t0, _t1, ...`` tell the terms that pick the row, ``_f1, ...`` are the first matches; keys compare null-safe. One
    aggregate finds all first matches. Only keys with a row of the first term are kept.
    """
    picks = [F.coalesce(F.expr(selector), F.lit(False)).alias(f"_t{i}") for i, (selector, _) in enumerate(rule.terms)]
    marked = df.select(F.col(row).alias("_row"), *key, *picks).filter(" or ".join(f"_t{i}" for i in range(len(picks))))
    firsts = marked.groupBy(*key).agg(
        F.bool_or("_t0").alias("_wanted"), *[F.min(F.when(F.col(f"_t{i}"), F.col("_row"))).alias(f"_f{i}") for i in range(1, len(picks))]
    )
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    firsts = firsts.filter("_wanted").select(*named, *[f"_f{i}" for i in range(1, len(picks))])
    return marked.join(firsts, _same(key, [f"_k{i}" for i in range(len(key))]))


def ambiguous_rows(matched: DataFrame, rule: LinearRule) -> DataFrame:
    """Further matches of a term, where all terms before it have one: nobody can tell which row the rule means."""
    found: Column = F.lit(False)
    reached: Column = F.lit(True)
    for i in range(1, len(rule.terms)):
        found = found | (reached & F.col(f"_t{i}") & (F.col("_row") != F.col(f"_f{i}")))
        reached = reached & F.col(f"_f{i}").isNotNull()
    return matched.filter(found).select("_row")


def _rows_one_by_one(df: DataFrame, rules: Sequence[LinearRule], row: str, keys: Sequence[Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """Links and ambiguous rows, rule by rule: first matches are joined to rows, ambiguous rows leave by their name."""
    links, removed = [], []
    alive = df
    for rule, key in zip(rules, keys, strict=True):
        gone = materialise(ambiguous_rows(first_matches(alive, rule, row, key), rule), "ambiguous")
        removed.append(gone.select(F.col("_row").alias(row), F.lit(rule.id).alias("rule_id")))
        alive = alive.join(gone, F.col(row) == F.col("_row"), "left_anti")
        others = [f"_f{i}" for i in range(1, len(rule.terms))]
        whole = first_matches(alive, rule, row, key).filter("_t0").dropna(subset=others)
        part = F.xxhash64(*[c for c in key if all(c in k for k in keys)], F.lit(0)).alias("part")
        links.append(whole.select(F.lit(rule.id).alias("rule_id"), F.array("_row", *others).alias("rows"), part))
    return materialise(reduce(DataFrame.unionByName, links), "links"), reduce(DataFrame.unionByName, removed)


def _rows_by_key(picked: DataFrame, rules: Sequence[LinearRule], row: str, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The same for rules that share their key, of keys whose rows fit a task: one shuffle for all rules."""
    whole = Window.partitionBy(*key)
    told = picked.withColumn("_alive", F.lit(True)).withColumn("_gone", F.lit(None).cast("string"))
    links = []
    for n, rule in enumerate(rules):
        picks = [F.col(f"_p{n}").bitwiseAND(1 << i) != 0 for i in range(len(rule.terms))]

        def firsts(picks=picks):
            return {f"_f{i}": F.min(F.when(F.col("_alive") & t, F.col("_row"))).over(whole) for i, t in enumerate(picks) if i}

        told = told.withColumns({"_wanted": F.bool_or(F.col("_alive") & picks[0]).over(whole), **firsts()})
        odd: Column = F.lit(False)
        reached: Column = F.lit(True)
        for i in range(1, len(picks)):
            odd = odd | (reached & picks[i] & (F.col("_row") != F.col(f"_f{i}")))
            reached = reached & F.col(f"_f{i}").isNotNull()
        told = told.withColumn("_odd", F.col("_alive") & F.col("_wanted") & F.coalesce(odd, F.lit(False)))
        told = told.withColumn("_gone", F.when(F.col("_odd"), rule.id).otherwise(F.col("_gone"))).withColumn("_alive", F.col("_alive") & ~F.col("_odd"))
        told = told.withColumns(firsts())
        others = [F.col(f"_f{i}") for i in range(1, len(picks))]
        linked = reduce(lambda a, b: a & b, [f.isNotNull() for f in others], F.col("_alive") & picks[0])
        told = told.withColumn(f"_l{n}", F.when(linked, F.struct(F.lit(rule.id).alias("rule_id"), F.array("_row", *others).alias("rows"))))
        told = told.drop("_wanted", "_odd", *[f"_f{i}" for i in range(1, len(picks))])
        links.append(f"_l{n}")
    found = F.filter(F.array(*links), lambda x: x.isNotNull()).alias("links")
    told = told.select("_row", "_gone", F.xxhash64(*key, F.lit(0)).alias("part"), found)
    told = materialise(told.where("_gone is not null or size(links) > 0"), "links")
    return (
        told.select("part", F.explode("links").alias("l")).select("l.rule_id", "l.rows", "part"),
        told.where("_gone is not null").select(F.col("_row").alias(row), F.col("_gone").alias("rule_id")),
    )


def linked_parts(
    df: DataFrame, rules: Sequence[LinearRule], row: str, value: str, ignore: Sequence[str] = (), most: int = MOST_TOGETHER
) -> tuple[DataFrame, DataFrame]:
    """``link_rows``, with a ``part`` for every link: a digest of the columns in which all rows that links connect agree."""
    keys = [[c for c in df.columns if c not in {row, value, *ignore, *selector_columns(r, df.columns)}] for r in rules]
    if any(k != keys[0] for k in keys) or not keys[0]:
        return _rows_one_by_one(df, rules, row, keys)
    masks = {
        f"_p{n}": reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(s), 1 << i).otherwise(0).cast("long") for i, (s, _) in enumerate(r.terms)])
        for n, r in enumerate(rules)
    }
    key = [f"_k{i}" for i in range(len(keys[0]))]
    picked = df.select(F.col(row).alias("_row"), *[F.col(c).alias(k) for c, k in zip(keys[0], key, strict=True)], *[m.alias(n) for n, m in masks.items()])
    picked = picked.where(" or ".join(f"{n} <> 0" for n in masks))
    # rows leave by name: names that stand for different rows, and keys of very many rows, take the way of the joins
    same = F.xxhash64(*key, *masks)
    twice = picked.where("_row is not null").groupBy(F.xxhash64("_row").alias("_id")).agg(F.min(same).alias("_a"), F.max(same).alias("_b"))
    twice = materialise(twice.where("_a <> _b").select("_id"), "names-of-several")
    crowded = picked.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*key)
    apart = materialise(crowded, "crowded-keys")
    if not twice.isEmpty():
        apart = apart.unionByName(picked.withColumn("_id", F.xxhash64("_row")).join(twice, "_id", "left_semi").select(*key)).distinct()
    if apart.isEmpty():
        return _rows_by_key(picked, rules, row, key)
    apart = materialise(apart.select(*[F.col(k).alias(f"_o{k}") for k in key]), "keys-apart")
    others = [f"_o{k}" for k in key]
    usual = _rows_by_key(picked.join(apart, _same(key, others), "left_anti"), rules, row, key)
    odd = _rows_one_by_one(df.join(apart, _same(keys[0], others), "left_semi"), rules, row, keys)
    return usual[0].unionByName(odd[0]), usual[1].unionByName(odd[1])


def link_rows(
    df: DataFrame, rules: Sequence[LinearRule], row: str, value: str, ignore: Sequence[str] = (), most: int = MOST_TOGETHER
) -> tuple[DataFrame, DataFrame]:
    """``(rule_id, rows)`` links, rows in the order of the terms, and ``(row, rule_id)`` ambiguous rows.

    Rows link if they agree in all columns but the row key, the value, the selectors' and the ignored ones. Ambiguous
    rows of a rule leave the table before its links are made and before the next rule is read. If all rules have the same
    key, the rows of a key meet once, unless they are more than ``most``.
    """
    links, removed = linked_parts(df, rules, row, value, ignore, most)
    return links.drop("part"), removed


def _per_rule(rules: Sequence[LinearRule]) -> tuple[Column, Column, Column]:
    """Coefficients, least and greatest sum of the rule ``rule_id``."""

    def chosen(values: dict) -> Column:
        return reduce(lambda a, r: F.when(F.col("rule_id") == r, values[r]).otherwise(a), values, F.lit(None))

    coefs = chosen({r.id: F.array(*[F.lit(c).cast("long") for _, c in r.terms]) for r in rules})
    low, high = (chosen({r.id: F.lit(r.limits()[i]).cast("long") for r in rules}) for i in (0, 1))
    return coefs, low, high


def _terms(links: DataFrame, rules: Sequence[LinearRule]) -> DataFrame:
    """(link, row, pos, coef, low, high): one row per term of a link; ``low`` and ``high`` bound the link's sum."""
    coefs, low, high = _per_rule(rules)
    link = F.concat_ws("|", "rule_id", F.col("rows")[0].cast("string"))
    rows = links.select(link.alias("link"), low.alias("low"), high.alias("high"), coefs.alias("coefs"), F.posexplode("rows").alias("pos", "row"))
    return rows.select("link", "row", "pos", F.col("coefs")[F.col("pos")].alias("coef"), "low", "high")


def _said(terms: DataFrame, variables: DataFrame) -> DataFrame:
    """What each link says about each of its rows: ``to_lo``, ``to_hi``, and ``broken`` if it cannot hold at all.

    ``least`` and ``most`` are the extremes of the link's sum; a row may take what the others leave. Links with a row
    that is no longer alive say nothing.
    """
    own = terms.join(variables, "row")
    own = own.withColumn("own_least", F.expr("coef * if(coef > 0, lo, hi)")).withColumn("own_most", F.expr("coef * if(coef > 0, hi, lo)"))
    own = own.selectExpr(
        "*",
        "sum(own_least) over (partition by link) as least",
        "sum(own_most) over (partition by link) as most",
        "bool_and(alive) over (partition by link) as active",
    )
    own = own.withColumn("broken", F.expr("active and (coalesce(least > high, false) or coalesce(most < low, false))"))
    own = own.withColumn("top", F.expr("if(active and not broken, high - least + own_least, null)"))
    own = own.withColumn("bottom", F.expr("if(active and not broken, low - most + own_most, null)"))
    # a div b rounds to zero, so whole quotients are taken after the remainder is off: floor(a / b) = (a - pmod(a, b)) div b
    size = "abs(coef)"

    def floored(x: str) -> str:
        return f"(({x}) - pmod({x}, {size})) div {size}"

    return own.withColumn("to_hi", F.expr(f"if(coef > 0, {floored('top')}, {floored('-bottom')})")).withColumn(
        "to_lo", F.expr(f"if(coef > 0, -({floored('-bottom')}), -({floored('top')}))")
    )


def tightened(terms: DataFrame, variables: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Bounds of all rows after the links have been applied until nothing changes: ``(row, lo, hi, alive, ...)``.

    A link that cannot hold takes its first row out of the table, a row whose bounds have crossed leaves by itself; both
    are no longer ``alive``. All links of a round see the bounds of the round before, so the result does not depend on
    any order. Should bounds still move after ``most_rounds`` (links that chase each other around a cycle), the rows that
    moved last leave as well.
    """
    rest = [c for c in variables.columns if c not in ("row", "lo", "hi", "alive")]
    for turn in range(most_rounds):
        said = _said(terms, variables).groupBy("row").agg(
            F.max("to_lo").alias("to_lo"), F.min("to_hi").alias("to_hi"), F.bool_or(F.expr("broken and pos = 0")).alias("out")
        )
        lo, hi = F.greatest("lo", "to_lo"), F.least("hi", "to_hi")
        both = variables.join(said, "row", "left").select(
            "row",
            F.when(F.col("alive"), lo).otherwise(F.col("lo")).alias("lo"),
            F.when(F.col("alive"), hi).otherwise(F.col("hi")).alias("hi"),
            (F.col("alive") & ~F.coalesce("out", F.lit(False)) & (lo <= hi)).alias("alive"),
            *rest,
            (F.col("alive") & (F.coalesce("out", F.lit(False)) | (lo != F.col("lo")) | (hi != F.col("hi")))).alias("moved"),
        )
        variables = materialise(both, "bounds")
        if variables.filter("moved").isEmpty():
            break
        if turn == most_rounds - 1:
            variables = variables.withColumn("alive", F.col("alive") & ~F.col("moved"))
        variables = variables.drop("moved")
    return variables.select("row", "lo", "hi", "alive", *rest)


def _rooted(terms: DataFrame, variables: DataFrame) -> DataFrame:
    """``variables`` with ``root``: true for one undecided row of each set of rows that links still connect."""
    labels = variables.withColumn("label", F.when(F.col("alive") & F.col("value").isNull(), F.col("place")))
    while True:
        linked = terms.select("link", "row").join(labels.select("row", "alive", "value", "label"), "row")
        linked = linked.selectExpr("*", "bool_and(alive) over (partition by link) as active")
        least = F.expr("min(if(value is null, label, null)) over (partition by link)")
        near = linked.withColumn("least", F.when(F.col("active"), least)).groupBy("row").agg(F.min("least").alias("least"))
        new = labels.join(near, "row", "left").withColumn("new", F.when(F.col("label").isNotNull(), F.least("label", "least")))
        new = materialise(new.withColumn("moved", F.col("new") != F.col("label")).drop("label", "least").withColumnRenamed("new", "label"), "labels")
        if new.filter("moved").isEmpty():
            return new.withColumn("root", F.col("label") == F.col("place")).drop("label", "moved")
        labels = new.drop("moved")


def drawn(terms: DataFrame, variables: DataFrame, seed: int) -> DataFrame:
    """``variables`` with a ``value`` for every row that is alive, drawn within what the links leave at its turn.

    One row of each connected set starts; then every link that holds a decided row has the most linked of its other rows
    decided next, while all other links of that row agree that it is its turn. In a set without cycles no two rows of a
    turn can disturb each other, so every link holds at the end. Around a cycle a row may be left without a value; it is
    then no longer alive and its links are void.
    """
    degree = terms.groupBy("row").agg(F.count(F.lit(1)).alias("degree"))
    place = F.struct((-F.coalesce("degree", F.lit(0))).alias("degree"), digest(seed, "turn", "row").alias("digest"))
    variables = variables.join(degree, "row", "left").withColumn("place", place).drop("degree")
    variables = variables.withColumn("value", F.lit(None).cast("long"))
    u = uniform(seed, "linear", "row")
    while True:
        variables = _rooted(terms, variables)
        turn = F.col("root")
        while True:
            said = _said(terms, variables).selectExpr(
                "*",
                "active and bool_or(value is not null) over (partition by link) as touched",
                "min(if(value is null, place, null)) over (partition by link) as next",
            )
            said = said.groupBy("row").agg(
                F.max("to_lo").alias("to_lo"),
                F.min("to_hi").alias("to_hi"),
                F.bool_or("touched").alias("touched"),
                F.bool_and(F.expr("not touched or place = next")).alias("agreed"),
            )
            both = variables.join(said, "row", "left")
            both = both.withColumn("now", F.coalesce(F.col("alive") & F.col("value").isNull() & turn, F.lit(False)))
            both = both.withColumn("new_lo", F.greatest("lo", "to_lo")).withColumn("new_hi", F.least("hi", "to_hi"))
            both = both.withColumn("fits", F.col("new_lo") <= F.col("new_hi"))
            pick = F.least(F.col("new_lo") + F.floor(u * (F.col("new_hi") - F.col("new_lo") + 1)), F.col("new_hi"))
            value = F.when(F.col("now") & F.col("fits"), pick).otherwise(F.col("value"))
            after = both.select(
                "row",
                F.coalesce(value, "lo").alias("lo"),
                F.coalesce(value, "hi").alias("hi"),
                (F.col("alive") & ~(F.col("now") & ~F.col("fits"))).alias("alive"),
                *[c for c in variables.columns if c not in ("row", "lo", "hi", "alive", "value")],
                value.alias("value"),
                "now",
            )
            after = materialise(after, "values")
            variables = after.drop("now")
            if after.filter("now").isEmpty():
                break
            turn = F.coalesce(F.col("touched") & F.col("agreed"), F.lit(False))
        variables = variables.drop("root")
        if variables.filter("alive and value is null").isEmpty():
            return variables.drop("place")


def unmet(terms: DataFrame, variables: DataFrame) -> DataFrame:
    """(link, row of its first term) of links whose rows all have values that break it."""
    sums = terms.join(variables.filter("alive").select("row", "value"), "row", "left").groupBy("link", "low", "high")
    sums = sums.agg(
        F.sum(F.col("coef") * F.col("value")).alias("total"),
        F.bool_and(F.col("value").isNotNull()).alias("whole"),
        F.min_by("row", "pos").alias("row"),
    )
    return sums.filter("whole and (coalesce(total < low, false) or coalesce(total > high, false))").select("link", "row")


def _solved_parts(links: DataFrame, variables: DataFrame, rules: Sequence[LinearRule], seed: int) -> DataFrame:
    """(part, done, rows): the repaired rows of each part, worked out where the part lies; not ``done`` if that takes long."""
    coefs, low, high = _per_rule(rules)
    listed = links.select("part", F.struct("rows", coefs.alias("coefs"), low.alias("low"), high.alias("high")).alias("l")).groupBy("part").agg(F.collect_list("l").alias("_links"))
    held = variables.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("row", "lo", "hi", "alive"))).alias("_vars"))
    both = held.join(listed, "part")
    # each step is an explode of one: what it makes is worked out once
    names = F.transform("_vars", lambda v: v["row"])
    own = (F.size(F.array_distinct(names)) == F.size("_vars")).alias("own")
    both = both.select("part", "_vars", own, F.explode(F.array(let(names, lambda rows: parts.numbered(rows, F.col("_links"))))).alias("_links"))
    both = both.select("part", "own", "_links", F.explode(F.array(parts.started(F.col("_vars"), F.col("_links"), seed))).alias("_state"))
    tight = F.when(F.col("own"), parts.tightened(F.col("_state"), F.col("_links"))).otherwise(F.col("_state"))
    both = both.select("part", "own", "_links", F.explode(F.array(tight)).alias("_tight"))
    ready = ~F.exists("_tight", lambda v: v["moved"])
    value = F.when(ready, parts.drawn(F.col("_tight"), F.col("_links"))).otherwise(F.col("_tight"))
    both = both.select("part", (F.col("own") & ready).alias("ready"), "_links", "_tight", F.explode(F.array(value)).alias("_drawn"))
    done = F.col("ready") & ~F.exists("_drawn", lambda v: v["alive"] & v["value"].isNull())

    def row(v: Column, i: Column, broken: Column) -> Column:
        value = F.get("_drawn", i)["value"]
        state = F.when(~v["alive"], "unsatisfiable").when(value.isNull() | F.array_contains(broken, i), "undecided").otherwise("kept")
        return let(state, lambda s: F.struct(v["row"].alias("row"), v["lo"].alias("lo"), v["hi"].alias("hi"), F.when(s == "kept", value).alias("value"), s.alias("state")))

    rows = let(parts.unmet(F.col("_drawn"), F.col("_links")), lambda broken: F.transform("_tight", lambda v, i: row(v, i, broken)))
    return both.select("part", done.alias("done"), rows.alias("rows"))


def _solved_by_rounds(links: DataFrame, variables: DataFrame, rules: Sequence[LinearRule], seed: int) -> DataFrame:
    """(row, lo, hi, value, state) of linked rows, by rounds over tables."""
    terms = materialise(_terms(links, rules), "terms")
    bounded = tightened(terms, variables)
    found = drawn(terms, bounded, seed)
    broken = unmet(terms, found).select("row").distinct().withColumn("broken", F.lit(True))
    found = found.select("row", "value").join(broken, "row", "left")
    state = F.when(~F.col("alive"), "unsatisfiable").when(F.col("value").isNull() | F.col("broken"), "undecided").otherwise("kept")
    chained = bounded.join(found, "row").withColumn("state", state)
    return chained.select("row", "lo", "hi", F.when(F.col("state") == "kept", F.col("value")).alias("value"), "state")


def _solved(links: DataFrame, variables: DataFrame, rules: Sequence[LinearRule], seed: int, most: int) -> DataFrame:
    """``_solved_by_rounds``, of parts of at most ``most`` links without it: they share no row, so each is solved by itself."""
    apart = links.groupBy("part").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select("part")
    twice = materialise(variables.filter("shared").select("row"), "rows-of-several")
    if not twice.isEmpty():
        ends = links.select("part", F.explode("rows").alias("row"))
        apart = apart.unionByName(ends.join(twice, "row", "left_semi").select("part")).distinct()
    apart = materialise(apart, "parts-apart")
    usual = (links, variables) if apart.isEmpty() else (links.join(apart, "part", "left_anti"), variables.join(apart, "part", "left_anti"))
    solved = materialise(_solved_parts(*usual, rules, seed), "solved")
    apart = materialise(apart.unionByName(solved.filter("not done").select("part")), "parts-left")
    found = solved.filter("done").select(F.explode("rows").alias("r")).select("r.*")
    if apart.isEmpty():
        return found
    left = (links.join(apart, "part", "left_semi"), variables.join(apart, "part", "left_semi").select("row", "lo", "hi", "alive"))
    return found.unionByName(_solved_by_rounds(*left, rules, seed))


def repair(
    df: DataFrame, rules: Sequence[LinearRule], row: str, value: str, lower: str, upper: str, seed: int, ignore: Sequence[str] = (),
    most: int = parts.MOST_LINKS, linked: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(row, lo, hi, value, state): a value for every row such that its bounds and all rules hold.

    ``lo`` and ``hi`` are the bounds that the rules leave. Linked rows are drawn anew; a row that no link holds keeps its
    value if its bounds allow it. Rows that cannot stay have no value and a reason: ``ambiguous`` (a rule could mean it
    or an earlier row), ``unsatisfiable`` (bounds crossed, or first row of a link that cannot hold), ``undecided`` (a
    cycle of links left no value). The remaining rows meet every rule. Parts of more than ``most`` links, and parts that
    share a row, take rounds over tables. ``linked`` is what ``linked_parts`` has found, if the caller needs it as well.
    """
    links, removed = linked or linked_parts(df, rules, row, value, [*ignore, lower, upper])
    removed = removed.select(F.col(row).alias("row")).distinct()
    start = df.select(F.col(row).alias("row"), F.col(lower).alias("lo"), F.col(upper).alias("hi"), F.col(value).alias("old"))
    start = start.join(removed, "row", "left_anti").withColumn("alive", F.coalesce(F.col("lo") <= F.col("hi"), F.lit(False)))
    ends = links.select("part", F.explode("rows").alias("row")).groupBy("row").agg(F.min("part").alias("part"), F.max("part").alias("_last"))
    linked = ends.select("row", "part", (F.col("part") != F.col("_last")).alias("shared"), F.lit(True).alias("linked"))
    start = materialise(start.join(linked, "row", "left"), "variables")
    chained = _solved(links, start.filter("linked").drop("linked", "old"), rules, seed, most)
    u = uniform(seed, "linear", "row")
    kept = F.when(F.col("old").between(F.col("lo"), F.col("hi")), F.col("old")).otherwise(
        F.least(F.col("lo") + F.floor(u * (F.col("hi") - F.col("lo") + 1)), F.col("hi"))
    )
    alone = start.filter("linked is null").select(
        "row", "lo", "hi", F.when(F.col("alive"), kept).alias("value"), F.when(F.col("alive"), "kept").otherwise("unsatisfiable").alias("state")
    )
    none = F.lit(None).cast("long")
    lost = removed.select("row", none.alias("lo"), none.alias("hi"), none.alias("value"), F.lit("ambiguous").alias("state"))
    return chained.unionByName(alone).unionByName(lost).withColumnRenamed("row", row)

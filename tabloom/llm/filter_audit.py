"""How filters of a corpus interact: what each removes in every order, and its share by Shapley values.

Every document fails some set of the filters. The failing sets are counted per part of the corpus (a table of at most 32
rows a part), and the removals of all 32 coalitions are tabulated from it. The effect of a filter behind others is a
difference of two coalitions; the Shapley values are the least squares fit of additive effects to all coalitions under
the Shapley kernel, constrained to add up, solved once in rationals because its matrix is the same for every part.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain_text, table
from .registry import query

FILTERS = "ABCDE"
#: Bit of the filter that looks at other documents.
COPY = 16
WORD_GAP = r"[\x20\x09-\x0D]+"


def solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X of matrix * X = right, by elimination in exact rationals."""
    rows = [[*a, *b] for a, b in zip(matrix, right, strict=True)]
    for i in range(len(rows)):
        pivot = next(r for r in range(i, len(rows)) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(len(rows)):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    return [row[len(matrix) :] for row in rows]


def shapley_weights(n: int) -> list[list[Fraction]]:
    """Per filter, the factors of the 2^n coalition values that give its Shapley value.

    Effects phi minimise sum w(S) (v(S) - sum of phi in S)^2 over the proper coalitions, w(S) being the Shapley kernel,
    under sum phi = v(all). With a multiplier for the constraint that is a linear system of n + 1 equations.
    """
    coalitions = range(1, 2**n - 1)
    size = int.bit_count
    weight = {s: Fraction(n - 1, comb(n, size(s)) * size(s) * (n - size(s))) for s in coalitions}
    normal = [[sum((weight[s] for s in coalitions if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(n)] for i in range(n)]
    system = [[*row, Fraction(1)] for row in normal] + [[Fraction(1)] * n + [Fraction(0)]]
    right = [[weight.get(s, Fraction(0)) if s >> i & 1 else Fraction(0) for s in range(2**n)] for i in range(n)]
    right.append([Fraction(int(s == 2**n - 1)) for s in range(2**n)])
    return solved(system, right)[:n]


def failures() -> Column:
    """Bits of the filters A to D that a document's whole text fails."""
    text = F.col("text")
    n, upper = F.size("words"), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    marks = [
        n < 200,
        100 * F.size(F.array_distinct("words")) < 50 * n,
        100 * upper > 3 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]
    return reduce(lambda a, b: a + b, [F.when(mark, 1 << i).otherwise(0) for i, mark in enumerate(marks)])


def failing_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): documents by language and by the set of filters that they fail.

    Equal texts fail A to D alike, so copies are counted per digest before anything looks at their ids; a text that a
    third of all documents share is then a few rows. Of the rows of one text only those of its smallest id pass E.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text("lang").alias("part"), plain_text().alias("text"))
    words = text.withColumn("words", F.array_remove(F.split("text", WORD_GAP), ""))
    rows = words.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failures().alias("bits"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    )
    known = rows.join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"])
    kind = ["digest", "part", "bits", "good", "toxic"]
    ids = known.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    texts = ids.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_without_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    least = F.expr("min(first.doc_id) OVER (PARTITION BY digest)")
    alone = F.col("n_without_id") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = texts.withColumn("least", least).withColumn("alone", alone)
    both = F.explode(
        F.array(
            F.struct(F.col("bits").alias("fails"), F.col("alone").alias("n")),
            F.struct((F.col("bits") + COPY).alias("fails"), (F.col("n") - F.col("alone")).alias("n")),
        )
    )
    counted = split.select("part", "good", "toxic", both.alias("row")).select("part", "good", "toxic", "row.*")
    return counted.groupBy("part", "fails").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def coalition_removals(sets: DataFrame, filters: int) -> DataFrame:
    """(part, total, v): v[S] = struct(n, good, toxic) of the documents that the filters of coalition S remove together."""
    spread = sets.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(2**filters - 1))))
    hit = F.col("fails").bitwiseAND(F.col("coalition")) != 0
    sums = spread.groupBy("part", "coalition").agg(
        F.sum("n").alias("total"), *[F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")]
    )
    return sums.groupBy("part").agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("coalition", "n", "good", "toxic"))).alias("v")
    )


def shapley_sums(filters: int) -> Column:
    """Array of each filter's Shapley value times the number of orders: whole numbers, as is every marginal count."""
    orders = factorial(filters)
    sums = []
    for row in shapley_weights(filters):
        factors = [x * orders for x in row]
        assert all(x.denominator == 1 for x in factors)
        terms = [F.lit(int(x)).cast("long") * F.col("v")[s]["n"] for s, x in enumerate(factors) if x]
        sums.append(reduce(lambda a, b: a + b, terms))
    return F.array(*sums)


def step_counts(removals: DataFrame, filters: str) -> DataFrame:
    """One row per part, order of the filters and step, as differences of coalition values."""
    everyone = 2 ** len(filters) - 1
    orders = F.explode(F.lit(["".join(p) for p in permutations(filters)]))
    rows = removals.withColumn("shares", shapley_sums(len(filters))).withColumn("filter_order", orders)
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    at = F.instr(F.lit(filters), F.expr("substring(filter_order, step, 1)")) - 1
    before = [F.when(F.instr("filter_order", f) < F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(filters)]
    rows = rows.withColumn("at", at).withColumn("before", reduce(lambda a, b: a + b, before)).withColumn("bit", F.expr("shiftleft(1, at)"))

    def value(coalition: Column, name: str = "n") -> Column:
        return F.get(F.col("v"), coalition).getField(name)

    first, after = F.col("before"), F.col("before") + F.col("bit")
    removed = value(after) - value(first)
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - value(after)).alias("kept"),
        removed.alias("removed"),
        (value(F.col("bit")) - removed).alias("redundant"),
        (value(F.lit(everyone)) - value(F.lit(everyone) - F.col("bit"))).alias("unique_fails"),
        (value(after, "good") - value(first, "good")).alias("good_lost"),
        (value(after, "toxic") - value(first, "toxic")).alias("toxic_lost"),
        F.get(F.col("shares"), F.col("at")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters, 600 rows per language.

    Null texts and languages are empty ones. A row without id never fails E and makes no other row fail it; repeated rows
    count one by one. A document labelled twice is good, or toxic, if any of its labels says so; one without labels is
    neither. Further columns are not read. An empty table gives no rows.
    """
    sets = failing_sets(docs, labels)
    return step_counts(coalition_removals(sets, len(FILTERS)), FILTERS)


OP12_SQL = r"""
WITH marks AS (
  SELECT doc_id, max(coalesce(quality = 1, false)::int) AS good, max(coalesce(toxic = 1, false)::int) AS toxic
  FROM labels GROUP BY doc_id),
texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
flags AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
                100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
                coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM texts LEFT JOIN marks USING (doc_id)),
sets AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL),
f AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5])::int AS step FROM orders),
hits AS (
  SELECT part, o, step, o[step] AS f, n, good, toxic, fails[o[step]] AS fails_here,
         len(list_filter(o[1:step - 1], lambda x: fails[x])) > 0 AS gone,
         len(list_filter(fails, lambda x: x)) AS n_fails
  FROM sets, steps),
counts AS (
  SELECT part, o, step, f, sum(CASE WHEN NOT gone AND NOT fails_here THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT gone AND fails_here THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND fails_here THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails_here AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND fails_here THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT gone AND fails_here THEN toxic ELSE 0 END) AS toxic_lost
  FROM hits GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, step, kept::bigint AS kept,
       removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
       good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::bigint AS shapley
FROM counts
"""


@query("op12_filter_interactions", OP12_SQL)
def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter audit of all documents."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

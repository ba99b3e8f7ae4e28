"""Quality rules whose cutoffs are proven to spare good documents.

Five rules compare a statistic with a cutoff from a fixed ladder, lenient to strict. Labelled documents are the holdout:
per stratum (language) and rung, the exact binomial tail of the good documents that the rung rejects tests whether its
rate of false rejections could be ``alpha / rules``. A ladder is climbed until the first test fails (its rungs are nested,
so that sequence needs no further correction); the level of each test is divided by strata and rules (Bonferroni). So with
probability 1 - ``delta`` no stratum loses more than a share ``alpha`` of its good documents, whatever rungs are taken.
Among the proven rungs the one that parts bad from good best is taken.

All of it is DataFrame code: array functions for the statistics, aggregates and one expression for the tail.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain_text, table, written
from .registry import query

ALPHA, DELTA = 0.1, 0.05
#: A lost good document weighs as much as this many missed bad ones (as shares of either) when a proven rung is chosen.
COST = 10
WINDOW = 5
SPACE = " \t\n\x0b\f\r"

#: Rule: (numerator, denominator, sign, rungs). It rejects where sign * 1000 * numerator > sign * rung * denominator.
RULES: dict[str, tuple[str, str, int, list[int]]] = {
    "symbols": ("n_symbols", "n_words", 1, [2000, 1000, 700, 500, 300, 200, 150, 100, 70, 50, 30, 20]),
    "dup_lines": ("n_dup_lines", "n_lines", 1, [900, 800, 700, 600, 500, 400, 300, 200, 150, 100, 50]),
    "repeat_words": ("n_repeat_words", "n_words", 1, [190, 170, 150, 120, 100, 80, 60, 40, 20]),
    "long_words": ("word_chars", "n_words", 1, [20000, 15000, 12000, 10000, 9000, 8000, 7500, 7000, 6500, 6000]),
    "short_words": ("word_chars", "n_words", -1, [1500, 2000, 2500, 3000, 3500, 4000, 4500]),
}


def bound_as(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside windows of ``size`` words that occur twice or more in the text, first occurrences included.

    Windows are compared by hash first; where all hashes differ, so do the windows. Otherwise the windows themselves
    (words joined by a blank, which no word holds) are sorted, so the count never rests on a hash.
    """

    def covered(keyed: Column) -> Column:
        def same(i: Column, j: Column) -> Column:
            return F.get(keyed, i)["w"] == F.get(keyed, j)["w"]

        places = F.filter(
            F.sequence(F.lit(0), F.size(keyed) - 1),
            lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)),
        )
        starts = F.array_sort(F.transform(places, lambda i: F.get(keyed, i)["at"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last"))
        step = F.aggregate(
            starts, start, lambda s, at: F.struct((s["n"] + F.least(F.lit(size), at - s["last"])).alias("n"), at.alias("last"))
        )
        return step["n"]

    last = F.size(words) - size
    hashes = bound_as(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)])),
    )
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + k) for k in range(size)]).alias("w"), i.alias("at")),
    )
    alike = bound_as(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    none = F.lit(0).cast("long")
    return F.when(last < 0, none).when(alike, bound_as(F.array_sort(windows), covered)).otherwise(none)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed) per row."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text("lang").alias("stratum"), plain_text().alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    parts = text.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).withColumn("lines", lines)
    counted = parts.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def rejects(rule: str, rung: Column) -> Column:
    over, under, sign, _ = RULES[rule]
    return F.lit(1000 * sign) * F.col(over) > F.lit(sign) * rung * F.col(under)


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 10, taken back to n; exact to the last digits of a double."""
    x = n.cast("double") + 10
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return series - reduce(lambda a, b: a + b, [F.ln(n.cast("double") + k) for k in range(1, 11)])


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), given k <= n p.

    Terms are added from k downwards, each from the one before. Below k the terms fall like a normal density of
    deviation sqrt(n p), so those farther than nine of them away are under the precision of the sum.
    """
    terms = F.least(k.cast("double"), 9 * F.sqrt(n * p) + 60).cast("int")
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        at = k - i + 1  # the term of at - 1 successes, from that of at
        term = s["term"] * at * odds / (n - at + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    more = F.when(terms > 0, F.sequence(F.lit(1), F.greatest(terms, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.exp(first) * F.aggregate(more, start, add)["sum"]


def cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, rung, ...): the cutoff of each rule in each stratum that has a proven one that helps.

    The holdout is every labelled document that passes the base rules, once per row. One labelled twice is good if any of
    its labels says so; labels that are neither 0 nor 1 are not read.
    """
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    held = stats.where(~F.col("base_failed")).join(marks.agg(F.max("quality").alias("good")), "doc_id")
    steps = [
        F.struct(
            F.lit(rule).alias("rule"),
            # rungs are nested: the first that rejects is told by the number that do not
            reduce(lambda a, b: a + b, [F.when(rejects(rule, F.lit(c)), 0).otherwise(1) for c in rungs]).alias("spared"),
        )
        for rule, (_, _, _, rungs) in RULES.items()
    ]
    hit = held.select("stratum", "good", F.explode(F.array(*steps)).alias("s")).select("stratum", "good", "s.*")
    hit = hit.groupBy("stratum", "rule", "spared").agg(
        F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good") == 1, 0).otherwise(1)).alias("bad")
    )
    per = hit.groupBy("stratum", "rule").agg(
        F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"), F.collect_list(F.struct("spared", "good", "bad")).alias("hits")
    )
    ladder = reduce(
        lambda a, rule: F.when(F.col("rule") == rule, F.lit(RULES[rule][3])).otherwise(a), RULES, F.array().cast("array<int>")
    )

    def upto(name: str) -> Column:
        caught = F.filter("hits", lambda h: h["spared"] <= F.col("at"))
        return F.aggregate(caught, F.lit(0).cast("long"), lambda a, h: a + h[name])

    per = written(per, "rule-hits")
    strata = per.select("stratum").distinct().count()
    rungs = per.select("*", F.posexplode(ladder).alias("at", "rung"))
    rungs = rungs.withColumn("false_rejections", upto("good")).withColumn("true_rejections", upto("bad")).drop("hits")
    rungs = written(rungs, "rule-rungs")  # a few rows; their counts stand in the tail's expression dozens of times
    each, level = alpha / len(RULES), delta / (len(RULES) * max(strata, 1))
    n, k = F.col("n_good"), F.col("false_rejections")
    tail = F.when((n > 0) & (k <= n * each), binomial_tail(k, n, each)).otherwise(1.0)
    # share of bad caught less COST times the share of good lost, over a common denominator
    gain = F.col("true_rejections").cast("decimal(18,0)") * n - COST * k.cast("decimal(18,0)") * F.col("n_bad")
    proven = rungs.withColumn("tail", tail).withColumn("gain", gain).where((F.col("tail") <= level) & (F.col("gain") > 0))
    found = ["rung", "n_good", "false_rejections", "n_bad", "true_rejections", "tail"]
    best = F.max_by(F.struct(*found), F.struct("gain", -F.col("at")))
    return proven.groupBy("stratum", "rule").agg(best.alias("best")).select("stratum", "rule", "best.*")


def verdicts(stats: DataFrame, chosen: DataFrame, broadcast_strata: int = 100_000) -> DataFrame:
    """``stats`` with ``kept``: false where the base rules or a chosen cutoff of the document's stratum reject it.

    Up to ``broadcast_strata`` strata their cutoffs are broadcast; beyond, both sides are shuffled.
    """
    wide = written(chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("rung"))).alias(f"cut_{r}") for r in RULES]), "cutoffs")
    wide = F.broadcast(wide) if wide.count() <= broadcast_strata else wide
    rejected = [F.coalesce(rejects(r, F.col(f"cut_{r}")), F.lit(False)) for r in RULES]
    kept = ~F.col("base_failed") & ~reduce(lambda a, b: a | b, rejected)
    return stats.join(wide, "stratum", "left").withColumn("kept", kept)


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Statistics and verdict of every row of ``docs``.

    Null texts hold no word and fail the base rules; a null language is the stratum ''. Without labels (or with too few
    for a proof) nothing but the base rules rejects. Repeated rows count and are judged one by one. Further columns are
    not read. An empty table gives no rows. Copies of a text in the holdout are counted as independent documents.
    """
    stats = written(measured(docs), "rule-statistics")
    return verdicts(stats, cutoffs(stats, labels, alpha, delta))


def _sql() -> str:
    ladders = ", ".join(f"('{r}', {i}, {c})" for r, (_, _, _, rungs) in RULES.items() for i, c in enumerate(rungs))
    rejected = " ".join(f"WHEN '{r}' THEN {g} * 1000 * {o} > {g} * rung * {u}" for r, (o, u, g, _) in RULES.items())
    each = ALPHA / len(RULES)
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT row, i, w[i:i + 4] AS g FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM docs)),
twice AS (SELECT row, unnest(list(i)) AS i FROM windows GROUP BY row, g HAVING count(*) > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY row),
lines AS (SELECT row, unnest(string_split(t, chr(10))) AS line FROM docs),
line_counts AS (
  SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
stats AS (
  SELECT doc_id, stratum, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed
  FROM docs LEFT JOIN covered USING (row) LEFT JOIN line_counts USING (row)),
ladder AS (SELECT * FROM (VALUES {ladders}) v(rule, place, rung)),
marks AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
tested AS (
  SELECT stratum, rule, place, rung, sum(good) AS n, sum(1 - good) AS m, sum(CASE WHEN hit THEN good ELSE 0 END) AS k,
         sum(CASE WHEN hit THEN 1 - good ELSE 0 END) AS caught
  FROM (SELECT *, CASE rule {rejected} END AS hit FROM stats JOIN marks USING (doc_id), ladder WHERE NOT base_failed)
  GROUP BY ALL),
proven AS (
  SELECT *, caught * n - {COST} * k * m AS gain FROM tested
  WHERE n > 0 AND k <= n * {each} AND list_sum(list_transform(range(0, k::bigint + 1), lambda i:
      exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({each}) + (n - i) * ln(1 - {each}))))
    <= {DELTA} / ({len(RULES)} * (SELECT count(DISTINCT stratum) FROM tested))),
chosen AS (
  SELECT stratum, rule, rung FROM proven WHERE gain > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, place) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (
         SELECT 1 FROM chosen c WHERE c.stratum = s.stratum AND CASE rule {rejected} END) AS kept
FROM stats s
"""


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


@query("op13_quality_rules", _sql())
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdicts of all documents."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(*RESULT)

"""Document quality by a sparse ensemble of rules.

Statistics of the text are column expressions. Trees grown on a bounded sample of their values give rules, the paths
from the root; a lasso logistic regression keeps few of them; the kept ones become one Spark expression again, so all
documents are scored without Python.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, labelled, plain_text, table
from .registry import query

PER_CLASS = 4000
TREES, DEPTH = 40, 3


def statistics() -> dict[str, Column]:
    """What the rules look at; every value is defined for an empty text."""
    text = plain_text()
    size = F.length(text).cast("double")

    def count(chars: str) -> Column:
        return size - F.length(F.translate(text, chars, "")).cast("double")

    spaces, lines = count(" \t"), count("\n")
    words = F.greatest(spaces + lines + 1, F.lit(1.0))
    some = F.greatest(size, F.lit(1.0))
    digits, upper = count("0123456789"), count("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return {
        "log_size": F.log1p(size),
        "word_size": size / words,
        "line_size": size / (lines + 1),
        "log_lines": F.log1p(lines),
        "digits": digits / some,
        "upper": upper / words,
        "stops": count(".!?") / words,
        "commas": count(",;:") / words,
        "bars": count("|") / words,
        "signs": count("#$%&*") / words,
        "brackets": count("<>{}[]()=_/\\@~^`") / words,
        "quotes": count("\"'") / words,
        "wide": (F.octet_length(text).cast("double") - size) / some,
        "spaces": spaces / some,
    }


def _split(x: np.ndarray, residual: np.ndarray, least: int) -> tuple[int, float] | None:
    """Feature and threshold whose halves differ most in the residual."""
    best, choice = 1e-9, None
    n = len(residual)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, left = x[order, f], np.cumsum(residual[order])
        k = np.arange(1, n)
        gain = left[:-1] ** 2 / k + (left[-1] - left[:-1]) ** 2 / (n - k) - left[-1] ** 2 / n
        gain[(values[1:] == values[:-1]) | (k < least) | (n - k < least)] = 0
        i = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[i] > best:
            best, choice = gain[i], (f, float((values[i] + values[i + 1]) / 2))
    return choice


Rule = tuple[tuple[int, bool, float], ...]


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[Rule]:
    """Paths of boosted trees on random halves of rows and features: conjunctions of (feature, above, threshold)."""
    random = np.random.default_rng(seed)
    score = np.full(len(y), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[Rule, None] = {}

    def grow(rows: np.ndarray, columns: np.ndarray, residual: np.ndarray, path: Rule) -> None:
        if path:
            rules[tuple(sorted(path))] = None
        cut = _split(x[np.ix_(rows, columns)], residual[rows], max(10, len(y) // 200)) if len(path) < depth and len(rows) > 40 else None
        if cut is None:
            mean = residual[rows].mean()
            where = matches(x, path)
            score[where] += 0.3 * np.clip(mean * 4, -2, 2)
            return
        f, t = int(columns[cut[0]]), cut[1]
        above = x[rows, f] > t
        grow(rows[above], columns, residual, (*path, (f, True, t)))
        grow(rows[~above], columns, residual, (*path, (f, False, t)))

    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-score))
        rows = random.choice(len(y), max(1, len(y) // 2), replace=False)
        grow(rows, random.choice(x.shape[1], max(1, 2 * x.shape[1] // 3), replace=False), residual, ())
    return list(rules)


def matches(x: np.ndarray, rule: Rule) -> np.ndarray:
    found = np.ones(len(x), bool)
    for f, above, t in rule:
        found &= (x[:, f] > t) == above
    return found


def lasso(z: np.ndarray, y: np.ndarray, strength: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1 logistic regression, by accelerated proximal gradient steps."""
    n, k = z.shape
    w, v, b, c, t = np.zeros(k), np.zeros(k), 0.0, 0.0, 1.0
    step = 4 / (np.linalg.norm(z, 2) ** 2 / n + 1) if k else 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - step * (z.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * strength, 0)
        intercept = c - step * error.mean()
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / after * (new - w), intercept + (t - 1) / after * (intercept - b)
        w, b, t = new, intercept, after
    return w, b


def fit(x: np.ndarray, y: np.ndarray, rate: float) -> tuple[list[tuple[Rule, float]], float]:
    """Rules with their weights, and an intercept shifted so that scores match the share ``rate`` of label 1."""
    if len(set(y)) < 2:
        mean = min(max(y.mean() if len(y) else rate, 1e-3), 1 - 1e-3)
        return [], math.log(mean / (1 - mean))
    rules = grow_rules(x, y)
    z = np.array([matches(x, r) for r in rules], float).T if rules else np.zeros((len(y), 0))
    w, b = lasso(z, y, 0.002)
    share = min(max(rate, 1e-3), 1 - 1e-3)
    b += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    return [(r, float(a)) for r, a in zip(rules, w, strict=True) if abs(a) > 1e-4], float(b)


def compiled(rules: list[tuple[Rule, float]], intercept: float, columns: list[str]) -> Column:
    """The ensemble as an expression over the columns of the statistics."""

    def holds(rule: Rule) -> Column:
        tests = [F.col(columns[f]) > t if above else F.col(columns[f]) <= t for f, above, t in rule]
        return reduce(lambda a, b: a & b, tests)

    terms = [F.when(holds(rule), F.lit(w)).otherwise(0.0) for rule, w in rules]
    while len(terms) > 1:  # a balanced tree, so that the expression stays shallow
        terms = [reduce(lambda a, b: a + b, terms[i : i + 8]) for i in range(0, len(terms), 8)]
    return 1 / (1 + F.exp(-((terms[0] if terms else F.lit(0.0)) + F.lit(intercept))))


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Rules and weights come from at most ``per_class`` documents of either label in the training folds; the share of
    label 1 counts all labels there. Null and empty texts are scored as such. Without labels of both kinds every score
    is the share of label 1 (one half if there are none). An empty table gives no rows.
    """
    names = statistics()
    train = fold(modulus) != held_out
    rate = labels.where(train & F.col("quality").isNotNull()).agg(F.avg("quality")).first()[0]
    sample = labelled(docs.select("doc_id", "text"), labels, "quality", train, per_class)
    seen = sample.select("label", *[c.alias(n) for n, c in names.items()]).toPandas()
    seen = seen.sort_values(list(seen.columns), kind="stable")
    rules, intercept = fit(seen[list(names)].to_numpy(float), seen["label"].to_numpy(float), 0.5 if rate is None else float(rate))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(n) for n, c in names.items()])
    scored = rows.select("doc_id", (fold(modulus) == held_out).alias("held_out"), compiled(rules, intercept, list(names)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Toxicity of deobfuscated text.

A noisy channel hides words behind look-alike symbols (``1d10t``), repeated letters and spaced letters. Marked tokens
become a lattice of the letters that may have been meant; a Viterbi search under a character trigram model of the whole
corpus picks the likeliest reading, and only restored words are scored. A token without any mark of the channel has a
lattice of one path, itself.
"""

from __future__ import annotations

import heapq
import io
import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    Bounded, by_batch, decide, fold, free_name, labelled, lean, on_worker, plain_text, remove, ship, shipped, slices, sums, table, words_of, written,
)
from .registry import query

#: Symbols written for letters.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "i", "|": "il", "+": "t", "€": "e",
}
#: Costs in nats of what the channel does.
SWAP, REPEAT, DROP, ODD = 1.0, 0.7, 0.5, 6.0
BEAM = 12
SEPARATORS = ".-_*~'·"
#: Letters below U+0250 have classes of their own; class 0 is everything that parts words, class 1 other letters.
_LETTERS = [chr(c) for c in range(0x250) if chr(c).isalpha() and chr(c).lower() == chr(c)]
ALPHABET = {c: i + 2 for i, c in enumerate(_LETTERS)}
SIZE = len(_LETTERS) + 2
_CLASS = np.zeros(0x110000, np.int64)
_CLASS[0x250:] = [int(chr(c).isalpha()) for c in range(0x250, 0x110000)]
for _c, _i in ALPHABET.items():
    _CLASS[ord(_c)] = _i
#: Kinds of word parts that the classifier knows: lengths of beginnings.
STEMS = (3, 4, 5, 6)
MARKED = re.compile(r"[^\W\d_][\d@$!|+€]|[\d@$!|+€][^\W\d_]|(\w)\1\1|[^\W\d_][.\-_*~'·][^\W\d_](?:[.\-_*~'·]|$)")
TRIPLE = re.compile(r"(.)\1\1")
PARTING = re.compile(r"[\W\d_]+")
EDGES = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, int] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            text = "  ".join(part.column("text").to_pylist()).lower()
            codes = _CLASS[np.frombuffer(f"  {text}  ".encode("utf-32-le", "replace"), np.uint32)]
            found, n = np.unique((codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:], return_counts=True)
            for k, v in zip(found.tolist(), n.tolist(), strict=True):
                counts[k] = counts.get(k, 0) + v
    if counts:
        yield pa.record_batch({"gram": pa.array(list(counts), pa.int64()), "n": pa.array(counts.values(), pa.int64())})


class Speller:
    """Reads marked tokens under a character trigram model."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.known = dict(zip(grams.tolist(), counts.tolist(), strict=True))
        self.context: dict[int, int] = {}
        for g, n in self.known.items():
            self.context[g // SIZE] = self.context.get(g // SIZE, 0) + n
        self.cost: dict[int, float] = {}

    def _price(self, context: int, c: int) -> float:
        key = context * SIZE + c
        if key not in self.cost:
            self.cost[key] = -math.log((self.known.get(key, 0) + 0.1) / (self.context.get(context, 0) + 0.1 * 60))
        return self.cost[key]

    def read(self, token: str) -> str:
        """The likeliest letters behind a token; linear in its length, since runs of a symbol count as three at most."""
        token = re.sub(r"(.)\1{3,}", r"\1\1\1", token)
        states: dict[tuple[int, str], tuple[float, tuple]] = {(0, ""): (0.0, ())}
        for seen in token:
            after: dict[tuple[int, str], tuple[float, tuple]] = {}
            options = [(x, SWAP) for x in LOOKALIKES.get(seen, "")]
            if seen in ALPHABET or seen.isalpha():
                options.append((seen, 0.0))
            for (context, last), (cost, path) in states.items():
                moves = [(c, cost + extra) for c, extra in options]
                if seen in SEPARATORS or seen == " ":
                    _keep(after, (context, last), cost + DROP, path)
                    moves.append((" ", cost))
                elif not options:
                    moves.append((" ", cost + ODD))
                for c, base in moves:
                    k = ALPHABET.get(c, int(c != " "))
                    _keep(after, ((context % SIZE) * SIZE + k, c), base + self._price(context, k), (path, c))
                    if c == last:
                        _keep(after, (context, last), base + REPEAT, path)
            states = after if len(after) <= BEAM else dict(heapq.nsmallest(BEAM, after.items(), key=lambda s: s[1][0]))
        ends = ((cost + self._price(context, 0), path) for (context, _), (cost, path) in states.items())
        path = min(ends, key=lambda e: e[0])[1]
        letters = []
        while path:
            path, c = path
            letters.append(c)
        return "".join(reversed(letters)).strip()


def _keep(states: dict, state: tuple[int, str], cost: float, path: tuple) -> None:
    if state not in states or cost < states[state][0]:
        states[state] = (cost, path)


def parts(word: str) -> list[str]:
    """What the classifier sees of a word: itself and its beginnings."""
    return [f"={word}", *[f"^{word[:n]}" for n in STEMS if len(word) >= n]]


class Restored:
    """Reads tokens as words; readings of marked tokens are kept in a bounded cache."""

    def __init__(self, speller: Speller):
        self.speller = speller
        self.read = Bounded(lambda token: tuple(w for w in speller.read(token).split() if w))

    def words(self, token: str) -> tuple[str, ...]:
        if token.isalpha() and not TRIPLE.search(token):
            return (token,)
        if not MARKED.search(token) and " " not in token:
            return tuple(w for w in PARTING.split(token) if w)
        return self.read[token]


class Scores(Bounded):
    """token -> strongest evidence among the parts of its restored words."""

    def __init__(self, restored: Restored, weights: dict[str, float]):
        super().__init__(self.strongest, 32 << 20)
        self.restored, self.weights = restored, weights

    def strongest(self, token: str) -> float:
        return max((self.weights.get(p, 0.0) for w in self.restored.words(token) for p in parts(w)), default=0.0)


def is_single(token: str) -> bool:
    return len(token) == 1 or len(token.strip(EDGES)) == 1


def spaced(tokens: list[str]) -> Iterator[str]:
    """Runs of at least three single symbols, which may be one word written with spaces."""
    for single, run in itertools.groupby(tokens, key=is_single):
        if single and len(run := list(run)) >= 3:
            yield " ".join(run)


def evidence(texts: pa.Array, scores: Scores) -> np.ndarray:
    """Per text: strongest evidence of a word, and the logarithms of one plus its sum and its count."""
    codes, bounds, distinct = words_of(pa.compute.utf8_lower(texts), pa.compute.utf8_split_whitespace)
    distinct = distinct.to_pylist()
    values = np.fromiter((scores[t] for t in distinct), np.float64, len(distinct))[codes] if distinct else np.zeros(0)
    single = np.fromiter(map(is_single, distinct), bool, len(distinct))[codes] if distinct else np.zeros(0, bool)
    run = np.flatnonzero(single[:-2] & single[1:-1] & single[2:]) if len(single) > 2 else np.zeros(0, np.int64)
    found = np.zeros((len(texts), 3))
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        found[full, 0] = np.maximum.reduceat(values, bounds[:-1][full])
    found[:, 1] = sums(values, bounds)
    found[:, 2] = sums((values > 0).astype(np.float64), bounds)
    for i in np.unique(np.searchsorted(bounds, run, "right") - 1):
        for token in spaced([distinct[c] for c in codes[bounds[i] : bounds[i + 1]]]):
            if value := scores[token]:
                found[i] = max(found[i, 0], value), found[i, 1] + value, found[i, 2] + 1
    found[:, 1:] = np.log1p(np.maximum(found[:, 1:], 0.0))
    return found


def _part_counts(speller_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored = on_worker(("restored", speller_file), lambda: Restored(load_speller(speller_file)))
        counts = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                tokens = text.lower().split()
                distinct = {*tokens, *spaced(tokens)}
                counts[label].update({p for token in distinct for w in restored.words(token) for p in parts(w)})
        for label in (0, 1):
            names = list(counts[label])
            for start in range(0, len(names), 50_000):
                some = names[start : start + 50_000]
                n = [counts[label][p] for p in some]
                yield pa.record_batch(
                    {"part": pa.array(some, pa.string()), "label": pa.array([label] * len(n), pa.int32()), "n": pa.array(n, pa.int64())}
                )

    return run


def load_speller(name: str) -> Speller:
    rows = np.load(shipped(name))
    return Speller(rows[0], rows[1])


def _bytes_of(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def train_speller(docs: DataFrame) -> str:
    """Character trigram counts over all texts, shipped to the executors; at most SIZE**3 of them exist."""
    sums = (
        docs.select(plain_text().alias("text"))
        .mapInArrow(lean(_trigrams), "gram long, n long")
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    rows = np.array([sums["gram"].to_numpy(np.int64), sums["n"].to_numpy(np.int64)])
    return ship(docs.sparkSession, "trigrams", _bytes_of(rows))


def train_weights(sample: DataFrame, speller_file: str, least_gain: float = 16.0, most: int = 50_000) -> dict[str, float]:
    """Log odds of the word parts that point to label 1 with a likelihood ratio of at least ``least_gain``.

    ``sample`` is a bounded set of labelled documents; ``most`` bounds the model, not the corpus.
    """
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = totals.get(1, 0), totals.get(0, 0)
    if not ones or not zeros:
        return {}
    p, share = F.col("ones"), ones / (ones + zeros)
    both = p + F.col("zeros")

    def gain(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    odds = F.log((p + 0.5) / (ones + 1.0)) - F.log((F.col("zeros") + 0.5) / (zeros + 1.0))
    found = (
        sample.select(plain_text().alias("text"), "label")
        .mapInArrow(lean(_part_counts(speller_file)), "part string, label int, n long")
        .groupBy("part")
        .agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("ones"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("zeros"))
        .select("part", odds.alias("odds"), (2 * (gain(p, both * share) + gain(F.col("zeros"), both * (1 - share)))).alias("gain"))
        .where((F.col("gain") >= least_gain) & (F.col("odds") > 1.0))
        .orderBy(F.desc("gain"), "part")
        .limit(most)
    )
    return {r["part"]: r["odds"] for r in found.collect()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _evidence_of(speller_file: str, weights: tuple):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = evidence(batch.column("text"), _scores(speller_file, weights))
        return pa.record_batch({"label": batch.column("label")} | {f"e{i}": pa.array(found[:, i]) for i in range(3)})

    return by_batch(fn)


def _scores(speller_file: str, weights: tuple) -> Scores:
    """Tables and caches of this worker for one job."""
    key, values = weights
    return on_worker(("scores", key), lambda: Scores(Restored(load_speller(speller_file)), values.value))


def train(docs: DataFrame, labels: DataFrame, rows: Column, per_class: int = 6000) -> Callable:
    """A function that scores some texts on a worker, for ``decide``; learned from labels where ``rows`` holds.

    From at most ``per_class`` documents of either label: word parts from one half of them, the weights of the
    document's evidence from the other, so that evidence is never judged on the texts it was found in. The character
    model counts all texts. With labels of one kind only, or none, every score is the share of label 1 (0 if none).
    """
    spark = docs.sparkSession
    speller_file = train_speller(docs)
    sample = labelled(docs.select("doc_id", "text"), labels, "toxic", rows, per_class)
    sample = written(sample.select("doc_id", "label", plain_text().alias("text")), "toxic-sample")
    half = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(2))
    weights = (speller_file, spark.sparkContext.broadcast(train_weights(sample.where(half == 0), speller_file)))
    seen = (
        sample.where(half == 1)
        .select("label", "text")
        .mapInArrow(_evidence_of(speller_file, weights), "label int, e0 double, e1 double, e2 double")
        .toPandas()
    )
    remove(sample)
    y = seen["label"].to_numpy(np.float64)
    if len(set(y)) == 2:
        w = logistic(seen[["e0", "e1", "e2"]].to_numpy(np.float64), y)
    else:
        rate = min(max(y.mean() if len(y) else 0.0, 1e-9), 1 - 1e-9)
        w = np.array([0.0, 0.0, 0.0, math.log(rate / (1 - rate))])

    def make():
        scores = _scores(speller_file, weights)
        return lambda texts: pa.array(1 / (1 + np.exp(-np.clip(evidence(texts, scores) @ w[:3] + w[3], -30, 30))))

    return make


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, per_class: int = 6000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Labels are learned from the training folds only, see ``train``. Null and empty texts have no evidence and get the
    score of such documents. An empty table gives no rows.
    """
    make = train(docs, labels, fold(modulus) != held_out, per_class)
    found = decide(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "score", "double")
    held = (fold(modulus) == held_out).alias("held_out")
    return found.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that score below 0.5."""
    name = free_name(docs, "toxicity_found")
    return decide(docs, train(docs, labels, fold(5) != 0), name, "double").where(F.col(name) < 0.5).drop(name)


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

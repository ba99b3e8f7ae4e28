"""Language identification by mixture inference.

Each language has counts of letter n-grams (bytes, hashed). A document is a mixture: expectation maximisation over its
words estimates the share of every language, and the set of languages is the one of largest penalised likelihood.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import decide, fold, free_name, lean, on_worker, plain_text, ship, shipped, slices, table
from .registry import query

N = 4
#: Hashed n-grams of a language: 2 ** BITS.
BITS = 16
ROUNDS = 12
TINY = np.float32(1e-30)
#: ASCII bytes that are no letters become spaces; bytes of other letters stay.
_BLANK = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams that end in a letter, their places in the joined texts, and the bounds of the texts there."""
    raw = [t.lower().encode().translate(_BLANK) for t in texts]
    joined = np.frombuffer(b"    " + b"    ".join(raw), np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = N + np.cumsum(sizes + N) - sizes - N
    code = np.zeros(len(joined) - N + 1, np.uint32)
    for i in range(N):
        code = code << np.uint32(8) | joined[i : len(joined) - N + 1 + i]
    # What stands before the word does not count.
    for i in range(N - 1, 0, -1):
        gap = joined[i - 1 : len(joined) - N + i] == 0x20
        code[gap] &= np.uint32((1 << 8 * (N - i)) - 1)
    places = np.flatnonzero(joined[N - 1 :] != 0x20)
    hashed = (code[places] * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    places = places + N - 1
    return hashed, places, np.searchsorted(places, np.append(starts, len(joined)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            langs = part.column("lang").to_pylist()
            texts = part.column("text").to_pylist()
            for lang in set(langs):
                hashed, _, _ = _grams([t for t, x in zip(texts, langs, strict=True) if x == lang])
                held.setdefault(lang, np.zeros(1 << BITS, np.int64))
                held[lang] += np.bincount(hashed, minlength=1 << BITS)
    for lang, n in held.items():
        some = np.flatnonzero(n)
        yield pa.record_batch({"lang": pa.array([lang] * len(some), pa.string()), "gram": pa.array(some), "n": pa.array(n[some])})


class Languages:
    """Log likelihoods of n-grams, one column for each language."""

    def __init__(self, names: list[str], logs: np.ndarray):
        self.names, self.logs = names, logs

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each word in each language, and the bounds of the texts among the words."""
        hashed, places, bounds = _grams(texts)
        if not len(places):
            return np.zeros((0, len(self.names)), np.float32), np.zeros(len(texts) + 1, np.int64)
        first = np.ones(len(places), bool)
        first[1:] = np.diff(places) > 1
        starts = np.flatnonzero(first)
        likely = np.add.reduceat(self.logs[hashed], starts, axis=0)
        return likely, np.searchsorted(starts, bounds)

    def infer(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the main language of each text and its share; -1 and 0 for texts without a letter.

        A text's set of languages grows by their shares in the mixture of all, as long as each further language improves
        its penalised likelihood.
        """
        likely, bounds = self.words(texts)
        n = np.diff(bounds)
        lead = np.full(len(texts), -1)
        share = np.zeros(len(texts))
        live = np.flatnonzero(n > 0)
        if not len(live) or not self.names:
            return lead, share
        columns = np.ascontiguousarray(likely.T)
        top = columns.max(0)
        odds = np.exp(columns - top)
        starts, size = bounds[:-1][live], n[live]
        base = np.add.reduceat(top, starts, dtype=np.float64)

        def shares(weights: np.ndarray, rounds: int) -> np.ndarray:
            for _ in range(rounds):
                part = odds * np.repeat(weights, size, axis=1)
                part /= np.maximum(part.sum(0), TINY)
                new = np.add.reduceat(part, starts, axis=1) / size
                moved = np.abs(new - weights).max()
                weights = new.astype(np.float32)
                if moved < 1e-3:
                    break
            return weights

        full = shares(np.full((len(self.names), len(live)), 1 / len(self.names), np.float32), ROUNDS)
        order = np.argsort(-full, axis=0, kind="stable")
        best = np.full(len(live), -np.inf)
        growing = np.ones(len(live), bool)
        for m in range(1, len(self.names) + 1):
            inside = np.zeros_like(full, bool)
            np.put_along_axis(inside, order[:m], True, axis=0)
            weights = np.where(inside, np.maximum(full, np.float32(1e-6)), np.float32(0))
            weights /= weights.sum(0)
            if 1 < m < len(self.names):
                weights = shares(weights, 2)
            mixed = np.log(np.maximum((odds * np.repeat(weights, size, axis=1)).sum(0), TINY))
            value = base + np.add.reduceat(mixed, starts, dtype=np.float64) - 0.5 * (m - 1) * np.log(size + 1.0)
            growing &= value > best
            better = growing
            if not better.any():
                break
            best[better] = value[better]
            lead[live[better]] = weights[:, better].argmax(0)
            share[live[better]] = weights[:, better].max(0)
        return lead, np.clip(share, 0.0, 1.0)


def _model(file: str) -> Languages:
    def load() -> Languages:
        with np.load(shipped(file)) as arrays:
            return Languages(arrays["names"].tolist(), arrays["logs"])

    return on_worker(("languages", file), load)


def train(docs: DataFrame, rows: Column) -> str:
    """Counts of the n-grams of all labelled documents where ``rows`` holds, as a file on every executor."""
    known = docs.where(F.col("lang").isNotNull() & rows).select("lang", plain_text().alias("text"))
    found = known.mapInArrow(lean(_counts), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["lang"].unique())
    logs = np.zeros((1 << BITS, len(names)), np.float32)
    for i, name in enumerate(names):
        some = found[found["lang"] == name]
        n = np.full(1 << BITS, 0.05)
        n[some["gram"].to_numpy()] += some["n"].to_numpy()
        logs[:, i] = np.log(n / n.sum())
    out = io.BytesIO()
    np.savez(out, names=np.array(names, str), logs=logs)
    return ship(docs.sparkSession, "languages", out.getvalue())


def predict(docs: DataFrame, file: str, name: str = "language") -> DataFrame:
    """``docs`` with a struct (lang_pred, score)."""

    def make():
        model = _model(file)
        names = pa.array(["und", *model.names], pa.string())

        def of(texts: pa.Array) -> pa.Array:
            texts = texts.to_pylist()
            lead, share = model.infer(texts)
            for i, text in enumerate(texts):  # bytes beyond ASCII need not be letters
                if lead[i] >= 0 and not text.isascii() and not any(map(str.isalpha, text)):
                    lead[i], share[i] = -1, 0.0
            return pa.StructArray.from_arrays([names.take(pa.array(lead + 1)), pa.array(share)], ["lang_pred", "score"])

        return of

    return decide(docs, make, name, "struct<lang_pred:string,score:double>")


def identify(docs: DataFrame, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    Learned from text and non-null lang of the training folds only, all of them. ``score`` is the share of the
    predicted language in the document. Null texts, texts without a letter and, where nothing could be learned, all
    texts are ``und`` with score 0. An empty table gives no rows.
    """
    file = train(docs, fold(modulus) != held_out)
    found = predict(docs.select("doc_id", "text"), file)
    return found.select("doc_id", (fold(modulus) == held_out).alias("held_out"), "language.lang_pred", "language.score")


def keep_identified(docs: DataFrame, least_share: float = 0.3) -> DataFrame:
    """The documents, with all their columns, that have a language holding at least ``least_share`` of them."""
    name = free_name(docs, "language_found")
    found = predict(docs, train(docs, fold(5) != 0), name)
    return found.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= least_share)).drop(name)


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language of all documents."""
    return identify(table(spark, sf_dir, "documents"))

"""Benchmark decontamination: counted pairs of words as seeds, then local alignment.

A seed is a pair of words that stand side by side, or with one word between them, in a test item and in a document. The
threshold tells how many seeds within how many words an alignment must hold to reach it (see ``Seeds``); every passage
with so many is aligned with the item by Smith-Waterman, and no other can hold a match. So copies are found however they
are edited, and what one document gets does not hang on the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_ids, lean, on_worker, plain_text, ragged, slices, sums, table, words_of, written
from .registry import query

#: Words of test items whose seeds are shipped to the workers at once; a larger benchmark is taken in blocks.
BLOCK = 1_000_000
#: Seeds of some texts that are counted at once; a text with more is counted alone.
HITS = 4_000_000
#: Cells of a row of the alignment table.
CELLS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _digest(word: str) -> int:
    """64 bits for a word without the signs around it; 0 if nothing is left."""
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return xxhash.xxh64_intdigest(word[start:end].encode()) | 1 if end > start else 0


def word_digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words of all texts, lower-cased, one after another, and the bounds of the texts."""
    codes, bounds, distinct = words_of(pa.compute.utf8_lower(texts), pa.compute.utf8_split_whitespace)
    digests = np.fromiter(map(_digest, distinct.to_pylist()), np.uint64, len(distinct))
    values = digests[codes] if len(distinct) else np.zeros(0, np.uint64)
    kept = values != 0
    return values[kept], np.concatenate([[0], np.cumsum(sums(kept.astype(np.int64), bounds))])


def pair_digests(words: np.ndarray, step: int) -> np.ndarray:
    """Digest of each word and the one ``step`` places on; of the word alone for step 0."""
    first, second = words[: max(len(words) - step, 0)], words[step:] if step else np.uint64(0)
    total = first * _MIX[0]
    total = ((total ^ (total >> np.uint64(29))) + second) * _MIX[1]
    return total ^ (total >> np.uint64(31))


class Seeds:
    """Pairs of words of some test items, and how many of them a passage must hold.

    An alignment of k matches and e edits scores 2 k - e (see MATCH, MISMATCH and GAP), and must reach ``need``. Between
    two matches that are more than two words apart, in item or passage, lie at least two edits; so at most
    k - need / 2 of its k - 1 steps from match to match are such, and at least need / 2 - 1 others are seeds, each at a
    place of its own. It takes up at most k + e <= 3 k - need words. Where one match will do, each word is a seed.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], threshold: float):
        self.items = items
        sizes = np.array([len(words) for _, words in items])
        need = np.array([math.ceil(MATCH * threshold * n - 1e-9) for n in sizes.tolist()])
        self.least, self.span = np.maximum((need + 1) // 2 - 1, 1), 3 * sizes - need
        self.steps, grams, owners = set(), [], []
        for k, (_, words) in enumerate(items):
            steps = (1, 2) if need[k] > 2 else (0,)
            self.steps.update(steps)
            grams.append(np.unique(np.concatenate([pair_digests(words, step) for step in steps])))
            owners.append(np.full(len(grams[-1]), k))
        grams, owners = np.concatenate(grams), np.concatenate(owners)
        order = np.argsort(grams, kind="stable")
        self.grams, first = np.unique(grams[order], return_index=True)
        self.owners, self.bounds = owners[order], np.append(first, len(grams))

    def _hits(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, text and number of the seeds in some texts, ordered by place."""
        found = []
        for step in self.steps:
            digests = pair_digests(words, step)
            at = np.minimum(np.searchsorted(self.grams, digests), len(self.grams) - 1)
            places = np.flatnonzero(self.grams[at] == digests)
            text = np.searchsorted(bounds, places, "right") - 1
            inside = places + step < bounds[text + 1]
            found.append((places[inside], text[inside], at[places[inside]]))
        places, text, gram = (np.concatenate(column) for column in zip(*found, strict=True))
        order = np.argsort(places, kind="stable")
        return places[order], text[order], gram[order]

    def passages(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(texts, items, starts, ends) of the passages to be aligned."""
        places, text, gram = self._hits(words, bounds)
        if not len(places):
            return
        held = self.bounds[gram + 1] - self.bounds[gram]
        before = np.concatenate([[0], np.cumsum(held)])
        ends = np.append(np.flatnonzero(np.diff(text)) + 1, len(text))  # of the hits of each text
        start = 0
        while start < len(text):
            end = int(ends[max(np.searchsorted(before[ends], before[start] + HITS, "right") - 1, np.searchsorted(ends, start, "right"))])
            yield self._counted(places[start:end], text[start:end], gram[start:end], held[start:end], bounds)
            start = end

    def _counted(self, places, text, gram, held, bounds):
        apart = int(self.span.max())
        # Places of texts are moved apart, and items even more, so that one sorted array has them all.
        from_item = int(bounds[-1]) + (len(bounds) + 1) * apart
        owners = self.owners[ragged(self.bounds[gram], held)]
        keys = np.unique(owners * from_item + np.repeat(places + text * apart, held))
        owners = keys // from_item
        last = np.arange(len(keys)) + self.least[owners] - 1
        enough = (last < len(keys)) & (keys[np.minimum(last, len(keys) - 1)] - keys < self.span[owners])
        item, place = owners[enough], keys[enough] % from_item
        text = np.searchsorted(bounds[:-1] + np.arange(len(bounds) - 1) * apart, place, "right") - 1
        place = place - text * apart
        start = np.maximum(place - self.span[item], bounds[text])
        end = np.minimum(place + self.span[item], bounds[text + 1])
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (start[1:] > end[:-1])
        closes = np.append(new[1:], True) if len(new) else new
        return text[new], item[new], start[new], end[closes]


def _matches(seeds, threshold: float):
    """Scores of all passages of some texts that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on_worker(("alignments",), dict)  # nothing is kept; what an earlier stage left goes
        own = seeds.value
        item_ids = np.array([i for i, _ in own.items], np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words, bounds = word_digests(part.column("text"))
                for text, item, start, stop in own.passages(words, bounds):
                    best, end = alignments(
                        [words[a:b].view(np.int64) for a, b in zip(start.tolist(), stop.tolist(), strict=True)], [own.items[k][1].view(np.int64) for k in item.tolist()]
                    )
                    score = best / (MATCH * np.array([len(own.items[k][1]) for k in item.tolist()], np.int64))
                    kept = score >= threshold
                    yield pa.record_batch(
                        {
                            "doc_id": part.column("doc_id").take(pa.array(text[kept])),
                            "item_id": pa.array(item_ids[item[kept]]),
                            "score": pa.array(score[kept], pa.float64()),
                            "word_end": pa.array((start - bounds[text] + end)[kept], pa.int64()),
                        }
                    )

    return run


def alignments(passages: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each passage with its item, and the place in the passage where it ends.

    All pairs go through one table, a row of every item at a time; a gap in the passage is a running maximum.
    """
    n = len(passages)
    best, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort([len(p) for p in passages], kind="stable")
    at = 0
    while at < n:
        some = order[at : at + 256]
        while len(some) > 1 and len(some) * len(passages[some[-1]]) > CELLS:
            some = some[: len(some) // 2]
        at += len(some)
        wide, tall = max(len(passages[i]) for i in some), max(len(items[i]) for i in some)
        text = np.zeros((len(some), wide), np.int64)
        item = np.full((len(some), tall), -1, np.int64)
        for k, i in enumerate(some):
            text[k, : len(passages[i])] = passages[i]
            item[k, : len(items[i])] = items[i]
        slope = GAP * np.arange(wide + 1)
        row = np.zeros((len(some), wide + 1), np.int64)
        for j in range(tall):
            same = text == item[:, j : j + 1]
            new = np.zeros_like(row)
            new[:, 1:] = np.maximum(row[:, :-1] + np.where(same, MATCH, MISMATCH), row[:, 1:] + GAP)
            np.maximum(new, 0, out=new)
            row = np.maximum.accumulate(new - slope, axis=1) + slope
            top = row.max(1)
            better = top > best[some]
            best[some[better]], end[some[better]] = top[better], row[better].argmax(1)
    return best, end


def _block(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Matches with some test items, few enough to be shipped."""
    spark = docs.sparkSession
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    words, bounds = word_digests(pa.array([t for _, t in rows], pa.string()))
    known = [(i, words[a:b]) for (i, _), a, b in zip(rows, bounds, bounds[1:]) if b > a]
    if not known:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, word_end long")
    seeds = spark.sparkContext.broadcast(Seeds(known, threshold))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))
    return texts.mapInArrow(lean(_matches(seeds, threshold)), "doc_id long, item_id long, score double, word_end long")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, word_end): documents that hold a test item, or most of it.

    ``score`` is the best alignment's share of that of a full copy; pairs from ``threshold`` on are returned, the best
    passage of each, with the place of the word where it ends. Null and empty texts and items match nothing; repeated
    rows give one pair; rows with a null id are never reported. The same holds for short items: one word of two is half.
    """
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), plain_text().alias("text"))
    items = items.groupBy("item_id").agg(F.max("text").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (4 * BLOCK)))
    out = None
    for b in range(blocks):
        part = _block(docs, items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), threshold)
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("score", "word_end")).alias("best")
    return out.where("doc_id is not null").groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", "best.word_end")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no test item."""
    return drop_ids(docs, written(contaminated(docs, benchmark).select("doc_id").distinct(), "leaks"))


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold items of the benchmark."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

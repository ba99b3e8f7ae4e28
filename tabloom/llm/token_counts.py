"""Token counts by a two-tier lookup on the map side.

A text is cut where no token can reach across: before every run of spaces and around characters that the vocabulary
does not know. The count of a text is then the sum over its pieces. Lengths of the most frequent pieces of the corpus
are broadcast as one compact table; other pieces are encoded by the tokenizer's own library and kept in a cache of the
worker. The pieces of the texts are never shuffled: the frequent ones come from bounded summaries, one per task, and
only these are added up.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bounded, lean, on_worker, plain_text, slices, sums, table, words_of
from .registry import query

MODEL = "piece_bpe_32k.model"
#: Pieces of a summary and of the broadcast table.
FREQUENT = 30_000
#: Bytes of the pieces that a worker keeps besides.
CACHED = 48 << 20
SPACE = "▁"


def heavy_hitters(texts: DataFrame, most: int = FREQUENT) -> dict[str, int]:
    """About the ``most`` most frequent words (between single spaces) of the texts, with counts.

    Each task keeps a Misra-Gries summary of its texts, and the summaries are added up. No word that makes up more than
    one in ``most`` of all is missed. A task sends, and the driver gets, at most ``most`` words, whatever the size of the
    corpus. The summary only saves time: results do not depend on it.
    """

    def shrink(counts: Counter) -> Counter:
        if len(counts) <= most:
            return counts
        kept = counts.most_common(most + 1)
        floor = kept[-1][1]
        return Counter({word: n - floor for word, n in kept[:-1] if n > floor})

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on_worker(("summary",), dict)  # nothing is kept; what an earlier stage left goes
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                codes, _, words = words_of(part.column("text"), pattern=" ")
                n = np.bincount(codes, minlength=len(words))
                floor = np.partition(n, -most - 1)[-most - 1] if len(n) > most else 0
                top = np.flatnonzero(n > floor)
                counts.update(dict(zip(words.take(pa.array(top)).to_pylist(), (n[top] - floor).tolist(), strict=True)))
                counts = shrink(counts)
        yield pa.record_batch({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    counted = texts.select(plain_text().alias("text")).mapInArrow(lean(summary), "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return {r["word"]: r["n"] for r in top.collect()}


class Pieces:
    """Cuts texts for one sentencepiece model and measures pieces with its library.

    The library writes a space as SPACE and puts one before the text. A piece stands for itself with one SPACE before.
    """

    def __init__(self, model: str):
        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(model))
        ids = range(p.get_piece_size())
        plain = [p.id_to_piece(i) for i in ids if not (p.is_control(i) or p.is_byte(i) or p.is_unknown(i))]
        if any(re.search(f"[^{SPACE}]{SPACE}", x) or "\n" in x for x in plain):
            raise ValueError("this vocabulary has tokens that reach over the start of a word or over a line end")
        self.line_end = len(p.encode("\n")) - 1

    def measure(self, piece: str) -> int:
        return len(self.processor.encode(piece)) if piece else 1

    def measure_many(self, pieces: list[str]) -> list[int]:
        return [len(ids) or 1 for ids in self.processor.encode(pieces, num_threads=1)] if pieces else []

    def measure_odd(self, piece: str) -> int:
        """Tokens of a piece as it stands: after a line end, or with a run of SPACE before."""
        if piece[0] == SPACE:
            return len(self.processor.encode(piece[1:])) if piece != SPACE else 1
        return len(self.processor.encode(f"\n{piece}")) - self.line_end - 1


ODD = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


class Lengths:
    """Tokens of words: the broadcast table first, then the worker's cache, then the library."""

    def __init__(self, frequent: dict[str, int], pieces: Pieces):
        self.frequent, self.pieces = frequent, pieces
        # a key with a line end is a piece as it stands after one
        self.cache = Bounded(lambda piece: self.pieces.measure_odd(piece[1:]), CACHED)

    def of(self, words: list[str]) -> np.ndarray:
        frequent, cache = self.frequent, self.cache
        found = [frequent.get(w) or cache.get(w) or 0 for w in words]
        n = np.array(found, np.int64)
        new = np.flatnonzero(n == 0).tolist()
        split = {i: words[i].split("\n") for i in new if "\n" in words[i]}  # no token holds a line end
        fresh = [i for i in new if i not in split]
        plain = [words[i] for i in fresh] + [parts[0] for parts in split.values()]
        counts = self.pieces.measure_many(plain)
        for piece, count in zip(plain[: len(fresh)], counts, strict=False):
            cache.keep(piece, count)
        n[fresh] = counts[: len(fresh)]
        for i, first in zip(split, counts[len(fresh) :], strict=True):
            n[i] = first + sum(self.pieces.line_end + (self.as_it_stands(p) if p else 0) for p in split[i][1:])
        return n

    def as_it_stands(self, piece: str) -> int:
        return self.cache[f"\n{piece}"]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        codes, bounds, words = words_of(texts, pattern=" ")
        words = words.to_pylist()
        n = sums(self.of(words)[codes], bounds) if words else np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts.to_pylist()):
            if not text:
                n[i] = 0
            elif "  " in text or SPACE in text or text[0] == " " or text[-1] == " " or "\n " in text or " \n" in text:
                marked = SPACE + text.replace(" ", SPACE)
                n[i] = sum(self.pieces.line_end if p == "\n" else self.as_it_stands(p) for p in ODD.findall(marked))
        return n


def _lengths(model: str, frequent: tuple) -> Lengths:
    """Model, table and cache of this worker for one job."""
    key, lengths = frequent
    return on_worker(("lengths", key), lambda: Lengths(lengths.value, Pieces(model)))


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    Counts equal the library's for the whole text, without added tokens. Null and empty texts have no bytes and no
    tokens. An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = Pieces(model)
    hitters = heavy_hitters(docs)
    table_of = {piece: pieces.measure(piece) for piece in hitters if piece and not re.search(f"[\n{SPACE}]", piece)}
    frequent = (uuid.uuid4().hex, spark.sparkContext.broadcast(table_of))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(model, frequent)
        for batch in batches:
            for part in slices(batch, "text"):
                n = pa.array(lengths.count(part.column("text")))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes"), "n_tokens": n})

    text = plain_text()
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
        .mapInArrow(lean(count), "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(table(spark, sf_dir, "documents"))

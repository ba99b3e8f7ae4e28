"""Jaccard join on word n-grams as a blocked sparse matrix product.

Documents are the rows of an incidence matrix, n-grams its columns. The product of the matrix with its transpose counts
overlaps. Three bounds that follow from set sizes keep it sparse: only the rarest columns of a row can hold the first
common column of a similar pair; sizes of similar sets differ little; and the places of the first common column in both
rows bound the overlap. Equal sets are one row. Inside a column all rows meet one pivot, the row that the bound favours;
pairs of other rows are counted only if the pivots have not connected them yet. So a group of copies costs about as
many pairs as it has members, and no link between different sets that could join two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Bounded, components, drop_ids, free_name, lean, on_worker, remove, table, written
from .registry import query

#: Frequent columns whose counts order the matrix; a larger table orders better, any table gives the same pairs.
FREQUENT = 100_000
#: Documents with possible partners (times their blocks) up to which ids are shipped as a filter; beyond, texts are joined.
SHIPPED = 2_000_000
#: Sets on either side of a block of the product.
BLOCK = 512
PAIR = ("a_key", "a_size", "b_key", "b_size")
#: Stands for a null doc_id.
NO_ID = (1 << 63) - 1
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _digests() -> Bounded:
    """word -> 64-bit digest, on this worker."""
    return on_worker(("word-digests",), lambda: Bounded(xxhash.xxh64_intdigest, 32 << 20))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX[0]
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted 64-bit digests of the distinct word n-grams of a text.

    A-Z is lower-cased; words are what the bytes 0x20 and 0x09 to 0x0D part. Fewer words than ``n`` are one n-gram.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    codes = np.fromiter(map(_digests().__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total = _scramble(total * _MIX[1] + codes[i : len(codes) - width + 1 + i])
    return np.unique(total.view(np.int64))


def _set_key(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def _sizes_and_columns(n: int, most: int = 1_000_000):
    """Per document its set's size and key; and, for every million n-grams, those seen in more than one set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = {}, 0

        def frequent():
            found, times = np.unique(np.concatenate(list(held.values())), return_counts=True)
            again = times > 1
            return pa.record_batch(
                {"doc_id": pa.nulls(int(again.sum()), pa.int64()), "key": pa.array(found[again]), "size": pa.array(times[again].astype(np.int64))}
            )

        for batch in batches:
            keys, sizes = [], []
            for text in batch.column("text"):
                shingles = shingle_set(text.as_py(), n)
                keys.append(_set_key(shingles))
                sizes.append(len(shingles))
                if keys[-1] not in held:
                    held[keys[-1]] = shingles
                    count += len(shingles)
                if count >= most:
                    yield frequent()
                    held, count = {}, 0
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "key": pa.array(keys, pa.int64()), "size": pa.array(sizes, pa.int64())}
            )
        if held:
            yield frequent()

    return run


def _rarest(n: int, percent: int, frequent):
    """The columns of each distinct set that can hold the first common column of a similar pair, rarest first.

    ``at`` is the place of a column in its row, ``key`` and ``size`` name the row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, counts = frequent.value
        sent: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column("text"):
                shingles = shingle_set(text.as_py(), n)
                size = len(shingles)
                key = _set_key(shingles)
                if not size or key in sent:
                    continue
                sent.add(key)
                place = np.searchsorted(columns, shingles) if len(columns) else np.zeros(size, np.int64)
                place = np.minimum(place, max(len(columns) - 1, 0))
                seen = np.where(columns[place] == shingles, counts[place], 0) if len(columns) else np.zeros(size, np.int64)
                first = size - -(-percent * size // 100) + 1
                order = np.lexsort((shingles, seen))[:first]
                out.append((shingles[order], np.full(first, key), np.full(first, size), np.arange(first)))
            if len(sent) > 2_000_000:
                sent.clear()
            if out:
                yield pa.record_batch({c: pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i, c in enumerate(("column", "key", "size", "at"))})

    return run


def _arrays(n: int, wanted=None):
    """(cell, key, shingles) of the texts of some documents; ``wanted`` has ids, sorted, and their cells, else a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                ids, bounds, cells = wanted.value
                mine = batch.column("doc_id").to_numpy(zero_copy_only=False)
                place = np.minimum(np.searchsorted(ids, mine), len(ids) - 1)
                hits = np.flatnonzero(ids[place] == mine)
                batch, place = batch.take(pa.array(hits)), place[hits]
            for i, text in enumerate(batch.column("text")):
                shingles = shingle_set(text.as_py(), n)
                to = cells[bounds[place[i]] : bounds[place[i] + 1]] if wanted is not None else batch.column("cells")[i].as_py()
                for at in range(0, len(to), 64):
                    some = to[at : at + 64]
                    yield pa.record_batch(
                        {
                            "cell": pa.array(some, pa.int64()),
                            "key": pa.array([_set_key(shingles)] * len(some), pa.int64()),
                            "shingles": pa.array([shingles.tobytes()] * len(some), pa.binary()),
                        }
                    )

    return run


def _overlaps(members: pa.Table, pairs: pa.Table) -> pa.Table:
    """Overlaps of the pairs of one block of the product."""
    members = members.combine_chunks()
    sets = dict(zip(members.column("key").to_pylist(), members.column("shingles"), strict=True))
    arrays: dict[int, np.ndarray] = {}
    counts = []
    for a, b in zip(pairs.column("a_key").to_pylist(), pairs.column("b_key").to_pylist(), strict=True):
        for k in (a, b):
            if k not in arrays:
                value = sets[k]
                raw = isinstance(value, pa.BinaryScalar)
                arrays[k] = np.frombuffer(value.as_py(), np.int64) if raw else np.asarray(value.values, np.int64)
        place = np.minimum(np.searchsorted(arrays[a], arrays[b]), len(arrays[a]) - 1)
        counts.append(int(np.count_nonzero(arrays[a][place] == arrays[b])))
    return pa.table({c: pairs.column(c) for c in ("g", *PAIR)} | {"overlap": pa.array(counts, pa.int64())})


def _possible(a: str, b: str, percent: int) -> Column:
    """The overlap that sizes demand is within the rest of both rows from their common column on."""
    least = F.ceil(percent * (F.col(f"{a}size") + F.col(f"{b}size")) / F.lit(100.0 + percent))
    rest = F.least(F.col(f"{a}size") - F.col(f"{a}at"), F.col(f"{b}size") - F.col(f"{b}at"))
    sizes = F.least(f"{a}size", f"{b}size") * 100 >= F.greatest(f"{a}size", f"{b}size") * percent
    return (rest >= least) & sizes


def _blocks(pairs: DataFrame) -> DataFrame:
    """Pairs with the block (``cell``) of the product that counts them.

    Pairs of one pivot (``g``) are counted in blocks of about BLOCK sets on either side, so a set travels once for each
    block and not for each pair; small pivots share a block.
    """
    extents = pairs.groupBy("g").agg(F.count_distinct("a_key").alias("n_a"), F.count_distinct("b_key").alias("n_b"))
    parts = [F.pmod(F.xxhash64(f"{s}_key"), F.ceil(F.col(f"n_{s}") / F.lit(BLOCK))) for s in "ab"]
    shared = F.pmod(F.xxhash64("g"), F.lit(max(1, pairs.count() // BLOCK)))
    cell = F.when((F.col("n_a") <= BLOCK) & (F.col("n_b") <= BLOCK), shared).otherwise(F.xxhash64("g", *parts))
    return written(pairs.join(extents, "g").select(cell.alias("cell"), "g", *PAIR), "celled-pairs")


def _places(celled: DataFrame) -> DataFrame:
    sides = [celled.select("cell", F.col(f"{s}_key").alias("key"), F.col(f"{s}_size").alias("size")) for s in "ab"]
    return sides[0].unionByName(sides[1]).distinct()


def _overlap(members: DataFrame, celled: DataFrame) -> DataFrame:
    pairs = celled.select(F.col("cell").alias("block"), "g", *PAIR)
    shape = "g long, a_key long, a_size long, b_key long, b_size long, overlap long"
    return members.groupBy("cell").cogroup(pairs.groupBy("block")).applyInArrow(_overlaps, shape)


def _counted(pairs: DataFrame, firsts: DataFrame, texts: DataFrame, held: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the (distinct) pairs of sets whose Jaccard similarity reaches the threshold, by exact overlap.

    First the product is taken over the rarest columns alone: of the two rows, the one whose rarest columns end first
    has them all decided, so the overlap is at most what they share plus the rest of that row. Full sets are taken anew
    from the texts, for the rows of the pairs that this bound leaves.
    """
    celled = _blocks(written(pairs, "pairs"))
    members = _places(celled).join(firsts, ["key", "size"]).select("cell", "key", "shingles")
    least = F.ceil(percent * (F.col("a_size") + F.col("b_size")) / F.lit(100.0 + percent))
    rest = F.greatest(*[F.ceil(F.col(f"{s}_size") * percent / F.lit(100.0)) - 1 for s in "ab"])
    likely = _overlap(members, celled).where(F.col("overlap") + rest >= least).drop("overlap")
    celled = _blocks(written(likely, "likely-pairs"))
    places = written(_places(celled).join(held, ["key", "size"]).select("cell", "doc_id"), "places")
    union = F.col("a_size") + F.col("b_size") - F.col("overlap")
    counted = _overlap(_sets_of(texts, places, n), celled)
    return written(counted.where(F.col("overlap") * 100 >= union * percent).drop("overlap", "g"), "links")


def _shared(rows: DataFrame) -> DataFrame:
    """The entries of columns that stand in more than one set."""
    shared = rows.groupBy("column").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most")
    return rows.join(written(shared.select("column"), "shared-columns"), "column")


def _frequent_columns(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent columns (at most FREQUENT) and their counts, sorted by column."""
    totals = written(
        seen.where("doc_id is null and size > 1").groupBy("key").agg(F.sum("size").alias("n")).where("n > 2"), "column-counts"
    )
    held, least = 0, 1 << 62
    by_count = totals.groupBy("n").agg(F.count(F.lit(1)).alias("columns"))
    for row in by_count.orderBy(F.desc("n")).limit(FREQUENT).collect():
        if held + row["columns"] > FREQUENT:
            break
        held, least = held + row["columns"], row["n"]
    top = totals.where(F.col("n") >= least).toPandas().sort_values("key")
    remove(totals)
    return top["key"].to_numpy(np.int64), top["n"].to_numpy(np.int64)


def _sets_of(texts: DataFrame, places: DataFrame, n: int) -> DataFrame:
    """The full sets of the documents in ``places`` (cell, doc_id), one row for each cell."""
    schema = "cell long, key long, shingles binary"
    if 0 < places.count() <= SHIPPED:
        found = places.toPandas().sort_values("doc_id")
        ids, first = np.unique(found["doc_id"].to_numpy(np.int64), return_index=True)
        wanted = (ids, np.append(first, len(found)), found["cell"].to_numpy(np.int64))
        return texts.mapInArrow(lean(_arrays(n, texts.sparkSession.sparkContext.broadcast(wanted))), schema)
    cells = places.groupBy("doc_id").agg(F.collect_set("cell").alias("cells"))
    return texts.join(cells, "doc_id").mapInArrow(lean(_arrays(n)), schema)


def _rest_pairs(lists: DataFrame, tops: DataFrame, percent: int) -> DataFrame:
    """Possible pairs of rows of one column that the pivots have left in different components."""
    # A set without links is a component of its own, known by its key.
    name = F.when(F.col("component").isNull(), F.xxhash64("key", "size", F.lit("alone"))).otherwise(F.xxhash64("component"))
    named = lists.join(tops, ["key", "size"], "left").withColumn("component", name)
    pivots = named.where("key = p_key and size = p_size").select("column", "band", F.col("component").alias("p_component"))
    named = written(named.join(pivots, ["column", "band"]).select("column", "band", "p_key", "key", "size", "at", "component", "p_component"), "named")
    here, there = (
        named.where(condition).select("column", "band", *[F.col(c).alias(f"{side}_{c}") for c in ("key", "size", "at", "component")], *extra)
        for side, condition, extra in (("a", "component <> p_component", ["p_component", "p_key"]), ("b", "true", []))
    )
    pairs = here.join(there, ["column", "band"]).where(
        (F.col("a_component") != F.col("b_component"))
        & _possible("a_", "b_", percent)
        & ((F.col("b_component") == F.col("p_component")) | (F.col("a_key") <= F.col("b_key")))
    )
    return pairs.groupBy(*PAIR).agg(F.min("p_key").alias("g"))


def _tops(links: DataFrame, held: DataFrame) -> DataFrame:
    """Component, as its smallest document, of every set that has a link."""
    a, b = (
        held.select(F.col("key").alias(f"{s}_key"), F.col("size").alias(f"{s}_size"), F.col("doc_id").alias(s)) for s in "ab"
    )
    numbered = links.join(a, ["a_key", "a_size"]).join(b, ["b_key", "b_size"]).select("a", "b")
    reached = components(numbered)
    return written(held.join(reached, held["doc_id"] == reached["node"]).select("key", "size", "component"), "tops")


def ngram_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Documents are linked when 100 * intersection >= percent * union of their sets; ``component_id`` is the smallest
    doc_id that links reach. Null texts and texts without words have empty sets and stay alone. A null doc_id counts as
    larger than all others and is null in the result. An empty table gives no rows. Repeated rows are kept.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")
    )
    seen = written(texts.mapInArrow(lean(_sizes_and_columns(n)), "doc_id long, key long, size long"), "sets")
    sets = seen.where("doc_id is not null")
    frequent = spark.sparkContext.broadcast(_frequent_columns(seen))
    rows = written(texts.mapInArrow(lean(_rarest(n, percent, frequent)), "column long, key long, size long, at long"), "matrix")
    rows_of_two = written(_shared(rows).distinct(), "shared-entries")
    remove(rows)
    # Sizes of similar sets are within a factor of 100 / percent; bands of four such steps, met from both sides.
    step = F.log(F.col("size").cast("double")) / float(np.log(100 / percent))
    band = F.floor(step / 4)
    bands = F.when(F.floor((step + 1.001) / 4) > band, F.array(band, band + 1)).otherwise(F.array(band))
    entries = rows_of_two.withColumn("band", F.explode(bands))
    pivots = entries.groupBy("column", "band").agg(
        F.count(F.lit(1)).alias("held"), F.min(F.struct("at", "size", "key")).alias("pivot")
    ).where("held > 1")
    pivots = written(pivots.select("column", "band", *[F.col(f"pivot.{c}").alias(f"p_{c}") for c in ("at", "size", "key")]), "pivots")
    lists = written(entries.join(pivots, ["column", "band"]), "lists")
    stars = lists.where(_possible("", "p_", percent) & ((F.col("key") != F.col("p_key")) | (F.col("size") != F.col("p_size"))))
    stars = stars.select(
        F.col("p_key").alias("g"), F.col("key").alias("a_key"), F.col("size").alias("a_size"),
        F.col("p_key").alias("b_key"), F.col("p_size").alias("b_size"),
    ).distinct()
    held = written(
        sets.where("size > 0").groupBy("key", "size").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("held")), "held"
    )
    firsts = rows_of_two.groupBy("key", "size").agg(F.array_sort(F.collect_list("column")).alias("shingles"))
    firsts = written(firsts, "firsts")
    links = _counted(stars, firsts, texts, held, n, percent)
    tops = _tops(links, held)
    rest = written(_rest_pairs(lists, tops, percent), "rest-pairs")
    if not rest.isEmpty():
        more = _counted(rest, firsts, texts, held, n, percent)
        if not more.isEmpty():
            tops = _tops(links.unionByName(more), held)
    for done in (rows_of_two, lists):
        remove(done)
    named = held.join(tops, ["key", "size"], "left").where("held > 1 or component <> doc_id")
    named = written(named.select("key", "size", F.coalesce("component", "doc_id").alias("component")), "components")
    full = sets.join(named, ["key", "size"], "left").select("doc_id", "size", F.coalesce("component", "doc_id").alias("component"))
    return full.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        F.col("size").alias("n_shingles"),
        F.nullif("component", F.lit(NO_ID)).alias("component_id"),
    )


def keep_first(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with all their columns, but only the document of the smallest id of each component.

    Rows with a null id stay; of rows that repeat an id one stays.
    """
    found = written(ngram_components(docs, n, percent), "document-components")
    kept = drop_ids(docs, written(found.where("component_id <> doc_id").select("doc_id"), "near-copies"))
    repeated = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return kept
    first = F.row_number().over(Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy("text"))
    place = free_name(kept, "copy_place")
    return kept.withColumn(place, first).where((F.col(place) == 1) | F.col("doc_id").isNull()).drop(place)


@query("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return ngram_components(table(spark, sf_dir, "documents"))

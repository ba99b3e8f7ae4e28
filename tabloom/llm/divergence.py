"""How far the sources of a language diverge in their use of terms.

Terms are counted per (language, source) group and kept where enough documents of the language hold them. For a pair of
groups the joint table, how many kept terms have count c in one and d in the other, is a product of indicator columns:
one column per (group, count level) over the kept terms, times its own transpose. The product is taken in blocks of terms
and tiles of groups, exactly, in integers; every entry of it is priced by the divergence of its two levels, so that a
block sends on one whole number per pair of groups. Terms that neither group holds are the (0, 0) entry: their number is
known, so blocks only carry terms that some group holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, plain_text, slices, table, words_of, written
from .registry import query

LEAST_DOCS, TOP = 10, 10
#: Size of a block of the product: terms by groups.
TERMS, GROUPS = 2048, 64
UNIT = 1_000_000_000

_letters = np.arange(256, dtype=np.uint8)
_letters[65:91] += 32
_letters[[b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]] = 32


def lower_terms(texts: pa.Array) -> pa.Array:
    """Texts with A to Z lower-cased and every other ASCII sign but a to z as a blank; byte by byte, so lengths stay."""
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return texts
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    plain = _letters[np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(bounds - bounds[0]), pa.py_buffer(plain))


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, df) of some rows (lang, source, text): occurrences, and documents that hold the term."""
    for batch in batches:
        for part in slices(batch, "text"):
            codes, bounds, terms = words_of(lower_terms(part.column("text")), pattern=" ")
            size = max(len(terms), 1)
            doc = np.repeat(np.arange(part.num_rows, dtype=np.int64), np.diff(bounds))
            blank = pa.compute.index(terms, "").as_py()
            filled = codes != blank
            held, times = np.unique(doc[filled] * size + codes[filled], return_counts=True)
            lang, source = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
            both = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            _, first, group = np.unique(both, return_index=True, return_inverse=True)
            keys, at = np.unique(group[held // size] * size + held % size, return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, at, times)
            rows = part.select(["lang", "source"]).take(pa.array(first[keys // size]))
            found = [terms.take(pa.array(keys % size)), pa.array(n), pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*rows.columns, *found], names=["lang", "source", "term", "n", "df"])


def kept_cells(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n, first): counts of the kept terms per group and in the whole language.

    ``first`` marks one row of each kept term of a language.
    """
    counts = docs.mapInArrow(lean(count_terms), "lang string, source string, term string, n long, df long")
    cells = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    term = Window.partitionBy("lang", "term")
    cells = cells.withColumn("lang_n", F.sum("n").over(term)).withColumn("lang_df", F.sum("df").over(term))
    cells = cells.withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
    return cells.where(F.col("lang_df") >= least_docs).drop("df", "lang_df")


def level(n: str, total: str) -> Column:
    """p of a count in a group of ``total`` occurrences of the ``kept`` terms, as a whole number; 0 if none is kept."""
    return F.expr(
        f"if(kept = 0, 0L, 1 + (cast({UNIT} as decimal(10,0)) * cast({n} + 2 as decimal(20,0))) div cast({total} + 2 * kept as decimal(20,0)))"
    )


def priced(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); levels are at most UNIT + 1, so the square fits 64 bits."""
    return (p - q) ** 2 // np.maximum(p + q, 1)


PARTIAL = "lang string, source string, item string, value long"


def joint_block(cells: pa.Table) -> pa.Table:
    """Priced joint tables of one block: terms of one hash class, groups of tile a against groups of tile b.

    Rows without a term name the groups with their zero level p0. Each group has one indicator column per count level
    that occurs in the block, the zero level first; the product of a group's columns with all columns of the other tile
    is the number of terms in which two levels meet, taken as the counts of equal (level, column) pairs. The (0, 0) entry
    stands for nothing here: entries are priced by what they add to it.
    """
    a, b, lang = cells["a"][0].as_py(), cells["b"][0].as_py(), cells["lang"][0].as_py()
    heads = cells.filter(pa.compute.is_null(cells["term"]))
    names = heads["source"].to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    names, tile = [names[i] for i in order], heads["tile"].to_numpy()[order]
    zero, whole = heads["p"].to_numpy()[order], heads["n"].to_numpy()[order]
    rows = cells.filter(pa.compute.is_valid(cells["term"]))
    terms = rows["term"].combine_chunks().dictionary_encode()
    group = pa.compute.index_in(rows["source"].combine_chunks(), pa.array(names, pa.string())).to_numpy()
    codes = terms.indices.to_numpy()
    counts, p = rows["n"].to_numpy(), rows["p"].to_numpy()
    column = np.zeros((len(terms.dictionary), len(names)), np.int64)  # of each term in each group: its indicator column
    prices, owner, width = [], [], 0
    for g in range(len(names)):
        at = np.flatnonzero(group == g)
        _, sample, code = np.unique(counts[at], return_index=True, return_inverse=True)
        column[:, g] = width
        column[codes[at], g] = width + 1 + code
        prices.append(np.concatenate([zero[g : g + 1], p[at][sample]]))
        owner.append(np.full(len(sample) + 1, g))
        width += len(sample) + 1
    price, owner = np.concatenate(prices), np.concatenate(owner)
    here, there = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
    out: dict[str, list] = {"source": [], "item": [], "value": []}
    for g in here:
        others = there[there > g] if a == b else there
        if not len(others):
            continue
        pairs, n = np.unique(column[:, g : g + 1] * width + column[:, others], return_counts=True)
        left, right = pairs // width, pairs % width
        both = owner[right]
        worth = n * (priced(price[left], price[right]) - priced(zero[g], zero[both]))
        value = np.zeros(len(names), np.int64)
        np.add.at(value, both, worth)
        value[others] += whole[others] * priced(zero[g], zero[others])
        for h in others:
            out["source"] += [names[g], names[h]]
            out["item"] += [names[h], names[g]]
            out["value"] += [int(value[h])] * 2
    return pa.table({"lang": pa.array([lang] * len(out["value"]), pa.string()), **{k: pa.array(v, pa.string() if k != "value" else pa.int64()) for k, v in out.items()}})


def tiled(rows: DataFrame) -> DataFrame:
    """Rows once for every pair of tiles that their own belongs to, the smaller tile as ``a``."""
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = rows.withColumn("other", other)
    return rows.withColumn("a", F.least("tile", "other")).withColumn("b", F.greatest("tile", "other"))


def pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of groups of a language."""
    block = F.expr("cast(pmod(xxhash64(term), blocks) as int)")
    shape = ["lang", "block", "a", "b", "source", "tile", "term", "n", "p"]
    body = tiled(cells.withColumn("block", block)).select(*shape)
    # the first block also carries the price of the terms that neither group of a pair holds
    numbers = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    heads = groups.withColumn("block", numbers).withColumn("term", F.lit(None).cast("string"))
    heads = heads.withColumn("n", F.when(F.col("block") == 0, F.col("kept")).otherwise(0)).withColumn("p", F.col("p0"))
    parts = tiled(heads).select(*shape).unionByName(body).groupBy("lang", "block", "a", "b").applyInArrow(joint_block, PARTIAL)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    top: int = TOP,
    terms: int = TERMS,
    groups_per_tile: int = GROUPS,
    broadcast_groups: int = 100_000,
) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its distance to the other sources (``pair``), and the
    ``top`` terms by which it exceeds its language (``term``).

    Null texts, languages and sources are empty ones. A group without terms takes part with counts of 0; where a language
    keeps no term, its pairs have the value 0. A language with one source has no pairs. Repeated rows count one by one and
    each as a document of its own. Further columns are not read. An empty table gives no rows. Block and tile sizes and
    ``broadcast_groups`` (up to so many groups their totals are broadcast, beyond they are joined) do not change results.
    """
    plain = docs.select(plain_text("lang").alias("lang"), plain_text("source").alias("source"), plain_text().alias("text"))
    cells = written(kept_cells(plain, least_docs), "divergence-cells")
    langs = cells.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("kept"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = plain.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / groups_per_tile).cast("int").alias("tiles"))
    groups = groups.join(sizes, "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.na.fill(0, ["lang_total", "kept", "total"]).withColumn("p0", level("0", "total"))
    groups = groups.withColumn("blocks", F.greatest(F.ceil(F.col("kept") / terms), F.lit(1)).cast("int"))
    groups = written(groups.withColumn("tile", F.expr("cast(pmod(xxhash64(source), tiles) as int)")), "divergence-groups")
    known = F.broadcast(groups) if groups.count() <= broadcast_groups else groups
    cells = cells.join(known, ["lang", "source"]).withColumn("p", level("n", "total"))
    pairs = pair_values(cells, groups).withColumn("part", F.lit("pair"))
    more = cells.withColumn("q", level("lang_n", "lang_total")).where("p > q")
    more = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    ranked = more.withColumn("rank", place).where(F.col("rank") <= top).select(*columns)
    return pairs.withColumn("rank", place).select(*columns).unionByName(ranked)


OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT row, lang, source, unnest(terms) AS t FROM d),
kept AS (SELECT lang, t, count(*) AS lang_n FROM w GROUP BY lang, t HAVING count(DISTINCT row) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
c AS (SELECT lang, source, t, count(*) AS n FROM w SEMI JOIN kept USING (lang, t) GROUP BY ALL),
g AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source)
  GROUP BY ALL),
dense AS (
  SELECT lang, source, t, coalesce(n, 0) AS n, 1 + ({UNIT}::hugeint * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p,
         1 + ({UNIT}::hugeint * (lang_n + 2)) // (lang_total + 2 * v) AS q
  FROM g JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN c USING (lang, source, t)),
priced AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b USING (lang, t) GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN priced x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, t AS item, ((p - q) * (p - q)) // (p + q) AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::bigint AS value, rank::int AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""


@query("op11_source_divergence", OP11_SQL)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divergence of the sources of all documents."""
    return divergence(table(spark, sf_dir, "documents"))

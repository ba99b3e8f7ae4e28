"""K-d tree shards of near-equal bytes.

The corpus is split again and again along the widest dimension of its metadata, at the weighted median that the
cluster finds by refining histograms, until leaves reach the target bytes. Only a narrow table (id, size, checksum,
codes of language and source) is passed over; each pass sends at most nodes x bins sums to the driver.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import plain_text, table, written
from .registry import query

BINS = 2048
#: Dimensions and the bits that tell their values apart; within a step, digests of the rows do.
DIMENSIONS = {"d_source": 11, "d_size": 20, "d_lang": 11, "d_id": 20}


def metadata(docs: DataFrame) -> DataFrame:
    """One narrow row per document: id, bytes plus one, checksum and the dimensions as doubles."""
    raw = F.encode(plain_text(), "UTF-8")
    return docs.select(
        "doc_id",
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("source").cast("string")), F.lit(2048)).cast("double").alias("d_source"),
        F.pmod(F.xxhash64(F.col("lang").cast("string")), F.lit(2048)).cast("double").alias("d_lang"),
        F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)).alias("d_id"),
    ).withColumn("d_size", F.log2(F.col("size").cast("double")))


def _keyed(meta: DataFrame) -> DataFrame:
    """Every dimension as a long: its place between smallest and largest value, then bits that tell equal values apart."""
    ends = meta.agg(*[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    for d, bits in DIMENSIONS.items():
        lo, width = ends[f"lo_{d}"], ends[f"hi_{d}"] - ends[f"lo_{d}"]
        place = F.floor((F.col(d) - lo) / (width or 1.0) * float((1 << bits) - 1)).cast("long")
        rest = F.lit(1 << (62 - bits))
        meta = meta.withColumn(d.replace("d_", "k_"), place * rest + F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), rest))
    return meta


def _node(splits: dict[int, tuple[str, int]]) -> Column:
    """Number of the tree node of a row; the children of node n are 2n and 2n + 1."""
    if not splits:
        return F.lit(1).cast("long")
    keys = sorted({key for key, _ in splits.values()})
    place = F.create_map(*[F.lit(x) for n, (key, _) in splits.items() for x in (n, keys.index(key) + 1)])
    cut = F.create_map(*[F.lit(x).cast("long") for n, (_, at) in splits.items() for x in (n, at)])
    values = F.array(*keys)

    def down(node: Column, _: Column) -> Column:
        right = F.element_at(values, F.element_at(place, node.cast("int"))) >= F.element_at(cut, node)
        return F.coalesce(node * 2 + right.cast("long"), node)

    depth = max(n.bit_length() for n in splits)
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1).cast("long"), down)


def _medians(rows: DataFrame, nodes: dict[int, dict]) -> None:
    """Put into each node the key (``cut``) at which its left part holds the wanted bytes."""
    open_nodes = dict(nodes)
    while open_nodes:
        arms = list(open_nodes.items())
        pick = reduce(
            lambda rest, arm: F.when(
                (F.col("node") == arm[0]) & F.col(arm[1]["key"]).between(arm[1]["lo"], arm[1]["hi"]),
                F.floor((F.col(arm[1]["key"]) - arm[1]["lo"]) / arm[1]["step"]).cast("long"),
            ).otherwise(rest),
            arms,
            F.lit(None).cast("long"),
        )
        found = rows.withColumn("bin", pick).where("bin is not null").groupBy("node", "bin").agg(F.sum("size").alias("w"))
        sums: dict[int, list] = {}
        for row in found.collect():
            sums.setdefault(row["node"], []).append((row["bin"], row["w"]))
        for n, node in arms:
            below = node["below"]
            for b, w in sorted(sums[n]):
                if below + w >= node["want"]:
                    break
                below += w
            start = node["lo"] + b * node["step"]
            if w <= node["slack"] or node["step"] == 1:
                near = node["want"] - below <= below + w - node["want"]
                node["cut"] = start if near and below else start + node["step"]
                del open_nodes[n]
            else:
                end = min(node["hi"], start + node["step"] - 1)
                node |= {"lo": start, "hi": end, "below": below, "step": max(1, math.ceil((end - start + 1) / BINS))}


def kd_shards(docs: DataFrame, target_bytes: int | None = None, shards: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    Give the number of ``shards`` or the ``target_bytes`` of a leaf. Sizes of shards differ by single documents and by
    the slack of the histograms (1/2000 of a leaf). A null text counts as empty. Rows that are equal in id, text and
    size cannot be told apart and stay together; all other ties, such as copies of a text, are split by their ids. An
    empty table gives no rows. ``slot`` counts the rows of a shard without gaps from 0, by blocks of ids, so no task
    sorts a whole shard.
    """
    meta = written(metadata(docs), "shard-metadata")
    total = meta.agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).first()
    n_rows, weight = total["n"], total["w"] or 0
    leaves = max(1, shards or math.ceil(weight / target_bytes))
    rows = _keyed(meta) if n_rows else meta
    splits: dict[int, tuple[str, int]] = {}
    wanted = {1: leaves}
    keys = [d.replace("d_", "k_") for d in DIMENSIONS]
    while n_rows and any(k > 1 for k in wanted.values()):
        numbered = rows.withColumn("node", _node(splits))
        ends = numbered.groupBy("node").agg(
            F.sum("size").alias("w"), *[f(k).alias(f"{n}_{k}") for k in keys for n, f in (("lo", F.min), ("hi", F.max))]
        )
        nodes = {}
        for row in ends.collect():
            k = wanted.get(row["node"], 1)
            if k > 1:
                widest = max(keys, key=lambda d: row[f"hi_{d}"] - row[f"lo_{d}"])
                lo, hi = row[f"lo_{widest}"], row[f"hi_{widest}"]
                nodes[row["node"]] = {
                    "key": widest, "lo": lo, "hi": hi, "step": max(1, math.ceil((hi - lo + 1) / BINS)), "below": 0,
                    "want": row["w"] * (k // 2) / k, "slack": row["w"] / k / 2000,
                }
        _medians(numbered, nodes)
        for n, node in nodes.items():
            k = wanted.pop(n)
            splits[n] = (node["key"], node["cut"])
            wanted |= {2 * n: k // 2, 2 * n + 1: k - k // 2}
        wanted = {n: k for n, k in wanted.items() if k == 1 or n in {2 * m for m in nodes} | {2 * m + 1 for m in nodes}}
    order = sorted(wanted, key=lambda n: bin(n)[2:])
    node = _node(splits)
    shard = reduce(lambda rest, i: F.when(F.col("node") == order[i], F.lit(i)).otherwise(rest), range(len(order)), F.lit(0))
    blocks = max(16, n_rows // 1_000_000)
    placed = rows.withColumn("node", node).select(
        "doc_id", "size", "text_crc32", shard.cast("int").alias("shard"),
        F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks)).alias("block"),
    )
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("held"))
    before = counts.select(
        F.col("shard"), F.col("block"),
        (F.sum("held").over(Window.partitionBy("shard").orderBy("block")) - F.col("held")).alias("before"),
    )
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32"))
    return (
        placed.withColumn("within", within)
        .join(before, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("within") - 1).alias("slot"))
    )


@query("op1_kd_sharding")
def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes."""
    placed = kd_shards(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

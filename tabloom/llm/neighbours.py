"""Approximate nearest neighbours on a graph made by NN-descent.

Equal vectors are one node. Random projection trees, grown on a bounded sample, put every node into small leaves; the
nearest nodes of the same leaf are its first neighbours. NN-descent then joins, round by round, the neighbours of each
node with one another, since a neighbour of a neighbour is likely a neighbour, until hardly any list changes. Queries
walk the graph greedily from their leaves, along edges of either direction: a beam of the nearest nodes so far is
expanded until all of its nodes have been. The beam widens with the logarithm of the table, as finding the way does.

The graph is built on vectors in single precision, so that a few large vectors do not flatten the others; distances that
are reported are exact, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remove, table, written
from .registry import query

#: Nodes on which the trees are grown, and trees.
SAMPLE, TREES = 20_000, 4
#: Nodes of a leaf, about, and at most; neighbours of a node; edges into a node that a search may walk back.
LEAF, MOST_IN_LEAF, DEGREE, BACK = 100, 512, 16, 32
#: NN-descent ends with a round that changes less than this share of all neighbours.
SETTLED = 0.05
#: Nodes of a beam for each doubling of the table beyond 500 nodes.
BEAM = 48


def smallest(rows: DataFrame, keys: list[str], order: list[str], k: int, salts: tuple[int, ...] = (256, 16, 1)) -> DataFrame:
    """The first ``k`` rows of each key, found in parts first, so that a hot key is spread over many tasks."""
    for n in salts:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(n)))
        within = F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(*order))
        rows = salted.withColumn("place", within).where(F.col("place") <= k).drop("salt", "place")
    return rows


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector): rows with an id whose vector is not null, not zero and finite in every component."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad & some).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    )


def matrix(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.flatten(), np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


class Forest:
    """Random projection trees; the halves of a node are as large as one another in the sample."""

    def __init__(self, sample: np.ndarray, leaf: int, extra_bits: int, scale: float, seed: int = 11):
        random = np.random.default_rng(seed)
        self.scale = scale
        self.trees = []
        for _ in range(TREES):
            normals, cuts, down = [], [], []

            def grow(rows: np.ndarray, normals=normals, cuts=cuts, down=down) -> int:
                if len(rows) <= leaf:
                    down.append(None)
                    normals.append(np.zeros(sample.shape[1]))
                    cuts.append(0.0)
                    return len(down) - 1
                a, b = sample[random.choice(rows, 2, replace=False)]
                normal = a - b
                normal = normal / (np.linalg.norm(normal) or 1.0)
                side = sample[rows] @ normal
                cut = float(np.median(side))
                left = side <= cut
                if left.all():
                    left = random.random(len(rows)) < 0.5
                me = len(down)
                down.append(())
                normals.append(normal)
                cuts.append(cut)
                down[me] = (grow(rows[left]), grow(rows[~left]))
                return me

            grow(np.arange(len(sample)))
            children = np.array([d or (i, i) for i, d in enumerate(down)], np.int64)
            self.trees.append((np.array(normals, np.float32), np.array(cuts, np.float32), children))
        width = sample.shape[1] if len(sample) else 1
        self.planes = random.standard_normal((TREES, extra_bits, width)).astype(np.float32)
        # planes through the sample's medians, so that a common offset of all vectors does not matter
        self.middles = np.array([np.median(sample @ p.T, axis=0) for p in self.planes]) if len(sample) else np.zeros((TREES, extra_bits))

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """A leaf number for each vector and tree."""
        out = np.zeros((len(vectors), TREES), np.int64)
        x = vectors.astype(np.float32)
        for t, (normals, cuts, children) in enumerate(self.trees):
            at = np.zeros(len(x), np.int64)
            while True:
                right = np.einsum("ij,ij->i", x, normals[at]) > cuts[at]
                new = children[at, right.astype(np.int64)]
                if (new == at).all():
                    break
                at = new
            bits = (x @ self.planes[t].T > self.middles[t]) @ (1 << np.arange(self.planes.shape[1]))
            out[:, t] = (at << 20 | bits) * TREES + t
        return out


def _planted(forest):
    """One row for each node and tree: leaf, node and the vector in single precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("vector")) / forest.value.scale
            leaves = forest.value.leaves(vectors)
            short = [v.tobytes() for v in vectors.astype(np.float32)]
            yield pa.record_batch({"leaf": pa.array(leaves.reshape(-1)), "node": pa.array(np.repeat(batch.column("node").to_numpy(), TREES)), "short": pa.array([s for s in short for _ in range(TREES)], pa.binary())})

    return run


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x and y, in batches along the first axis."""
    dots = x @ np.swapaxes(y, -1, -2)
    squares = np.maximum((x * x).sum(-1)[..., :, None] + (y * y).sum(-1)[..., None, :] - 2 * dots, 0)
    return np.sqrt(squares).astype(np.float32)


LISTS = "node long, ids array<long>, far array<float>"


def _lists(nodes, ids: list, far: list) -> pa.RecordBatch:
    return pa.record_batch(
        {"node": pa.array(nodes, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64())), "far": pa.array(far, pa.list_(pa.float32()))}
    )


def _leaf_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per leaf: the nearest nodes of each of its nodes."""
    for batch in batches:
        for members in batch.column("members"):
            nodes = np.asarray(members.values.field("node"))
            x = np.frombuffer(b"".join(members.values.field("short").to_pylist()), np.float32).reshape(len(nodes), -1).astype(np.float64)
            if len(nodes) < 2:
                continue
            for at in range(0, len(nodes), 1024):
                far = _gaps(x[at : at + 1024], x)
                far[np.arange(len(far)), at + np.arange(len(far))] = np.inf
                k = min(DEGREE, len(nodes) - 1)
                near = np.argpartition(far, k - 1, axis=1)[:, :k]
                yield _lists(nodes[at : at + 1024], list(nodes[near]), list(np.take_along_axis(far, near, 1)))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nearest distinct neighbours of each node from several lists."""
    for batch in batches:
        ids, far = [], []
        for all_ids, all_far in zip(batch.column("ids"), batch.column("far"), strict=True):
            i, f = np.asarray(all_ids.values), np.asarray(all_far.values)
            i, first = np.unique(i, return_index=True)
            f = f[first]
            best = np.lexsort((i, f))[:DEGREE]
            ids.append(i[best])
            far.append(f[best])
        yield _lists(batch.column("node"), ids, far)


def merge_lists(lists: DataFrame) -> DataFrame:
    gathered = lists.groupBy("node").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("far")).alias("far"))
    return gathered.mapInArrow(_merged, LISTS)


def _local_joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per centre: distances among its members; for each member the others that beat its farthest neighbour."""
    for batch in batches:
        by_size: dict[int, list] = {}
        for members in batch.column("members"):
            by_size.setdefault(len(members), []).append(members.values)
        for size, groups in by_size.items():
            for at in range(0, len(groups), 256):
                some = groups[at : at + 256]
                nodes = np.array([np.asarray(g.field("node")) for g in some])
                limit = np.array([np.asarray(g.field("limit")) for g in some])
                raw = b"".join(b for g in some for b in g.field("short").to_pylist())
                x = np.frombuffer(raw, np.float32).reshape(len(some), size, -1).astype(np.float64)
                far = _gaps(x, x)
                far[:, np.arange(size), np.arange(size)] = np.inf
                good = far < limit[:, :, None]
                group, member, other = np.nonzero(good)
                if not len(group):
                    continue
                start = np.flatnonzero(np.concatenate([[True], np.diff(group * size + member) > 0]))
                found = nodes[group[start], member[start]]
                ids = np.split(nodes[group, other], start[1:])
                yield _lists(found, ids, np.split(far[group, member, other], start[1:]))


def descend(graph: DataFrame, short: DataFrame) -> DataFrame:
    """One round of NN-descent: neighbours, in either direction, of a node are tried as neighbours of one another."""
    edges = graph.select("node", F.explode(F.arrays_zip("ids", "far")).alias("e")).select("node", F.col("e.ids").alias("other"), F.col("e.far").alias("far"))
    both = edges.select(F.col("node").alias("centre"), F.col("other").alias("member"), "far").unionByName(
        edges.select(F.col("other").alias("centre"), F.col("node").alias("member"), "far")
    )
    near = F.row_number().over(Window.partitionBy("centre").orderBy("far", "member"))
    pairs = both.withColumn("place", near).where(F.col("place") <= 2 * DEGREE).select("centre", "member").distinct()
    limits = graph.select(F.col("node").alias("member"), F.when(F.size("ids") < DEGREE, F.lit(float("inf"))).otherwise(F.array_max("far")).cast("float").alias("limit"))
    known = short.withColumnRenamed("node", "member").join(limits, "member", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf")).cast("float")))
    groups = pairs.join(known, "member").groupBy("centre").agg(
        F.collect_list(F.struct(F.col("member").alias("node"), "limit", "short")).alias("members")
    )
    better = groups.select("members").mapInArrow(_local_joins, LISTS)
    return merge_lists(graph.unionByName(better))


def split_leaves(planted: DataFrame, most: int = MOST_IN_LEAF) -> DataFrame:
    """``planted`` with a column ``part``: leaves of more than ``most`` nodes are dealt into parts by hash.

    Members of a leaf are compared all against all in one task; equal or tightly clustered vectors that no plane parts
    must not make that group grow with the table. Trees deal differently, and NN-descent joins the parts again.
    """
    parts = planted.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")).where("parts > 1")
    dealt = F.coalesce(F.expr("pmod(xxhash64(node, leaf), parts)"), F.lit(0))
    return planted.join(parts, "leaf", "left").withColumn("part", dealt).drop("parts")


def changed_share(before: DataFrame, after: DataFrame) -> float:
    """Share of the neighbours in ``after`` that were not in ``before``."""
    both = after.select("node", F.col("ids").alias("new")).join(before.select("node", "ids"), "node", "left")
    fresh = F.size(F.array_except("new", F.coalesce("ids", F.array().cast("array<long>"))))
    found = both.agg(F.sum(fresh).alias("fresh"), F.sum(F.size("new")).alias("all")).first()
    return (found["fresh"] or 0) / (found["all"] or 1)


def walkable(graph: DataFrame) -> DataFrame:
    """(node, ids): the neighbours of each node and the BACK nearest nodes that have it as theirs."""
    edges = graph.select("node", F.explode(F.arrays_zip("ids", "far")).alias("e")).select("node", F.col("e.ids").alias("other"), F.col("e.far").alias("far"))
    into = smallest(edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "far"), ["node"], ["far", "other"], BACK)
    every = edges.select("node", "other").unionByName(into.select("node", "other")).distinct()
    return every.groupBy("node").agg(F.collect_list("other").alias("ids"))


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gap = matrix(batch.column("q_vector")) - matrix(batch.column("vector"))
        yield pa.record_batch({"query_id": batch.column("query_id"), "node": batch.column("node"), "score": pa.array(np.sqrt((gap * gap).sum(1)))})


class Index:
    """Nodes, their members, leaves and graph, as tables in the shared folder."""

    def __init__(self, embeddings: DataFrame, k: int = 10, settled: float = SETTLED):
        spark = embeddings.sparkSession
        rows = written(usable(embeddings).dropDuplicates(["vec_id"]), "vectors")
        sizes = rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
        self.width = sizes[0]["n"] if sizes else 0
        rows = rows.where(F.size("vector") == self.width)
        # Of equal vectors only the k + 1 smallest ids can be among the k nearest of anything.
        first = written(smallest(rows, ["vector"], ["vec_id"], k + 1), "members")
        nodes = first.groupBy("vector").agg(F.min("vec_id").alias("node"))
        self.nodes = written(nodes, "nodes")
        self.members = written(first.join(self.nodes, "vector").select("node", "vec_id"), "node-members")
        n = self.nodes.count()
        peak = self.nodes.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 1.0
        sample = self.nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vector").collect()
        sample = np.array([r["vector"] for r in sample], np.float64).reshape(len(sample), self.width) / peak
        leaf = max(4, LEAF * len(sample) // max(n, 1)) if n > LEAF else n + 1
        bits = max(0, math.ceil(math.log2(max(1.0, n * leaf / max(len(sample), 1) / (2 * LEAF)))))
        self.forest = spark.sparkContext.broadcast(Forest(sample, leaf, min(bits, 20), peak))
        planted = written(self.nodes.mapInArrow(_planted(self.forest), "leaf long, node long, short binary"), "leaves")
        # a walk starts at some nodes of each leaf; a leaf of many alike nodes needs no more of them
        starts = planted.select("leaf", "node", F.xxhash64("node", "leaf").alias("lot"))
        self.leaves = written(smallest(starts, ["leaf"], ["lot", "node"], 2 * LEAF).select("leaf", "node"), "starts")
        in_leaf = split_leaves(planted).groupBy("leaf", "part").agg(F.collect_list(F.struct("node", "short")).alias("members"))
        graph = written(merge_lists(in_leaf.select("members").mapInArrow(_leaf_neighbours, LISTS)), "graph")
        short = planted.where(F.pmod("leaf", F.lit(TREES)) == 0).select("node", "short")
        changed = 1.0
        while changed >= settled:
            after = written(descend(graph, short), "graph")
            changed = changed_share(graph, after)
            remove(graph)
            graph = after
        self.graph = written(walkable(graph), "walk")
        self.beam = BEAM * max(2, math.ceil(math.log2(max(n, 1) / 500)))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, rank, vec_id, score) for queries (query_id, vector); a row with the query's own id never counts."""
        queries = queries.where(F.size("vector") == self.width).select("query_id", F.col("vector").alias("q_vector"))
        forest = self.forest

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaves = forest.value.leaves(matrix(batch.column("q_vector")) / forest.value.scale)
                yield pa.record_batch({"query_id": pa.array(np.repeat(batch.column("query_id").to_numpy(), TREES)), "leaf": pa.array(leaves.reshape(-1))})

        entry = queries.mapInArrow(start, "query_id long, leaf long").join(self.leaves, "leaf").select("query_id", "node").distinct()
        beam = written(self._nearest(self._scored(entry, queries).withColumn("open", F.lit(True))), "beam")
        while not beam.where("open").isEmpty():
            steps = beam.where("open").join(self.graph, "node").select("query_id", F.explode("ids").alias("node")).distinct()
            new = self._scored(steps.join(beam.select("query_id", "node"), ["query_id", "node"], "left_anti"), queries)
            grown = beam.withColumn("open", F.lit(False)).unionByName(new.withColumn("open", F.lit(True)))
            after = written(self._nearest(grown), "beam")
            remove(beam)
            beam = after
        found = beam.join(self.members, "node").where("vec_id <> query_id")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    def _scored(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        full = pairs.join(queries, "query_id").join(self.nodes, "node").select("query_id", "node", "q_vector", "vector")
        return full.mapInArrow(_distances, "query_id long, node long, score double")

    def _nearest(self, beam: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "node"))
        return beam.withColumn("place", place).where(F.col("place") <= self.beam).drop("place")


def nearest(embeddings: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found, by Euclidean distance, of the rows where ``queries`` holds.

    Null, zero and non-finite vectors take no part, nor do rows without an id or of another width than most. A repeated
    id counts once. Ties go to the smaller id. With fewer candidates than ``k``, all of them; an empty table gives no
    rows.
    """
    rows = usable(embeddings).where(queries).dropDuplicates(["vec_id"]).withColumnRenamed("vec_id", "query_id")
    return Index(embeddings, k).search(rows, k)


@query("op5_nn_descent")
def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)

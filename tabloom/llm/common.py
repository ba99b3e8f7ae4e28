"""What the corpus operators share: tables, the shared folder, files for workers, links to components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

_own_dir: list[str] = []
#: Rows of an Arrow batch of documents.
BATCH = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that driver and executors share; one of our own only where a local session has none set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="tabloom-llm-"))
        path = _own_dir[0]
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files behind a table made by ``written`` once nothing reads it any more."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession, name: str, data: bytes) -> str:
    """Put a file of bounded size into the shared folder and let Spark bring it to every executor, late ones too.

    Returns the name for ``SparkFiles.get``.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.bin"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    for start in range(0, len(data), 1 << 20):
        out.write(bytearray(data[start : start + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(path if "://" in path else f"file://{path}")
    return path.rsplit("/", 1)[1]


def shipped(name: str) -> str:
    return SparkFiles.get(name)


_slot: dict[tuple, object] = {}


def give_back() -> None:
    """Return freed memory of this worker to the system, as reused workers of many stages live beside one another."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library has no such call, and returns memory by itself
        pass


def lean(run: Callable) -> Callable:
    """``run``, a function for ``mapInArrow`` over whole documents, with a small footprint.

    The worker gives its memory back after each task. Rows are texts here, so the session's Arrow batches are cut to
    BATCH rows: executor and worker each hold some of them besides the heap.
    """
    spark, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def on_worker(key: tuple, make: Callable[[], object]) -> object:
    """What this worker keeps for one job: ``make()``, unless ``key`` already made it.

    Spark reuses Python workers, so what a job kept would stay beside what the next one builds. There is one slot for all
    operators: a new key drops the old object and gives its memory back to the system first.
    """
    if key not in _slot:
        _slot.clear()
        gc.collect()
        give_back()
        _slot[key] = make()
        give_back()
    return _slot[key]


class Bounded(dict):
    """A cache of computed values by text, emptied before keys and values hold more than about ``room`` bytes."""

    def __init__(self, make: Callable, room: int = 16 << 20):
        super().__init__()
        self.make, self.room, self.used = make, room, 0

    def __missing__(self, key):
        value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        size = 200 + 4 * len(key)
        if self.used + size > self.room:
            self.clear()
            self.used = 0
        if size <= self.room // 16:
            self[key] = value
            self.used += size


def plain_text(name: str = "text") -> Column:
    """Whole text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(modulus: int) -> Column:
    """crc32 of the document id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """A function of one batch as a function for ``mapInArrow``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``most_bytes`` together; a longer text makes a part of its own."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def words_of(texts: pa.Array, split: Callable = pa.compute.split_pattern, **options) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of some texts: their codes, the bounds of each text among the codes, and the distinct words."""
    lists = split(texts, **options)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    encoded = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return encoded.indices.to_numpy(zero_copy_only=False), bounds - bounds[0], encoded.dictionary


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``docs`` is called so, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def decide(
    docs: DataFrame, make: Callable[[], Callable[[pa.Array], pa.Array]], name: str, kind: str, most_bytes: int = 2 << 20
) -> DataFrame:
    """``docs`` with one more column, computed from whole texts (null as empty) on the workers.

    ``make()`` gives, on the worker, a function of some texts. All columns go through as they are; ``name`` must be none
    of them, see ``free_name``.
    """
    rest = docs.schema.fields
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, "text", most_bytes):
                texts = pa.compute.fill_null(part.column("text").cast(pa.string()), "")
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), fn(texts)], [*names, name])

    shape = StructType([*rest, StructField(name, _parse_datatype_string(kind))])
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(lean(run), shape)


def drop_ids(docs: DataFrame, ids: DataFrame, shipped_rows: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows whose doc_id is among ``ids`` (a written table); a null id is never dropped.

    Up to ``shipped_rows`` ids are broadcast, so texts stay where they are; beyond, both sides are shuffled.
    """
    ids = ids.select(F.col("doc_id").cast("long").alias("dropped_id")).distinct()
    small = F.broadcast(ids) if ids.count() <= shipped_rows else ids
    return docs.join(small, docs["doc_id"] == small["dropped_id"], "left_anti")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of many runs, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between each two bounds; 0 where nothing is."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def labelled(docs: DataFrame, labels: DataFrame, mark: str, train: Column, per_class: int) -> DataFrame:
    """At most ``per_class`` training documents of either label (those of smallest id digest), with ``label`` 0 or 1.

    The bound makes the label side small enough to broadcast, whatever the corpus holds. A document labelled twice
    counts as 1 if any label is 1.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(mark).isNotNull())
        .where(train)
        .groupBy("doc_id")
        .agg(F.max(F.col(mark).cast("int")).alias("label"))
    )
    picks = [
        known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for value in (0, 1)
    ]
    sample = written(picks[0].unionByName(picks[1]), "label-sample")
    return docs.join(F.broadcast(sample.withColumnRenamed("doc_id", "labelled_id")), F.col("doc_id") == F.col("labelled_id"))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of an undirected graph given as (a, b) longs; component is the smallest node reachable.

    Large-star and small-star rounds: each round hangs nodes under smaller ones, so even a long chain needs a
    logarithmic number. Every round is a table in the shared folder. Stars are aggregates and joins; a hub is an
    ordinary join key that adaptive execution can split.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, name)
    before = None
    while True:
        digest = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if digest == before or not digest["n"]:
            roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = digest
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, name)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        for old in (least, large, low, edges):
            remove(old)
        edges = after

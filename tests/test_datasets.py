import re

from pyspark.sql import functions as F

from tabloom.operators import datasets
from tabloom.operators.scoring import scored
from tabloom.sources.tables import order_tables

TUPLE = ["status", "priority", "year"]


def test_single_table_samples(spark, sf_dir):
    rel = order_tables(spark, sf_dir).filter("table_id < 6")
    made = datasets.single_table(rel, "table_id", TUPLE, "price", "USD", 42).toPandas()
    assert set(made.method) == set(datasets.METHODS)
    assert set(made.perturbation) == {"none", *datasets.BEFORE_PIVOT, *datasets.AFTER_PIVOT, datasets.MIXED}
    assert not made.duplicated(["table_id", "method", "perturbation"]).any()
    clean = made[(made.perturbation == "none") & (made.method == "extractive")]
    # the answer of a lookup is a cell of the clean table
    shown = [re.sub(r"\.0$", "", f"{float(label):.2f}".rstrip("0").rstrip(".")) for label in clean.label]
    assert len(clean) and all(value in page for value, page in zip(shown, clean.html))
    assert made.html.str.startswith("<table><thead><tr>").all()


def test_text_steps_run_on_a_stream(spark, sf_dir, tmp_path):
    """Row-level operators take a streaming frame as it is."""
    rows = [(f"so\nFinal answer: {i}%", str(i if i % 2 else -1), "sum") for i in range(10)]
    batch = spark.createDataFrame(rows, "output string, label string, method string")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = scored(stream).select("prediction", "match").writeStream.format("memory").queryName("scored_stream").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.table("scored_stream").collect()))
    assert got == sorted(map(tuple, scored(batch).select("prediction", "match").collect()))
    assert sum(m for _, m in got) == 5


def test_bundles_must_be_complete(spark):
    tables = spark.createDataFrame([(0, p) for p in range(5)] + [(1, p) for p in range(3)], "s int, p int")
    got = datasets.complete_bundles(tables, "s", "p").groupBy("s", "bundle").agg(F.count("*").alias("n")).collect()
    assert {(r.s, r.bundle): r.n for r in got} == {(0, 2): 2, (0, 3): 3, (0, 5): 5, (1, 2): 2, (1, 3): 3}

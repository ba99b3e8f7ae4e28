"""All stages of the pipeline on odd tables, and columns whose names the stages use themselves."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from tabloom.llm import common, language, ngram_join, toxicity

LABELS = "doc_id long, quality int, toxic int"


def stage_folder(spark, tmp_path, labels, benchmark):
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_take_odd_and_empty_tables(spark, odd, empty, tmp_path):
    folder = stage_folder(spark, tmp_path, [(1, 1, 0), (None, 1, 1), (2, None, None)], [(1, "a test item about nothing at all"), (2, None), (3, "")])
    for docs in (odd, empty):
        columns = docs.columns
        before = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = common.written(stage(spark, docs, folder), name)
            after = docs.count()
            assert after <= before, name
            before = after
            if name != "bpe":
                assert docs.columns == columns, name
        assert {"doc_id", "n_tokens", "ids", "decoded_sha256"} <= set(docs.columns)


def test_clean_documents_go_through_and_copies_do_not(spark, tmp_path):
    words = "the river runs quietly past old mills while farmers carry grain over stone bridges toward distant markets every autumn".split()
    texts = [" ".join(words[(i * 7 + k * (i + 1)) % len(words)] + chr(97 + (i + k) % 26) for k in range(40)) for i in range(30)]
    rows = [(i, t, "en", "s", 1, "x") for i, t in enumerate(texts)] + [(100 + i, t, "en", "s", 1, "x") for i, t in enumerate(texts[:5])]
    item = "which of these seven famous bridges was crossed first by the old emperor on his way north"
    rows.append((200, f"{texts[3][:100]} {item} {texts[4][:100]}", "en", "s", 1, "x"))
    folder = stage_folder(spark, tmp_path, [(i, 1, 0) for i in range(30)], [(1, item)])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, folder), name)
    kept = {r.doc_id: r for r in docs.collect()}
    assert set(kept) == set(range(30))
    assert all(r.n_tokens == len(r.ids) for r in kept.values())


def test_no_stage_takes_a_user_column(spark, odd):
    names = ["toxicity_found", "language_found", "copy_place", "Toxicity_Found_", "dropped_id"]
    docs = odd
    for name in names:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    for kept in (language.keep_identified(docs), toxicity.keep_civil(docs, labels), ngram_join.keep_first(docs)):
        assert kept.columns == docs.columns
        assert all(r[name] == f"own {name}" for r in kept.collect() for name in names)
    assert common.free_name(docs, "toxicity_found") == "toxicity_found__"


def test_a_worker_keeps_one_thing_and_caches_are_bounded():
    made = []
    for key in (("a",), ("a",), ("b",), ("a",)):
        common.on_worker(key, lambda: made.append(1) or len(made))
    assert len(made) == 3
    cache = common.Bounded(str.upper, 10_000)
    assert [cache[f"w{i}"] for i in range(500)] == [f"W{i}" for i in range(500)]
    assert cache.used <= 10_000 and len(cache) < 60
    assert cache["x" * 5000] == "X" * 5000 and not any(re.fullmatch("x{5000}", k) for k in cache)

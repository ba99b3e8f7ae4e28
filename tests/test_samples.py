"""Samples of tables that are held as arrays, and of tables that are cut by joins."""

import pytest
from tabloom.operators import datasets, pivot
from tabloom.session import materialise

COLUMNS = ["a", "b", "c"]
SCHEMA = "table_id long, row_id long, a string, b string, c string, price double"


@pytest.fixture(scope="module")
def rel(spark):
    rows = [
        (t, 1000 * t + 100 * i + 10 * j + k, f"a{i}", f"b{j}", f"<{k}>", 10.5 * i + j + k / 4)
        for t in range(1, 5)
        for i in range(3)
        for j in range(t + 1)
        for k in range(2)
        if (i + j + k) % (t + 2)
    ]
    rows += [(9, 90_000 + 30 * i + j, f"a{i}", f"b{j}", f"c{j % 2}", float(i * j)) for i in range(30) for j in range(30)]
    rows += rows[:2]  # twice the same row
    odd = [(1, 50, "a0", None, "<0>", 4.0), (1, 51, "a7", "b7", "<1>", None), (None, 52, "a0", "b0", "<0>", 1.0), (3, None, "a1", "b9", "<0>", 2.0)]
    return spark.createDataFrame(rows + odd, SCHEMA)


def single(rel, most):
    made = datasets.single_table(rel, "table_id", COLUMNS, "price", "USD", 42, most=most)
    return sorted(map(tuple, made.select("table_id", "method", "perturbation", "label", "question", "sql_query", "html").collect()))


def test_both_ways_give_the_same_samples(rel):
    """One table of 900 rows is large in the first run, every table in the second."""
    some, every = single(rel, 500), single(rel, 0)
    assert {r[0] for r in some} >= {1, 9} and {r[2] for r in some} >= {"merge_columns", "typos", "all_perturbations"}
    assert some == every


def test_samples_show_at_most_ten_lines_and_all_needed_cells(rel):
    chosen = datasets.chosen_cells(rel, "table_id", COLUMNS, "price", 42).cache()
    labels = datasets.sample_labels(chosen, "table_id", "price", 42)
    shown = datasets.shown_samples(rel, chosen, labels, "table_id", COLUMNS, "price", 42).collect()
    asked = {}
    for r in chosen.collect():
        asked.setdefault((r.table_id, r.method), set()).add(r.row_id)
    low, high = pivot.SHRINK_RANGE
    for s in shown:
        assert {x.row_id for x in s.cells if x.needed} == asked[s.table_id, s.method]
        for side in "rc":
            assert low <= len({x[side] for x in s.cells}) <= high
        assert len({(x.r, x.c) for x in s.cells}) == len(s.cells)


def test_variants_move_no_rows(rel):
    """Tables, questions and labels meet once per table; what the perturbations do needs no further exchange."""
    chosen = materialise(datasets.chosen_cells(rel, "table_id", COLUMNS, "price", 42), "chosen")
    labels = materialise(datasets.sample_labels(chosen, "table_id", "price", 42), "labels")
    cells = datasets.variant_cells(rel.filter("table_id < 9"), chosen, labels, "table_id", COLUMNS, "price", 42, ["none", "merge_columns", datasets.MIXED])
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("Exchange hashpartitioning") <= 3, plan  # rows, chosen cells, labels
    assert not any(step in plan for step in ("Window", "Expand", "Union", "Exchange SinglePartition")), plan

"""Notes, typos and pages of pivots held as arrays, against the operators on tables of cells."""

import pytest
from pyspark.sql import functions as F
from tabloom.functions.arrays import let
from tabloom.operators import datasets, pages, perturb

MARK = perturb.PATH_MARK
VALUES = [None, "", "12", "n.a.", " - ", "1.5", "1.5 USD", "<b>&", "٣x٤yz", "a\nb", "-7.25 (3.0)", "year"]


@pytest.fixture(scope="module")
def tables():
    """Paths and values of a few tables, with labels that are digits only."""
    return {
        f"{t}|sum|typos": [(f"r{i}{MARK}{i}", f"{t}{j}" if j else f"a b-{i % 2}", VALUES[(t + 5 * i + j) % len(VALUES)]) for i in range(t) for j in range(4)]
        for t in range(1, 6)
    }


def test_noise_is_that_of_the_column(spark):
    rows = [(text, f"{i:08x}{i:024x}", s) for i, text in enumerate(10 * [v for v in VALUES if v is not None]) for s in (0, 20, 50, 100)]
    df = spark.createDataFrame(rows, "t string, h string, s int").withColumn("out", perturb.noisy(F.col("t"), F.col("h"), F.col("s")))
    for r in df.collect():
        assert pages.noisy(r.t, r.h, r.s) == r.out


@pytest.mark.parametrize("strength", [20, 50])
def test_notes_and_typos_are_those_of_the_table_operators(spark, tables, strength):
    flat = [(t, r.split(MARK), c.split(MARK), v) for t, cells in tables.items() for r, c, v in cells]
    cells = spark.createDataFrame(flat, "t string, row_path array<string>, col_path array<string>, value string")
    for path in ("row_path", "col_path"):
        cells = cells.withColumn(path[0], F.array_join(path, "|"))
    noted = {(x.t, x.r, x.c): x.value for x in perturb.add_notes(cells, "t", ["r", "c"], "value", 7, strength).collect()}
    typos = sorted(map(tuple, perturb.typos(cells, "t", 7, strength).select("t", "row_path", "col_path", F.coalesce("value", F.lit("null"))).collect()))
    forms = {x.t: x.n for x in cells.select("t", perturb.note_templates(7, "t").alias("n")).distinct().collect()}
    found, changed = [], 0
    for t, listed in tables.items():
        r, c, values = zip(*listed)
        for row, col, old, new in zip(r, c, values, pages.noted(r, c, values, t, 7, strength, forms[t])):
            assert noted[t, row.replace(MARK, "|"), col.replace(MARK, "|")] == new
            changed += old != new
        found += [(t, a.split(MARK), b.split(MARK), "null" if v is None else v) for a, b, v in zip(*pages.mistyped(r, c, values, t, 7, strength))]
    assert changed and sorted(found) == typos


def test_page_has_its_blank_lines_and_header():
    cells = zip(("x", f"1{MARK}a", "<1>"), ("x", f"2{MARK}a", None), ("y", f"2{MARK}a", "5"), ("y", f"2{MARK}a", "late"))
    got = pages.page(*cells, "p (USD)", False, [0.99], [0.5])
    head = "<tr><th></th><th>1</th><th></th><th>2</th></tr><tr><th></th><th>a</th><th></th><th>a</th></tr>"
    lines = [("p (USD)", "p (USD)", "", ""), ("x", "&lt;1&gt;", "", ""), ("y", "", "", "5"), ("", "", "", "")]
    body = "".join(f"<tr><th>{name}</th>" + "".join(f"<td>{x}</td>" for x in texts) + "</tr>" for name, *texts in lines)
    assert got == f"<table><thead>{head}</thead><tbody>{body}</tbody></table>"


def test_pages_are_made_in_one_pass(spark):
    """What is drawn for a variant, its typos and its page need one pass of batches and no step of their own per perturbation."""
    rows = [(1, 10 * i + j, f"a{i}", f"b{j}", f"c{(i + j) % 3}", 1.5 * i + j) for i in range(4) for j in range(4)]
    rel = spark.createDataFrame(rows, "table_id long, row_id long, a string, b string, c string, price double")
    made = datasets.single_table(rel, "table_id", ["a", "b", "c"], "price", "USD", 42)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, plan
    assert "Generate" not in plan[: plan.index("size(cells")], plan


def test_let_binds_once_without_copies(spark):
    twice = let(F.array("x", "x"), lambda a: let(F.size(a), lambda n: F.struct(a.alias("a"), n.alias("n"))))
    df = spark.range(2).select(F.when(F.col("id") > 0, F.col("id")).alias("x")).select(twice.alias("s"))
    assert sorted((r.s.n, r.s.a[0] or 0) for r in df.collect()) == [(2, 0), (2, 1)]
    assert "aggregate(" in df._jdf.queryExecution().analyzed().toString()

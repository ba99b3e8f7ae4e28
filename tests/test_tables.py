"""Ranking, keys, pivots, rules, units, HTML and perturbations against brute force."""

import difflib
import io
import random
from contextlib import redirect_stdout

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions.sampling import digest
from tabloom.functions.text import normalize_label
from tabloom.operators import joins, keys, locate, perturb, pivot, rules, units, views
from tabloom.operators.ranking import hash_ranked, ordered_positions, top_rows
from tabloom.sources import files, html


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key."""
    rows = [(0 if i % 3 == 0 else i % 50, i) for i in range(6000)]
    return spark.createDataFrame(rows, "k int, v int").withColumn("h", digest(1, "t", "v"))


def test_hash_rank_of_hot_group(skewed):
    pdf = skewed.toPandas()
    want = pdf.assign(rn=pdf.groupby("k").h.rank().astype(int), n=pdf.groupby("k").v.transform("count"))
    for slices in (1, 7, 4096):
        got = hash_ranked(skewed, ["k"], "h", ["v"], "rn", "n", slices).toPandas()
        both = got.merge(want, on="v")
        assert len(both) == 6000 and (both.rn_x == both.rn_y).all() and (both.n_x == both.n_y).all()


def test_positions_follow_order(skewed):
    df = skewed.withColumn("turn", F.col("v") % 11)
    got = ordered_positions(df, ["k"], "turn", "h").toPandas().sort_values(["k", "position"])
    for _, part in got.groupby("k"):
        assert part.position.tolist() == list(range(len(part)))
        assert part.turn.is_monotonic_increasing


def test_top_rows_cut_before_the_shuffle(skewed):
    assert "WindowGroupLimit" in plan_of(top_rows(skewed, ["k"], ["h"], 3))


def test_unique_key_search_matches_pandas(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice("xyz"), rng.choice("pq"), rng.choice("mn")) for _ in range(14)]
    cols = list("cdef")
    pdf = pd.DataFrame(rows, columns=cols)
    want = None
    for subset in keys.column_subsets(cols):
        counts = pdf.groupby(subset).size()
        if (counts == 1).any():
            want = (subset, sorted(counts[counts == 1].index.tolist()))
            break
    found = keys.unique_key_search(spark.createDataFrame(rows, cols), cols).toPandas()
    assert sorted(tuple(r) for r in found[want[0]].to_numpy().tolist()) == want[1]


def test_clusters_match_union_find(spark):
    rng = random.Random(3)
    cols = ["a", "b", "c"]
    rows = [(i, f"a{rng.randint(0, 30)}", f"b{rng.randint(0, 30)}", f"c{rng.randint(0, 4)}") for i in range(40)]
    pdf = pd.DataFrame(rows, columns=["row", *cols])
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(cols):
        for y in cols[i + 1:]:
            single_x = set(pdf[x].value_counts().loc[lambda s: s == 1].index)
            single_y = set(pdf[y].value_counts().loc[lambda s: s == 1].index)
            for _, r in pdf.iterrows():
                if r[x] in single_x and r[y] in single_y:
                    parent[find((x, r[x]))] = find((y, r[y]))
    want = {}
    for node in list(parent):
        want.setdefault(find(node), set()).add(node)
    df = spark.createDataFrame(pdf).withColumn("t", F.lit(1))
    got = keys.value_clusters(keys.single_values(df, ["t"], "row", cols), ["t"]).toPandas()
    groups = {frozenset(zip(p.col, p.value)) for _, p in got.groupby("cluster_id")}
    assert groups == {frozenset(v) for v in want.values()}


def test_density_equals_pandas_pivot(spark):
    rng = random.Random(1)
    pdf = pd.DataFrame([(rng.choice("ab"), rng.choice("xyz"), rng.choice("pqr"), rng.random()) for _ in range(12)], columns=list("abcv"))
    wide = pd.pivot_table(pdf, values="v", index=["a"], columns=["b", "c"], aggfunc="mean")
    got = pivot.density(spark.createDataFrame(pdf), [], ["a"], ["b", "c"]).collect()[0]
    assert (got.pivot_rows, got.pivot_columns) == wide.shape
    assert got.density == pytest.approx(wide.notna().to_numpy().mean())


def test_split_search_prefers_full(spark):
    rows = [("t", a, b, c) for a in "ab" for b in "xy" for c in "pq"] + [("u", "a", "x", "p"), ("u", "b", "y", "q")]
    got = {r.t: r for r in pivot.split_search(spark.createDataFrame(rows, "t string, a string, b string, c string"), ["t"], ["a", "b", "c"], 1).collect()}
    assert got["t"].density == 1.0 and got["u"].density == 0.5


def test_trim_keeps_a_full_block(spark):
    cells = [("k", r, c) for r in range(1, 13) for c in range(1, 13) if (r <= 6 and c <= 6) or r == c]
    got = pivot.trim_dense(spark.createDataFrame(cells, "k string, row_id int, col_id int"), "k", 3, 10).collect()[0]
    assert got.density == 1.0 and set(got.row_ids) <= set(range(1, 7))


def test_trim_is_the_greedy_rule():
    def greedy(m, low, high):
        rows, cols = list(range(m.shape[0])), list(range(m.shape[1]))

        def fill(r, c):
            return m[np.ix_(r, c)].sum() / (len(r) * len(c))

        def shorter(axis):
            if axis == 0:
                return [r for r in rows if r != min(rows, key=lambda x: (fill([x], cols), x))], cols
            return rows, [c for c in cols if c != min(cols, key=lambda x: (fill(rows, [x]), x))]

        while len(rows) > high or len(cols) > high:
            sides = [a for a, side in ((0, rows), (1, cols)) if len(side) > high]
            least = {0: min(fill([x], cols) for x in rows), 1: min(fill(rows, [x]) for x in cols)}
            rows, cols = shorter(min(sides, key=lambda a: (least[a], a)))
        while sides := [a for a, side in ((0, rows), (1, cols)) if len(side) > low]:
            best = max(sides, key=lambda a: (fill(*shorter(a)), -a))
            if fill(*shorter(best)) <= fill(rows, cols):
                break
            rows, cols = shorter(best)
        return rows, cols

    for seed in range(30):
        rng = np.random.default_rng(seed)
        m = (rng.random((rng.integers(2, 14), rng.integers(2, 14))) < rng.random()).astype(np.uint8)
        got = pivot._trim(m, 3, 8)
        assert got is None if min(m.shape) < 3 else [list(g) for g in got] == [list(g) for g in greedy(m, 3, 8)]


def test_links_take_null_keys_as_equal(spark):
    rows = [("a", 1, 1), ("b", 1, 2), ("c", 1, 2), ("d", None, 1), ("e", None, 2), ("f", 3, 2), ("g", 4, 1)]
    df = spark.createDataFrame(rows, "row string, k int, line int")
    got = joins.inter_row_links(df, ["k"], "row", F.col("line") == 1, F.col("line") == 2).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", "b", "link"), (None, "c", "ambiguous"), ("d", "e", "link")], key=str)


def test_domain_product_names_what_it_refuses(spark):
    df = spark.createDataFrame([("t", [1, 2], [1, 2, 3]), ("u", [1], [1])], "t string, a array<int>, b array<int>")
    domains = {"x": "a", "y": "b"}
    assert joins.domain_product(df, domains).count() == 7
    assert joins.domain_product(df, domains, 5).count() == 1
    assert [(r.t, r.combinations) for r in joins.refused_products(df, domains, 5).collect()] == [("t", 6)]


def test_shrink_keeps_needed_cells(spark):
    cells = [("t", [str(r)], [str(c)], f"{r}-{c}", (r, c) in {(3, 4), (40, 17)}) for r in range(50) for c in range(20)]
    df = spark.createDataFrame(cells, "t string, row_path array<string>, col_path array<string>, value string, needed boolean")
    got = pivot.shrink(df, "t", 1).toPandas()
    assert got.row_path.map(tuple).nunique() == 10 and got.col_path.map(tuple).nunique() == 10
    assert got.needed.sum() == 2


def test_repair_holds_all_rules(spark):
    rng = random.Random(2)
    rows = [(o, f"{o}-{s}-{i}", s, lo := rng.randint(0, 500), lo + rng.randint(0, 700)) for o in range(60) for s in (1, 2, 3) for i in range(rng.randint(0, 2))]
    df = spark.createDataFrame(rows, "o int, row string, step int, lo long, hi long")
    got = rules.repair_chain(df, ["o"], "row", "step", [1, 2, 3], "lo", "hi", 9).toPandas()
    limits = {r[1]: (r[3], r[4]) for r in rows}
    assert {"kept", "unsatisfiable"} == set(got.state)
    for _, chain in got[got.state == "kept"].sort_values("step").groupby("o"):
        assert chain.value.is_monotonic_decreasing
        assert all(limits[r][0] <= v <= limits[r][1] for r, v in zip(chain.row, chain.value))


def test_upstream_rules():
    listed = [("a", "x = 1", "y > 2"), ("b", "y = 3", "z = 'x'"), ("c", "z = 'y'", "w = 1")]
    assert rules.upstream(listed, ["x", "y", "z", "w"]) == {"a": set(), "b": {"a"}, "c": {"a", "b"}}


CONVERSIONS = [
    ("healthcare", 500.0, "mg", "g", 0.5), ("healthcare", 12.0, "mL", "litre", 0.012), ("finance", 250.0, "bp", "percent", 2.5),
    ("finance", 3.0, "mio", "unit", 3e6), ("healthcare", 2.0, "kPa", "Pa", 2000.0), ("healthcare", 212.0, "degF", "Cel", 100.0),
]


def test_literal_conversions(spark):
    df = spark.createDataFrame([c[:4] for c in CONVERSIONS], "domain string, value double, from_unit string, to_unit string")
    got = units.lookup(df, units.dimension(spark)).withColumn("out", units.converted(F.col("value"))).collect()
    for row in got:
        want = next(c[4] for c in CONVERSIONS if c[1:4] == (row.value, row.from_unit, row.to_unit))
        assert row.convertible and row.out == pytest.approx(want, abs=1e-9)


def test_units_that_do_not_convert(spark):
    rows = [("finance", "USD", "million"), ("finance", "percent", "million"), ("finance", "x", "unit")]
    df = spark.createDataFrame(rows, "domain string, from_unit string, to_unit string")
    assert not any(r.convertible for r in units.lookup(df, units.dimension(spark)).collect())
    targets = units.random_target(spark.createDataFrame([("finance", "USD")], "domain string, u string"), units.dimension(spark), "u", 1, "x", "u")
    row = targets.collect()[0]
    assert row.surrogate == "unit" and row.to_unit in {"thousand", "million", "billion", "trillion", "k", "thousands", "mn", "millions", "mio", "bn", "billions", "tn", "trillions"}


SPANS = """<table><tr><th rowspan=2>a</th><th colspan="2">b &amp; c</th></tr><tr><th>d</th><th>e<br>f</th></tr>
<TR><th>g</th><td>1</td></TR></table>"""


def test_spans_and_header_depth(spark):
    df = spark.createDataFrame([(1, SPANS), (2, "<table><tr><td>x</td></tr></table>")], "id int, h string")
    got = html.html_cells(df, ["id"], "h").toPandas()
    one = got[got.id == 1].pivot(index="row", columns="col", values="text")
    assert one.to_numpy().tolist() == [["a", "b & c", "b & c"], ["a", "d", "e f"], ["g", "1", ""]]
    assert got.groupby("id")[["header_rows", "header_cols"]].first().to_numpy().tolist() == [[2, 1], [0, 0]]
    assert got[(got.id == 1) & got.source.isna()][["row", "col"]].to_numpy().tolist() == [[2, 2]]


def test_tables_in_text_and_back(spark):
    source = "x <table a>1</table> y <TABLE>\n2</TABLE> z"
    df = spark.createDataFrame([(1, source)], "id int, t string")
    rows = html.tables_in_text(df, ["id"], "t").orderBy("table_no").collect()
    assert [source[r.start:r.end] for r in rows] == [r.table_html for r in rows] and len(rows) == 2
    swapped = df.select(html.replace_tables(F.col("t"), F.array(F.lit("A"), F.lit("B"))).alias("t")).collect()[0].t
    assert swapped == "x A y B z"
    with pytest.raises(Exception, match="expected 2 tables"):
        df.select(html.replace_tables(F.col("t"), F.array(F.lit("A")))).collect()


def test_typos_never_move_digits(spark):
    texts = ["Net income 2021", "12.50 USD", "ab", "7", "", "cash & equivalents (2)", "a٣b", None]
    rows = [(t, f"{i}", strength) for strength in (20, 100) for i in range(40) for t in texts]
    df = spark.createDataFrame(rows, "t string, seed string, strength int")
    kinds = set()
    for r in df.withColumn("out", perturb.noisy(F.col("t"), F.col("seed"), F.col("strength"))).collect():
        if r.t is None:
            assert r.out is None
            continue
        seen = [c for c in r.out if c not in perturb.INVISIBLE]
        assert [c for c in r.out if c.isdigit()] == [c for c in r.t if c.isdigit()]
        assert sorted(seen) == sorted(r.t)
        kinds.add((len(r.out) > len(r.t), "".join(seen) != r.t))
        assert r.out != r.t or r.t in ("ab", "Net income 2021", "cash & equivalents (2)", "12.50 USD")
    assert kinds >= {(True, False), (False, True)}


def test_notes_and_nulls(spark):
    cells = [("t", i, "n.a." if i % 4 == 0 else f"v{i}") for i in range(100)]
    df = spark.createDataFrame(cells, "t string, i int, value string")
    got = perturb.add_notes(df, "t", ["i"], "value", 3, 20).toPandas().sort_values("i")
    changed = [a for a, b in zip(got.value, (c[2] for c in cells)) if a != b]
    assert len(changed) == 15 and all("v" in c for c in changed)
    assert (got.value[got.i % 4 == 0] == "n.a.").all()


def test_blanks_keep_the_order_of_lines(spark):
    df = spark.createDataFrame([(t, p) for t in range(30) for p in range(7)], "t int, p int")
    got = perturb.insert_blanks(df, "t", "p", 5, "x").toPandas().sort_values(["t", "position"])
    for _, part in got.groupby("t"):
        assert part.position.tolist() == list(range(len(part))) and 8 <= len(part) <= 10
        assert part.old_position.dropna().astype(int).tolist() == list(range(7))


def test_similarity_matches_difflib(spark):
    words = ["Net income", "income net", "net", "Total Assets 2020", "total assets", "", "Größe", "net_income"]
    pairs = [(a, b) for a in words for b in words]

    def want(a, b):
        if not a or not b:
            return 0.0
        if a == b:
            return 1.0
        ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
        inside = min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else 0.0
        return max(ratio(a, b), ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), inside)

    df = spark.createDataFrame(pairs, "a string, b string").select(normalize_label(F.col("a")).alias("a"), normalize_label(F.col("b")).alias("b"))
    for r in locate.with_similarity(df, "a", "b").collect():
        assert r.similarity == pytest.approx(want(r.a, r.b))


def test_locate_and_mask(spark):
    page = "<table><tr><th></th><th>2020</th><th>2021</th></tr><tr><th>Sales</th><td>10</td><td>12</td></tr><tr><th>Costs</th><td>12</td><td>9</td></tr></table>"
    cells = html.html_cells(spark.createDataFrame([(1, page)], "t int, h string"), ["t"], "h")
    body = html.body_with_paths(cells, ["t"])
    ask = spark.createDataFrame([(1, "amount", [("item", ["Costs"]), ("year", ["2021"])])], "t int, select_field string, predicates array<struct<field:string,values:array<string>>>")
    found = locate.locate(body, ask, "t")
    assert [(r.row, r.col, r.answer) for r in found.collect()] == [(2, 2, "9")]
    previous = spark.createDataFrame([(1, "12")], "t int, previous string")
    matches = locate.previous_matches(body, previous, "t")
    assert locate.previous_location(matches, "t").collect()[0].kind == "body"
    masked = locate.mask_previous(cells, matches, found, "t").toPandas()
    assert sorted(map(tuple, masked[masked.masked][["row", "col"]].to_numpy().tolist())) == [(1, 2), (2, 1)]


def test_cap_rows_of_hot_table(spark):
    rows = [(0, i, i % 10 == 9) for i in range(50)] + [(1, i, False) for i in range(30)] + [(2, i, True) for i in range(12)]
    got = views.cap_rows(spark.createDataFrame(rows, "t int, i int, needed boolean"), "t", "i", columns=10).toPandas()
    assert got.groupby("t").size().to_dict() == {0: 10, 1: 10, 2: 12}
    assert sorted(got[got.t == 0].i) == [0, 1, 2, 3, 4, 9, 19, 29, 39, 49]


def test_missing_columns_and_names(spark):
    df = spark.createDataFrame([(1, 2)], "`a (x)` int, b int")
    assert views.sanitize_identifiers(df).columns == ["ax", "b"]
    with pytest.raises(ValueError, match="missing"):
        views.require(df, ["c"])
    with pytest.raises(ValueError):
        views.rename_display(df, ["only one"])


def test_empty_csv_keeps_its_schema(spark, tmp_path):
    (tmp_path / "data.csv").write_text("question,label\n")
    assert files.read_csv(spark, str(tmp_path / "data.csv"), "question string, label string").count() == 0


def test_partition_pruning_of_datasets(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "d", m, p) for m in "ab" for p in "xy"], "id int, num_tables int, domain string, method string, perturbation string")
    files.write_dataset(df, str(tmp_path / "out"))
    got = files.read_dataset(spark, str(tmp_path / "out"), method="a", perturbation="x")
    assert "PartitionFilters: [isnotnull" in plan_of(got) and got.count() == 1

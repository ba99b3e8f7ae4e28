"""Links and linear rules, keys of any size, chains and catalogues against brute force and fixtures."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabloom.operators import catalogue, chains, discovered, keys, links, pivot, scoring
from tabloom.operators.links import LinearRule

RULES = [
    LinearRule("sum", (("kind = 'a'", 1), ("kind = 'b'", 1), ("kind = 'c'", -1)), ">=", 10),
    LinearRule("gap", (("kind = 'c'", 2), ("kind = 'd'", -3)), "<=", 5),
    LinearRule("same", (("kind = 'd'", 1), ("kind = 'e'", -1)), "=", 0),
    LinearRule("less", (("kind = 'e'", 1), ("kind = 'f'", 1)), "<", 60),
]


def brute_links(rows, rules):
    """rows: (row, key, kind). Links and ambiguous rows, rule by rule on what is left."""
    left, found, removed = list(rows), [], []
    for rule in rules:
        kinds = [s.split("'")[1] for s, _ in rule.terms]

        def matches(some, key, kind):
            return sorted(r for r, k, c in some if k == key and c == kind)

        gone = set()
        for _, key, kind in left:
            if kind != kinds[0]:
                continue
            for later in kinds[1:]:
                here = matches(left, key, later)
                gone |= set(here[1:])
                if not here:
                    break
        removed += [(r, rule.id) for r in gone]
        left = [x for x in left if x[0] not in gone]
        for r, key, kind in left:
            firsts = [matches(left, key, k)[:1] for k in kinds[1:]]
            if kind == kinds[0] and all(firsts):
                found.append((rule.id, [r, *[f[0] for f in firsts]]))
    return sorted(found), sorted(removed)


def linked_table(spark, seed, tables=60):
    pick = random.Random(seed)
    rows = []
    for t in range(tables):
        for kind in "abcdef":
            for _ in range(pick.choice([0, 1, 1, 1, 2])):
                lo = pick.randint(0, 60)
                rows.append((len(rows), t if t else None, kind, pick.randint(0, 60), lo, lo + pick.randint(0, 40)))
    return rows, spark.createDataFrame(rows, "row long, tab long, kind string, value long, lo long, hi long")


def test_links_of_any_number_of_terms(spark):
    rows, df = linked_table(spark, 1)
    found, removed = links.link_rows(df, RULES, "row", "value", ["lo", "hi"])
    want = brute_links([(r[0], r[1], r[2]) for r in rows], RULES)
    assert sorted((r.rule_id, list(r.rows)) for r in found.collect()) == want[0]
    assert sorted((r.row, r.rule_id) for r in removed.collect()) == want[1]


def test_links_meet_once_per_key(spark, monkeypatch):
    """One table of results for all rules; crowded keys and names that stand for several rows give the same links."""
    rows, df = linked_table(spark, 5, 20)
    want = brute_links([(r[0], r[1], r[2]) for r in rows], RULES)

    def shown(frames):
        return sorted((r.rule_id, list(r.rows)) for r in frames[0].collect()), sorted((r.row, r.rule_id) for r in frames[1].collect())

    written, real = [], links.materialise
    monkeypatch.setattr(links, "materialise", lambda some, name: written.append(name) or real(some, name))
    assert shown(links.link_rows(df, RULES, "row", "value", ["lo", "hi"])) == want
    assert "ambiguous" not in written and written.count("links") == 1
    assert shown(links.link_rows(df, RULES, "row", "value", ["lo", "hi"], most=6)) == want
    assert "ambiguous" in written
    # the name 9 is ambiguous in one key and leaves the other too
    twice = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 0, "c"), (9, 0, "c"), (5, 1, "a"), (6, 1, "b"), (9, 1, "c")], "row long, tab long, kind string")
    made, gone = links.link_rows(twice.withColumn("value", F.lit(0)), RULES[:1], "row", "value")
    assert shown((made, gone)) == ([("sum", [1, 2, 3])], [(9, "sum")])


def test_selectors_must_read_the_same_columns(spark):
    _, df = linked_table(spark, 1, 2)
    with pytest.raises(ValueError):
        links.link_rows(df, [LinearRule("x", (("kind = 'a'", 1), ("tab = 1", 1)), ">=", 0)], "row", "value")
    with pytest.raises(ValueError):
        links.link_rows(df, [LinearRule("x", (("true", 1), ("false", 1)), ">=", 0)], "row", "value")


def test_repaired_values_meet_bounds_and_every_rule(spark):
    for seed in (2, 3):
        rows, df = linked_table(spark, seed)
        done = {r.row: r for r in links.repair(df, RULES, "row", "value", "lo", "hi", 7).collect()}
        assert sorted(done) == [r[0] for r in rows]
        states = Counter(r.state for r in done.values())
        assert states["kept"] > 100 and states["ambiguous"] and states["unsatisfiable"] and states["undecided"] * 20 <= states["kept"]
        given = {r[0]: r for r in rows}
        for r in done.values():
            assert (r.value is not None) == (r.state == "kept")
            if r.state == "kept":
                assert given[r.row][4] <= r.lo <= r.value <= r.hi <= given[r.row][5]
        table = [(i, given[i][1], given[i][2]) for i, r in done.items() if r.state != "ambiguous"]
        for rule_id, linked in brute_links(table, RULES)[0]:
            rule = next(r for r in RULES if r.id == rule_id)
            if all(done[i].state == "kept" for i in linked):
                total = sum(c * done[i].value for i, (_, c) in zip(linked, rule.terms, strict=True))
                low, high = rule.limits()
                assert (low is None or total >= low) and (high is None or total <= high)


def test_chained_equalities_are_propagated_to_the_end(spark):
    n = 12
    steps = [LinearRule(f"r{i}", ((f"at = {i}", 1), (f"at = {i + 1}", -1)), "=", 1) for i in range(n)]
    df = spark.createDataFrame([(i, 0, i, 0, 0, 100) for i in range(n)] + [(n, 0, n, 0, 7, 7)], "row long, tab long, at long, value long, lo long, hi long")
    done = {r.row: r for r in links.repair(df, steps, "row", "value", "lo", "hi", 1).collect()}
    assert {i: done[i].value for i in done} == {i: 7 + n - i for i in range(n + 1)}


def test_rows_that_chase_each_other_are_named(spark):
    cycle = [LinearRule("up", (("at = 0", 1), ("at = 1", -1)), ">", 0), LinearRule("down", (("at = 1", 1), ("at = 0", -1)), ">", 0)]
    df = spark.createDataFrame([(0, 0, 0, 0, 10), (1, 1, 0, 0, 10), (2, 5, 3, 0, 10)], "row long, at long, value long, lo long, hi long")
    done = {r.row: r.state for r in links.repair(df, cycle, "row", "value", "lo", "hi", 1).collect()}
    assert sorted(done) == [0, 1, 2] and not (done[0] == "kept" and done[1] == "kept")


def brute_keys(rows, n):
    """rows: (group, row, values): smallest column set with a unique tuple, and its rows."""
    found = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        for places in (list(c) for size in range(1, n + 1) for c in itertools.combinations(range(n), size)):
            tuples = Counter(tuple(r[2][p] for p in places) for r in own)
            unique = sorted(r[1] for r in own if None not in (t := tuple(r[2][p] for p in places)) and tuples[t] == 1)
            if unique:
                found[g] = (places, unique)
                break
        else:
            found[g] = (None, [None])
    return found


def test_smallest_keys_equal_brute_force(spark):
    pick = random.Random(4)
    rows = []
    for g in [None, *range(30)]:
        wide = pick.choice([1, 2, 3, 4])
        for _ in range(pick.choice([1, 6, 25])):
            rows.append((g, len(rows), [pick.choice([None, *range(wide)][pick.choice([0, 1, 1, 1]):]) for _ in range(5)]))
        for r in rows[-3:]:
            rows.append((g, len(rows), r[2])) if r[0] == g else None
    df = spark.createDataFrame([(g, r, *v) for g, r, v in rows], "g long, row long, c0 long, c1 long, c2 long, c3 long, c4 long")
    got = {}
    for r in keys.smallest_keys(df, ["g"], "row", [f"c{i}" for i in range(5)]).collect():
        got.setdefault(r.g, []).append((r.places, r.row))
    want = brute_keys(rows, 5)
    assert {g: (v[0][0], sorted((x[1] for x in v), key=str)) for g, v in got.items()} == {g: (p, sorted(u, key=str)) for g, (p, u) in want.items()}
    assert any(p is None for p, _ in want.values()) and any(p and len(p) > 2 for p, _ in want.values())


def test_key_search_writes_tuples_not_rows(spark, monkeypatch):
    """What the search writes grows with the distinct tuples; a row name that comes twice stands for both of its rows."""
    written, real = [], keys.materialise
    monkeypatch.setattr(keys, "materialise", lambda df, name: written.append(real(df, name)) or written[-1])
    rows = [(g, f"{g}-{i}", i % 2, i % 3, i % 2) for g in range(4) for i in range(300)]
    df = spark.createDataFrame([*rows, (9, "r", 1, 1, 1), (9, "r", 1, 2, 2), (9, "s", 2, 1, 2), (9, "t", 2, 2, 1)], "g long, row string, a long, b long, c long")
    got = sorted((r.g, r.places, r.row) for r in keys.smallest_keys(df, ["g"], "row", ["a", "b", "c"]).collect())
    assert got == [(g, None, None) for g in range(4)] + [(9, [0, 1], r) for r in ("r", "r", "s", "t")]
    assert sum(t.count() for t in written) < 100


def test_catalogue_finds_the_full_grid_and_lists_what_it_refuses(spark):
    """A product dimension of 6 categories and 5 brands with every combination: density 1, 6 x 5 and 5 x 6."""
    rows = [(i, f"c{i % 6}", f"b{i // 6 % 5}", f"s{i % 7}", 1.5 + i % 11) for i in range(240)]
    products = spark.createDataFrame(rows, "product_key int, category string, brand string, series string, unit_price double")
    small = products.limit(8)
    found = catalogue.dense_pivots(spark, "shop", {"dim_product": products, "few_rows": small, "narrow": products.select("category", "unit_price")})
    pivots = {(r.row_attributes, r.column_attributes): r for r in found.pivots.collect()}
    golden = pivots["category", "brand"]
    assert (golden.pivot_rows, golden.pivot_columns, golden.pivot_cells, golden.non_nan_density) == (6, 5, 30, 1.0)
    assert (golden.source_rows, golden.source_columns, golden.relation_type, golden.total_header_levels) == (240, 5, "table", 2)
    assert {r.relation for r in pivots.values()} == {"dim_product"}
    tuples = {tuple(r[1:4]) for r in rows}
    sides = [("category",), ("brand",), ("series",), ("category", "brand"), ("category", "series"), ("brand", "series")]
    at = {"category": 0, "brand": 1, "series": 2}
    count = lambda s: len({tuple(t[at[c]] for c in s) for t in tuples})
    want = {
        ("; ".join(r), "; ".join(c))
        for r in sides for c in sides
        if not set(r) & set(c) and count(r) >= 3 and count(c) >= 3 and count(sorted({*r, *c}, key=at.get)) / (count(r) * count(c)) >= 0.95
    }
    assert set(pivots) == want
    tight = catalogue.dense_pivots(spark, "shop", {"dim_product": products}, guard=32)
    assert {(r.attributes, r.estimated_cells) for r in tight.refused.collect()} == {("category; series", 42), ("brand; series", 35)}


def test_store_of_cells_has_a_line_per_tuple(spark):
    """Cells of discovered pivots come from distinct axis tuples: first row with a value, by key; nulls and repeated keys too."""
    pick = random.Random(6)
    rows = [(pick.choice([None, *map(str, range(150))]), pick.choice([None, "a", "b", "c"]), pick.choice(["x", "y"]), pick.choice([1, 2]), pick.choice([None, 0.5, 1.25, 2.0])) for _ in range(400)]
    df = spark.createDataFrame(rows, "id string, r string, c string, d int, v double")
    shape = catalogue.Shape("t", "table", 400, 5, ("r", "c", "d"), ("v",))
    store = discovered.cell_store({"t": df}, [shape], {"t": F.col("id")})
    assert store.count() == len({r[1:4] for r in rows})
    entries = spark.createDataFrame([("t", "r", "c; d", "v"), ("t", "c", "r", "v")], "relation string, row_attributes string, column_attributes string, value_attribute string")
    got = {(r.entry, tuple(r.row_path), tuple(r.col_path)): (r.row, float(r.value)) for r in discovered.entry_cells(store, entries).collect()}
    want = {}
    for row, r, c, d, v in rows:
        for key in (("t|r|c; d|v", (r,), (c, str(d))), ("t|c|r|v", (c,), (r,))):
            if v is not None and r is not None:
                want.setdefault(key, []).append((row, v))
    assert got == {k: min(v, key=lambda x: (x[0] is not None, x[0] or "", x[1])) for k, v in want.items()}


def test_attribute_sets_grow_by_level():
    allowed, refused = catalogue.attribute_sets({0: 3, 1: 4, 2: 5, 5: 30}, guard=60)
    assert [s for s, _ in allowed] == [(0,), (1,), (2,), (5,), (0, 1), (0, 2), (1, 2), (0, 1, 2)]
    assert sorted(refused) == [((0, 5), 90), ((1, 5), 120), ((2, 5), 150)]


def test_a_chain_is_rows(spark):
    people = spark.createDataFrame([("p1", "x", "c1"), ("p2", "x", "c2"), ("p3", "y", "c1"), ("p4", None, "c3")], "pid string, team string, city string")
    cities = spark.createDataFrame([("c1", 4.0), ("c2", 6.0), ("c2", 8.0)], "city string, size double").withColumn("id", F.monotonically_increasing_id())
    store = chains.row_store({"people": people, "cities": cities}, {"people": F.col("pid"), "cities": F.col("id")})
    steps = spark.createDataFrame([("t", 1, "people", "team", "city", ["pid"]), ("t", 2, "cities", "city", "size", ["city", "size"]), ("u", 1, "cities", "city", "size", ["size"])], chains.STEPS)
    starts = spark.createDataFrame([("t", "q", "x"), ("t", "none", "z"), ("u", "q", "c2")], "chain string, question string, key string")
    walked = chains.walk(store, steps, starts, 5, 2)
    city = {(r.chain, r.question): r.answer for r in walked.picked.collect()}
    assert set(city) == {("t", "q")} and city["t", "q"] in ("c1", "c2")
    asked = chains.asked_rows(walked, 5)
    labels = {(r.chain, r.question): r.label for r in chains.averages(asked).collect()}
    assert labels == {("t", "q"): {"c1": "4.0", "c2": "7.0"}[city["t", "q"]], ("u", "q"): "7.0"}
    texts = {(r.chain, r.question): r.text for r in chains.documents(chains.shown_rows(walked, asked), steps).collect()}
    assert texts["t", "q"].startswith("Table 1:\n<table><thead><tr><th>pid</th>") and "Table 2:" in texts["t", "q"]
    spoken = {(r.chain, r.question): r.text for r in chains.questions(walked, asked, steps, starts).collect()}
    assert set(spoken) == set(labels)


def test_candidates_beyond_a_task_are_listed(spark, monkeypatch):
    monkeypatch.setattr(pivot, "MAX_GRID_CELLS", 20)
    cells = [("small", f"r{i}", f"c{j}") for i in range(4) for j in range(5)] + [("large", f"r{i}", f"c{i}") for i in range(9)]
    presence = spark.createDataFrame(cells, "candidate string, r string, c string")
    assert {(r.candidate, r.fits) for r in pivot.candidate_sizes(presence).collect()} == {("small", True), ("large", False)}
    assert {r.candidate for r in pivot.numbered(presence).collect()} == {"small"}


def test_scores_of_an_empty_frame(spark, tmp_path):
    outputs = spark.createDataFrame([], "sample_id long, output string, label string, method string")
    sunk = scoring.write_scores(outputs, str(tmp_path))
    row = spark.read.csv(sunk.score, schema="samples long, accuracy double, mean_f1 double", header=True, nullValue="\\N").first()
    assert tuple(row) == (0, None, None)

"""Linear rules of small parts, solved as arrays, against the rounds over tables."""

import random

from tabloom.operators import links, parts
from tabloom.operators.links import LinearRule

RULES = [
    LinearRule("a", (("s = 1", 1), ("s = 2", 1), ("s = 3", -1)), ">=", 0),
    LinearRule("b", (("s = 3", 2), ("s = 4", -1)), "<=", 60),
    LinearRule("c", (("s = 5", 3), ("s = 4", -2)), ">", 5),
    LinearRule("d", (("s = 5", 1), ("s = 2", -3)), "=", 7),
    LinearRule("e", (("s = 6", 1), ("s = 2", 1)), "<", 90),
]
SCHEMA = "row string, k int, s int, price long, lo long, hi long"


def made(seed, keys):
    draw = random.Random(seed)
    rows = []
    for k in range(keys):
        sizes = [s for s in range(1, 7) if draw.random() < 0.8] + [1] * draw.randrange(3) + [6] * draw.randrange(4)
        sizes += [4] if draw.random() < 0.1 else []
        for n, s in enumerate(sizes):
            lo = draw.randrange(0, 40)
            hi = lo + draw.randrange(-2, 80)
            rows.append((f"{k}-{n}", k, s, draw.randrange(100), None if draw.random() < 0.02 else lo, hi))
    return rows


def repaired(df, **more):
    return sorted(map(str, links.repair(df, RULES, "row", "price", "lo", "hi", 11, **more).collect()))


def test_small_parts_are_solved_as_by_rounds(spark):
    df = spark.createDataFrame(made(3, 150), SCHEMA)
    as_arrays = repaired(df)
    assert as_arrays == repaired(df, most=0)
    states = {s for s in ("kept", "unsatisfiable", "ambiguous", "undecided") if any(f"'{s}'" in r for r in as_arrays)}
    assert states >= {"kept", "unsatisfiable", "ambiguous"}
    assert repaired(df, most=3) == as_arrays  # both ways in one run


def test_names_of_several_rows_take_the_rounds(spark):
    rows = made(5, 40)
    rows += [("0-1", 7, 3, 5, 0, 90), rows[9], rows[9], (None, 3, 2, 5, 0, 50), ("x", None, 1, 5, 0, 50), ("y", None, 2, 5, 0, 50), ("z", None, 3, 5, 0, 50)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert repaired(df) == repaired(df, most=0)


def test_long_chases_take_the_rounds(spark):
    """Two rules that chase each other move their bounds by one a round, longer than arrays go on."""
    rules = [LinearRule("up", (("s = 1", 1), ("s = 2", -1)), ">", 0), LinearRule("on", (("s = 2", 1), ("s = 1", -1)), ">", -2)]
    df = spark.createDataFrame([("p", 1, 1, 0, 0, 90), ("q", 1, 2, 0, 0, 70), ("r", 2, 1, 0, 0, 200), ("t", 2, 2, 0, 90, 300)], SCHEMA)
    found = links.repair(df, rules, "row", "price", "lo", "hi", 1)
    every = links.repair(df, rules, "row", "price", "lo", "hi", 1, most=0)
    assert sorted(map(str, found.collect())) == sorted(map(str, every.collect()))


def test_small_parts_write_no_rounds(spark, monkeypatch):
    written = []
    kept = links.materialise
    monkeypatch.setattr(links, "materialise", lambda df, name: written.append(name) or kept(df, name))
    df = spark.createDataFrame(made(8, 30), SCHEMA)
    assert links.repair(df, RULES, "row", "price", "lo", "hi", 11).count()
    assert not {"bounds", "labels", "values"} & set(written), written
    assert parts.MOST_LINKS >= 10

"""Linear rules of small parts: the rounds of ``links.tightened`` and ``links.drawn`` on arrays.

A part is a set of rows and of all links between them, held as one row: ``vars`` (row, lo, hi, alive) and ``links`` (rows,
coefs, low, high). Parts do not touch each other, so each goes through its own rounds where it lies, and nothing moves.
All rounds see the state of the round before, as those over tables do, so the results are the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.arrays import let
from tabloom.functions.sampling import digest, uniform

#: Links of a part that one row holds; rounds and restarts until a part is left to the rounds over tables.
MOST_LINKS, MOST_ROUNDS, MOST_STARTS = 30, 64, 8


def _rounds(most: Column | int, state: Column, going: Callable[[Column], Column], step: Callable[[Column], Column]) -> Column:
    """``step`` applied to the state while ``going`` says so, ``most`` times at most; what becomes null must be nullable at first."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(most) if isinstance(most, int) else most), state, lambda now, _: F.when(going(now), step(now)).otherwise(now))


def numbered(rows: Column, links: Column) -> Column:
    """Links whose terms are ``(i, coef, pos)``: places in ``vars``; ``whole`` tells whether all rows are there."""

    def one(link: Column) -> Column:
        places = F.transform(
            link["rows"],
            lambda r, pos: F.struct((F.coalesce(F.array_position(rows, r), F.lit(0)).cast("int") - 1).alias("i"), F.get(link["coefs"], pos).alias("coef"), pos.alias("pos")),
        )
        return let(
            places,
            lambda found: F.struct(
                link["low"].alias("low"), link["high"].alias("high"), F.forall(found, lambda t: t["i"] >= 0).alias("whole"),
                F.filter(found, lambda t: t["i"] >= 0).alias("terms"),
            ),
        )

    return F.transform(links, one)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _said(links: Column, state: Column) -> Column:
    """What each link says about each of its rows, as in ``links``: (i, to_lo, to_hi, out, touched, agreed)."""

    def floored(x: Column, size: Column) -> Column:
        return F.call_function("div", x - F.pmod(x, size), size)

    def of(link: Column) -> Column:
        own = F.transform(
            link["terms"],
            lambda t: let(
                F.get(state, t["i"]),
                lambda v: F.struct(
                    t["i"].alias("i"), t["coef"].alias("coef"), t["pos"].alias("pos"), v["alive"].alias("alive"),
                    (t["coef"] * F.when(t["coef"] > 0, v["lo"]).otherwise(v["hi"])).alias("least"),
                    (t["coef"] * F.when(t["coef"] > 0, v["hi"]).otherwise(v["lo"])).alias("most"),
                    v["place"].alias("place"), v["value"].alias("value"),
                ),
            ),
        )

        def whole(terms: Column) -> Column:
            sums = F.struct(
                _sum(F.transform(terms, lambda t: t["least"])).alias("least"),
                _sum(F.transform(terms, lambda t: t["most"])).alias("most"),
                F.exists(terms, lambda t: t["value"].isNotNull()).alias("touched"),
                F.array_min(F.transform(F.filter(terms, lambda t: t["value"].isNull()), lambda t: t["place"])).alias("next"),
            )

            def speak(s: Column) -> Column:
                broken = F.coalesce(s["least"] > link["high"], F.lit(False)) | F.coalesce(s["most"] < link["low"], F.lit(False))

                def about(t: Column, is_broken: Column) -> Column:
                    size = F.abs(t["coef"])
                    by_high = floored(F.when(~is_broken, link["high"] - s["least"] + t["least"]), size)
                    by_low = floored(-F.when(~is_broken, link["low"] - s["most"] + t["most"]), size)
                    up = t["coef"] > 0
                    return F.struct(
                        t["i"].alias("i"), F.when(up, -by_low).otherwise(-by_high).alias("to_lo"), F.when(up, by_high).otherwise(by_low).alias("to_hi"),
                        (is_broken & (t["pos"] == 0)).alias("out"), s["touched"].alias("touched"),
                        (~s["touched"] | (t["place"] == s["next"])).alias("agreed"),
                    )

                return let(broken, lambda b: F.transform(terms, lambda t: about(t, b)))

            return F.when(F.forall(terms, lambda t: t["alive"]), let(sums, speak))

        return let(own, whole)

    return F.flatten(F.filter(F.transform(links, of), lambda x: x.isNotNull()))


def _about(said: Column, i: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body`` of what is said about a row, of its greatest lower and its least upper bound."""
    return let(
        F.filter(said, lambda s: s["i"] == i),
        lambda mine: body(mine, F.array_max(F.transform(mine, lambda s: s["to_lo"])), F.array_min(F.transform(mine, lambda s: s["to_hi"]))),
    )


def started(vars_: Column, links: Column, seed: int) -> Column:
    """The state that rounds work on: places in the order of turns are numbers from 1."""

    def degree(i: Column) -> Column:
        return _sum(F.transform(links, lambda link: F.size(F.filter(link["terms"], lambda t: t["i"] == i)).cast("long")))

    places = F.transform(vars_, lambda v, i: F.struct((-degree(i)).alias("degree"), digest(seed, "turn", v["row"]).alias("digest")))

    def state(at: Column, order: Column) -> Column:
        return F.transform(
            vars_,
            lambda v, i: F.struct(
                v["row"].alias("row"), v["lo"].alias("lo"), v["hi"].alias("hi"), v["alive"].alias("alive"), F.lit(True).alias("moved"),
                F.array_position(order, F.get(at, i)).cast("int").alias("place"), F.lit(None).cast("long").alias("value"),
                F.lit(None).cast("int").alias("label"), F.lit(None).cast("boolean").alias("turn"), uniform(seed, "linear", v["row"]).alias("u"),
            ),
        )

    return let(places, lambda at: let(F.array_sort(at), lambda order: state(at, order)))


def _moved(state: Column) -> Column:
    return F.exists(state, lambda v: v["moved"])


def tightened(state: Column, links: Column) -> Column:
    """Bounds after the links have been applied until nothing changes; ``moved`` stays true where that was not reached."""

    def step(now: Column) -> Column:
        def bounded(v: Column, mine: Column, to_lo: Column, to_hi: Column) -> Column:
            lo, hi, out = F.greatest(v["lo"], to_lo), F.least(v["hi"], to_hi), F.exists(mine, lambda s: s["out"])
            return v.withField("lo", F.when(v["alive"], lo).otherwise(v["lo"])).withField("hi", F.when(v["alive"], hi).otherwise(v["hi"])).withField(
                "alive", v["alive"] & ~out & (lo <= hi)
            ).withField("moved", v["alive"] & (out | (lo != v["lo"]) | (hi != v["hi"])))

        return let(_said(links, now), lambda said: F.transform(now, lambda v, i: _about(said, i, lambda mine, lo, hi: bounded(v, mine, lo, hi))))

    return _rounds(MOST_ROUNDS, state, _moved, step)


def _undecided(v: Column) -> Column:
    return v["alive"] & v["value"].isNull()


def _rooted(state: Column, links: Column) -> Column:
    """``turn``: true for the first undecided row of each set of rows that links still connect; null once rounds have begun."""

    def step(now: Column) -> Column:
        def near(link: Column) -> Column:
            ends = F.transform(link["terms"], lambda t: F.get(now, t["i"]))
            return let(
                ends,
                lambda vs: F.when(
                    F.forall(vs, lambda v: v["alive"]),
                    F.array_min(F.transform(F.filter(vs, lambda v: v["value"].isNull()), lambda v: v["label"])),
                ),
            )

        def relabel(v: Column, i: Column, least: Column) -> Column:
            mine = F.transform(links, lambda link, k: F.when(F.exists(link["terms"], lambda t: t["i"] == i), F.get(least, k)))
            new = F.when(v["label"].isNotNull(), F.least(v["label"], F.array_min(mine)))
            return let(new, lambda n: v.withField("label", n).withField("moved", F.coalesce(n != v["label"], F.lit(False))))

        return let(F.transform(links, near), lambda least: F.transform(now, lambda v, i: relabel(v, i, least)))

    start = F.transform(state, lambda v: v.withField("label", F.when(_undecided(v), v["place"])).withField("moved", F.lit(True)))
    labels = _rounds(F.size(state) + 1, start, _moved, step)
    return F.transform(labels, lambda v: v.withField("turn", v["label"] == v["place"]).withField("moved", F.lit(True)))


def drawn(state: Column, links: Column) -> Column:
    """``value`` for the rows that are alive, drawn in turns; undecided rows that are alive remain where that was not reached."""

    def turn(now: Column) -> Column:
        def decide(v: Column, mine: Column, to_lo: Column, to_hi: Column) -> Column:
            touched = F.exists(mine, lambda s: s["touched"]) & F.forall(mine, lambda s: F.coalesce(s["agreed"], F.lit(True)))
            mine_now = F.coalesce(_undecided(v) & F.coalesce(v["turn"], touched), F.lit(False))

            def put(at: Column) -> Column:
                pick = F.least(at["lo"] + F.floor(v["u"] * (at["hi"] - at["lo"] + 1)), at["hi"])
                value = F.when(at["now"] & (at["lo"] <= at["hi"]), pick).otherwise(v["value"])
                return let(
                    value,
                    lambda x: v.withField("value", x).withField("lo", F.coalesce(x, v["lo"])).withField("hi", F.coalesce(x, v["hi"]))
                    .withField("alive", v["alive"] & ~(at["now"] & (at["lo"] > at["hi"]))).withField("moved", at["now"]).withField("turn", F.lit(None).cast("boolean")),
                )

            return let(F.struct(F.greatest(v["lo"], to_lo).alias("lo"), F.least(v["hi"], to_hi).alias("hi"), mine_now.alias("now")), put)

        return let(_said(links, now), lambda said: F.transform(now, lambda v, i: _about(said, i, lambda mine, lo, hi: decide(v, mine, lo, hi))))

    def start(now: Column) -> Column:
        return let(_rooted(now, links), lambda rooted: _rounds(F.size(rooted) + 2, rooted, _moved, turn))

    return _rounds(MOST_STARTS, state, lambda now: F.exists(now, _undecided), start)


def unmet(state: Column, links: Column) -> Column:
    """Places of the first rows of links whose rows all have values that break them."""

    def fails(link: Column) -> Column:
        def total(values: Column) -> Column:
            known = link["whole"] & F.forall(values, lambda x: x.isNotNull())
            over = lambda s: F.coalesce(s < link["low"], F.lit(False)) | F.coalesce(s > link["high"], F.lit(False))
            return F.when(known, let(_sum(values), over)).otherwise(F.lit(False))

        def value(t: Column) -> Column:
            return let(F.get(state, t["i"]), lambda v: t["coef"] * F.when(v["alive"], v["value"]))

        return let(F.transform(link["terms"], value), total)

    return F.transform(F.filter(links, fails), lambda link: F.get(link["terms"], F.lit(0))["i"])

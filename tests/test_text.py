import re
import string
from collections import Counter

from pyspark.sql import functions as F

from tabloom.functions import numbers, text
from tabloom.operators import scoring

TEXTS = [
    "The cat, an owl and a Dog.", "là a été the end", "", "  padded\tblanks ", "1,234.5 and 77", "-12 of 1,000",
    "no digits", "a.b/c_d—e", "**Bold** and *it* `code`", "> quoted\n> twice", "text (in (a) b) out (c)", "price .5 is",
]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def normal(s):
    s = "".join(ch for ch in s.lower() if ch not in set(string.punctuation) - {"."})
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())


def test_normalize_answer(spark):
    assert column(spark, TEXTS, text.normalize_answer) == [normal(t) for t in TEXTS]


def test_first_number_dialects(spark):
    def first(pattern):
        found = [re.search(pattern, t) for t in TEXTS]
        return [float(m.group(0).replace(",", "")) if m else None for m in found]

    for dialect in (numbers.GROUPED_NUMBER, numbers.LOOSE_NUMBER):
        assert column(spark, TEXTS, lambda c, d=dialect: numbers.first_number(c, d)) == first(dialect)


def test_markdown(spark):
    texts = {
        "```python\nx = 1\n```": "x = 1", "a `b` c": "a b c", "**x** *y*": "x y", "> q\n> r": "q\nr",
        "open ```tail": "open `tail", "see ```sql\nA\n``` and ```sql\nB\n```": "see A\n and B",
    }
    assert column(spark, list(texts), text.strip_markdown) == list(texts.values())


def test_marker_and_lists(spark):
    marked = ["Final answer: 1\nfinal ANSWER:  two ", "none", "x Final answer:"]
    assert column(spark, marked, lambda c: text.after_last_marker(c, "Final answer:")) == ["two", "", ""]
    lists = ["['a', 'b']", '["x"]', "[3, 4]", "plain", "[1] tail"]
    assert column(spark, lists, text.first_list_element) == ["a", "x", "3", "plain", "[1] tail"]


def test_small_helpers(spark):
    assert column(spark, ["FooBarID2", "simple", "HTTPServer", "UserID"], text.camel_to_words) == [
        "foo bar 2", "simple", "http server", "user id",
    ]
    assert column(spark, ['"q"', "'q'", "\"q'", "q"], text.strip_quotes) == ["q", "q", "\"q'", "q"]
    assert column(spark, ["abcab"], lambda c: text.replace_many(c, {"ab": "X", "abc": "Y"})) == ["YX"]
    assert column(spark, ["A (b) c (d)"], text.paren_parts) == [["b", "d", "A c"]]
    assert column(spark, ["cafÃ©", "plain", "âœ broken ☃"], text.fix_mojibake) == ["café", "plain", "âœ broken ☃"]
    assert column(spark, ["Net_Income/€—x %"], text.normalize_label) == ["net income -x %"]
    assert column(spark, ["3.25", "7", "1.0"], numbers.decimals_in) == [2, 0, 1]


def test_plain_numbers(spark):
    df = spark.createDataFrame([(12345678.5,), (1.0,), (0.1234567,), (-3.0,), (100.0,)], "x double")
    assert [r.x for r in df.select(numbers.plain(F.col("x")).alias("x")).collect()] == [
        "12345678.5", "1.0", "0.123457", "-3.0", "100.0",
    ]


def f1(prediction, gold):
    p, g = normal(prediction).split(), normal(gold).split()
    if not p and not g:
        return 1.0
    same = sum((Counter(p) & Counter(g)).values())
    if not p or not g or not same:
        return 0.0
    return 2 * (same / len(p)) * (same / len(g)) / (same / len(p) + same / len(g))


def test_token_f1_both_forms(spark):
    pairs = [(a, b) for a in TEXTS[:6] for b in TEXTS[3:9]]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, p string, g string")
    want = [f1(a, b) for a, b in pairs]
    joined = scoring.token_f1(df, ["i"], "p", "g").orderBy("i").collect()
    assert [r.f1 for r in joined] == want
    inline = df.select("i", scoring.row_f1(text.answer_tokens(F.col("p")), text.answer_tokens(F.col("g"))).alias("f1"))
    assert [r.f1 for r in inline.orderBy("i").collect()] == want


def test_tolerant_mode_is_per_dataset(spark):
    rows = [("n", "12.001", "12"), ("n", "none", "3"), ("t", "Yes.", "yes"), ("t", "No - 3", "4")]
    df = spark.createDataFrame(rows, "d string, p string, g string")
    got = scoring.tolerant_match(df, ["d"], "p", "g").collect()
    assert {(r.d, r.p): r.match for r in got} == {
        ("n", "12.001"): True, ("n", "none"): False, ("t", "Yes."): True, ("t", "No - 3"): False,
    }


def test_missing_pages_and_wide_spans_give_bounded_cells(spark):
    from tabloom.sources.html import html_cells

    wide = "<table><tr><td colspan='900000000'>x</td></tr></table>"
    rows = html_cells(spark.createDataFrame([(1, None), (2, wide)], "k long, html string"), ["k"], "html").collect()
    assert len(rows) == 1000 and {r.k for r in rows} == {2}

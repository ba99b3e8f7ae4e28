"""The audits and the risk-controlled rules against brute force, and on odd tables."""

import math
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

from pyspark.sql import functions as F

from tabloom.llm import divergence, filter_audit, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
LABELS = "doc_id long, quality int, toxic int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x20\x09-\x0D]+"


def mixed_docs(seed, n=120):
    """Texts with repeats, symbols, capitals, copies and nulls in every column, as rows of documents."""
    pick = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Straße", "ÑANDÚ", "a#b", "THE", "x|y", "1st"]
    rows = []
    for i in range(n):
        words = [pick.choice(vocabulary) for _ in range(pick.choice([0, 3, 12, 60, 300]))]
        if pick.random() < 0.4 and words:
            words += words[: pick.randint(1, len(words))]
        text = "".join(w + pick.choice([" ", "  ", "\n", "\t", " \n\n"]) for w in words)
        if rows and pick.random() < 0.3:
            text = pick.choice(rows)[1]
        lang, source = pick.choice(["en", "en", "en", "de", None, ""]), pick.choice(["a", "b", "c", "d", "e", None])
        rows.append((i, None if pick.random() < 0.05 else text, lang, source, 1, "x"))
    return rows + [rows[3], rows[3], (None, rows[5][1], "en", "a", 1, None)]


def brute_audit(rows, labels):
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(r[0], first.get(r[1] or "", r[0]))
    parts = {}
    for r in rows:
        text = r[1] or ""
        words = re.findall(WORD, text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": r[0] is not None and r[0] > first[text],
        }
        parts.setdefault(r[2] or "", []).append((fails, *labels.get(r[0], (0, 0))))
    want = []
    for part, held in parts.items():
        shapley = Counter()
        found = []
        for order in permutations("ABCDE"):
            left = held
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                shapley[f] += len(gone)
                failing = [d for d in held if d[0][f]]
                alone = sum(sum(d[0].values()) == 1 for d in failing)
                found.append([part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone), f])
        want += [(*row[:-1], shapley[row[-1]]) for row in found]
    return sorted(want)


def test_filter_audit_equals_every_order_run_in_full(spark, odd, empty):
    rows = mixed_docs(1)
    marks = [(i, random.Random(i).choice([0, 1, None]), i % 3 == 0) for i in range(100)]
    labels = spark.createDataFrame([(i, q, int(t)) for i, q, t in marks] + [(7, 1, 1), (None, 1, 1)], LABELS)
    known = {i: (int(q == 1), int(t)) for i, q, t in marks} | {7: (1, 1)}
    got = filter_audit.audit(spark.createDataFrame(rows, DOCS), labels).collect()
    assert sorted(tuple(r) for r in got) == brute_audit(rows, known)
    got = filter_audit.audit(odd, labels.limit(0)).collect()
    assert sorted(tuple(r) for r in got) == brute_audit([tuple(r) for r in odd.collect()], {})
    assert filter_audit.audit(empty, labels).count() == 0


def test_shapley_weights_are_the_mean_over_orders():
    for n in (2, 3, 5):
        values = [Fraction(random.Random(s).randint(0, 99)) if s else Fraction(0) for s in range(2**n)]
        want = [Fraction(0)] * n
        for order in permutations(range(n)):
            held = 0
            for i in order:
                want[i] += (values[held | 1 << i] - values[held]) / math.factorial(n)
                held |= 1 << i
        assert [sum(w * v for w, v in zip(row, values, strict=True)) for row in filter_audit.shapley_weights(n)] == want


def brute_statistics(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_rule_statistics_equal_brute_force(spark, odd, empty):
    rows = mixed_docs(2)
    names = quality_rules.RESULT[:-1]
    for docs in (spark.createDataFrame(rows, DOCS), odd):
        got = sorted(quality_rules.measured(docs).select(*names).collect(), key=str)
        assert [tuple(r) for r in got] == [tuple(r) for r in sorted(((r.doc_id, *brute_statistics(r.text)) for r in docs.collect()), key=str)] or {
            str(tuple(r)) for r in got
        } == {str((r.doc_id, *brute_statistics(r.text))) for r in docs.collect()}
    nothing = spark.createDataFrame([], LABELS)
    judged = quality_rules.quality_rules(odd, nothing).collect()
    assert len(judged) == odd.count() and all(r.kept == (not r.base_failed) for r in judged)
    assert quality_rules.quality_rules(empty, nothing).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(0, 1), (0, 300), (3, 400), (20, 1000), (20, 1001), (150, 10_000), (1900, 100_000)]
    p = 0.02
    frame = spark.createDataFrame(cases, "k long, n long")
    got = {(r.k, r.n): r.tail for r in frame.select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), p).alias("tail")).collect()}
    for k, n in cases:
        term, total = Fraction(1), Fraction(0)
        share = Fraction(p)
        if n > 20_000:
            logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
            want = math.fsum(map(math.exp, logs))
        else:
            want = math.fsum(float(math.comb(n, i) * share**i * (1 - share) ** (n - i)) if n < 500 else math.exp(
                math.log(math.comb(n, i)) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert math.isclose(got[k, n], want, rel_tol=1e-7), (k, n, term, total)


def test_cutoffs_need_a_proof_in_their_own_stratum(spark):
    good = "plain words about a quiet river and its old stone bridge number{} near the mill house"
    bad = "plain $$$ words %%% about *** a ### quiet &&& river number{} with its old stone bridge"
    rows, labels = [], []
    for lang, n in (("en", 2000), ("de", 40)):
        for i in range(n):
            ident = len(rows)
            rows.append((ident, (bad if i % 4 == 0 else good).format(chr(97 + i % 26) * (1 + i % 5)), lang, "s", 1, "x"))
            labels.append((ident, int(i % 4 > 0), 0))
    result = quality_rules.quality_rules(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    kept = {r.doc_id: r.kept for r in result}
    assert all(kept[i] == bool(q) for i, q, _ in labels[:2000])
    assert all(kept[i] for i, _, _ in labels[2000:])  # 30 good documents prove nothing


def brute_divergence(rows, least, top):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(LOWER))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= least)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if held[t] >= least) for s in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        for s, c in counts.items():
            pairs = sorted((-sum(f(p(c, t), p(d, t)) for t in kept), o.encode()) for o, d in counts.items() if o != s)
            more = sorted((-f(p(c, t), p(whole, t)), t.encode()) for t in kept if c[t] and p(c, t) > p(whole, t))[:top]
            for part, found in (("pair", pairs), ("term", more)):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(found, 1)]
    return sorted(out)


def test_divergence_equals_brute_force_in_any_blocks(spark, odd, empty):
    rows = mixed_docs(3)
    docs = spark.createDataFrame(rows, DOCS)
    want = brute_divergence(rows, 10, 10)
    for options in ({}, {"terms": 5, "groups_per_tile": 2}, {"terms": 7, "groups_per_tile": 1, "broadcast_groups": 0}):
        assert sorted(tuple(r) for r in divergence.divergence(docs, **options).collect()) == want
    assert sorted(tuple(r) for r in divergence.divergence(odd).collect()) == brute_divergence([tuple(r) for r in odd.collect()], 10, 10)
    assert sorted(tuple(r) for r in divergence.divergence(odd, least_docs=1).collect()) == brute_divergence([tuple(r) for r in odd.collect()], 1, 10)
    assert divergence.divergence(empty).count() == 0

"""Every operator against brute force, a library or held-out labels, and on odd tables."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import sentencepiece
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabloom.llm import bpe, common, decontaminate, language, neighbours, ngram_join, quality, sharding, token_counts, toxicity, warc
from tabloom.llm.queries import oracle_sql, queries

QUERIES = queries()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LABELS = "doc_id long, quality int, toxic int"


def view(sf, name):
    return duckdb.sql(f"SELECT * FROM '{sf}/{name}.parquet'")


def texts(sf):
    return {i: t or "" for i, t in view(sf, "documents").project("doc_id, text").fetchall()}


def brute_components(docs, n, percent):
    sets = {}
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= percent * large:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (small + large - both):
                    p, q = find(a), find(b)
                    top[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_shards_have_equal_bytes_and_gapless_slots(spark, sf, odd, empty):
    rows = QUERIES["op1_kd_sharding"](spark, sf).collect()
    docs = texts(sf)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all((r.size, r.text_crc32) == (len(docs[r.doc_id].encode()) + 1, zlib.crc32(docs[r.doc_id].encode())) for r in rows)
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    assert sorted(shards) == list(range(16))
    for held in shards.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    sizes = [sum(r.size for r in held) for held in shards.values()]
    assert max(sizes) - min(sizes) <= 4 * max(r.size for r in rows)
    assert sharding.kd_shards(odd, shards=4).count() == odd.count()
    assert sharding.kd_shards(empty, shards=4).count() == 0
    assert sharding.kd_shards(odd, target_bytes=1 << 40).select("shard").distinct().count() == 1


def test_components_equal_brute_force(spark, sf, odd, empty):
    rows = QUERIES["op3_ngram_jaccard_join"](spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts(sf).items(), 3, 90)
    found = ngram_join.ngram_components(odd).collect()
    assert len(found) == odd.count()
    assert {(r.doc_id, r.component_id) for r in found if r.doc_id in (1, 2)} == {(1, 1), (2, 1)}
    assert ngram_join.ngram_components(empty).count() == 0
    assert ngram_join.keep_first(odd).where("doc_id in (1, 2)").count() == 1
    assert ngram_join.keep_first(odd).columns == odd.columns


def test_components_of_a_group_of_near_copies(spark):
    random = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in random.choice(120, random.integers(0, 6), replace=False):
            words[k] = f"x{random.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    for percent, n in ((90, 3), (80, 5)):
        found = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, n, percent)


def test_component_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    found = {r.node: r.component for r in common.components(links).collect()}
    assert found == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_words_hidden_by_the_channel_are_read():
    grams, counts = {}, {}
    text = "  " + "you are an idiot and a loser said the idiot to the other loser  " * 30
    codes = [toxicity._CLASS[ord(c)] for c in text]
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        k = (a * toxicity.SIZE + b) * toxicity.SIZE + c
        counts[k] = counts.get(k, 0) + 1
    speller = toxicity.Speller(np.array(list(counts)), np.array(list(counts.values())))
    assert [speller.read(w) for w in ("1d10t", "l0s3r", "i.d.i.o.t", "idiooooot", "i d i o t")] == ["idiot", "loser", "idiot", "idiot", "idiot"]
    assert grams == {}


def test_toxicity_of_hidden_words_and_held_out_rows(spark, odd, empty):
    clean = [f"the quiet river number{chr(97 + i % 26)} runs by the old house and the mill" for i in range(300)]
    bad = [f"the quiet {('idiot', 'loser')[i % 2]} number{chr(97 + i % 26)} runs by the old house" for i in range(300)]
    rows = [(i, t) for i, t in enumerate(clean + bad)]
    hidden = [(1000, "the quiet 1d10t runs by the mill"), (1001, "the quiet i d i o t runs by the mill"), (1002, "the old house by the mill")]
    docs = spark.createDataFrame(rows + hidden, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= 300)) for i, _ in rows], LABELS)
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(found[i].predicted == int(i >= 300) for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0)
    assert [found[i].predicted for i in (1000, 1001, 1002)] == [1, 1, 0]
    scores = toxicity.toxicity(odd, labels).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.keep_civil(odd, labels).columns == odd.columns


def test_quality_of_held_out_rows(spark, sf, odd, empty):
    rows = {r.doc_id: r for r in QUERIES["op4_quality_rules"](spark, sf).collect()}
    marks = view(sf, "labels").project("doc_id, quality").fetchall()
    right = [rows[i].predicted == q for i, q in marks if i in rows and q is not None and rows[i].held_out]
    assert np.mean(right) > 0.8
    labels = spark.createDataFrame([], LABELS)
    assert [r.score for r in quality.quality(odd, labels).collect()] == [0.5] * odd.count()
    assert quality.quality(empty, labels).count() == 0


def test_rules_as_columns_score_as_in_the_fit(spark):
    random = np.random.default_rng(1)
    x = random.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(float)
    rules, intercept = quality.fit(x, y, y.mean())
    want = 1 / (1 + np.exp(-(sum(w * quality.matches(x, r) for r, w in rules) + intercept)))
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    got = [r.s for r in df.select(quality.compiled(rules, intercept, ["a", "b", "c"]).alias("s")).collect()]
    assert np.allclose(sorted(want), sorted(got)) and np.mean((want > 0.5) == y) > 0.97


def test_neighbours_reach_the_recall(spark, sf):
    rows = view(sf, "embeddings").project("vec_id, embedding").fetchall()
    rows += [(10_000 + i, [0.5] * len(rows[0][1])) for i in range(30)] + [(20_000, None), (20_001, [0.0] * len(rows[0][1]))]
    df = spark.createDataFrame([(i, [float(x) for x in v] if v else None) for i, v in rows], "vec_id long, embedding array<float>")
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, {})[r.rank] = r
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and any(v)]
    ids, x = np.array([i for i, _ in kept]), np.array([v for _, v in kept])
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        got = found[q]
        assert sorted(got) == list(range(1, 11)) and q not in {r.vec_id for r in got.values()}
        assert all(abs(r.score - far[ids == r.vec_id][0]) < 1e-9 for r in got.values())
        hits, total = hits + len({r.vec_id for r in got.values()} & set(ids[order].tolist())), total + 10
    assert hits / total >= 0.9
    assert [found[10_000][k].vec_id for k in range(1, 11)] == list(range(10_001, 10_011))
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_beside_an_outlier(spark):
    random = np.random.default_rng(3)
    x = random.normal(0, 0.1, (4000, 16))
    x[7] = 0.0
    x[7, 0] = 1e9
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    near = {q: set(np.argsort(((x - x[q]) ** 2).sum(1))[1:11].tolist()) for q in range(0, 4000, 100)}
    assert sum(len(found[q] & near[q]) for q in near) >= 0.9 * 10 * len(near)


def recall_of(spark, x, queries):
    """Share of the true ten nearest that the search finds, for every hundredth vector."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") % queries == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), queries):
        far = ((x - x[q]) ** 2).sum(1)
        far[q] = np.inf
        hits += len(found[q] & set(np.argpartition(far, 10)[:10].tolist()))
    return hits / (10 * len(range(0, len(x), queries)))


def test_recall_holds_on_a_larger_table_and_on_shifted_clusters(spark, sf):
    given = np.array([r[0] for r in view(sf, "embeddings").project("embedding").fetchall() if r[0]], np.float64)
    random = np.random.default_rng(5)
    x = random.multivariate_normal(given.mean(0), np.cov(given.T), 10_000)
    assert recall_of(spark, x, 100) >= 0.9
    centres = random.normal(0, 1, (20, 32))
    x = 50 + centres[random.integers(0, 20, 6000)] + random.normal(0, 0.05, (6000, 32))
    assert recall_of(spark, x, 100) >= 0.9


def test_odd_vectors_take_no_part(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 40)]
    rows += [(100, None), (200, [0.0, 0.0]), (300, [float("nan"), 1.0]), (400, [None, 1.0]), (500, [1.0, 2.0, 3.0]), (None, [3.0, 1.0]), (20, [20.0, 1.0])]
    df = spark.createDataFrame([(i, v, "own") for i, v in rows], "vec_id long, embedding array<double>, score string")
    found = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert {r.query_id for r in found} == {20}
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank)] == [19, 21, 18, 22, 17, 23, 16, 24, 15, 25]


ODD_TEXTS = ["", "a", "  a b", "a  b", " x", "x ", "it's  we'll", "<|endoftext|>", "a<|endoftext|>b", "é ÷ × ñ\n\nx", "日本 語", "x\ty 　z", "a\n b\n\n c\r\n", "A" * 200 + " " + "ab" * 3000, "\x00 \x1c a", "½ x²", ".. ...\n..", "\n", " ", "▁x a▁b", "naïve x", "<s> a </s>"]


def test_token_counts_equal_the_library(spark, sf, odd, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(token_counts.MODEL))
    docs = texts(sf)
    for r in QUERIES["op6_token_counts"](spark, sf).collect():
        n = len(library.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)
    lengths = token_counts.Lengths({}, token_counts.Pieces(token_counts.MODEL))
    assert lengths.count(pa.array(ODD_TEXTS)).tolist() == [len(library.encode(t)) for t in ODD_TEXTS]
    assert token_counts.token_counts(odd).count() == odd.count() and token_counts.token_counts(empty).count() == 0


def test_archives_equal_sql_and_hold_each_payload_once(spark, sf, tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = QUERIES["op7_warc_revisits"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(oracle_sql()["op7_warc_revisits"]).fetchall())
    page = "<p>WARC/1.1\r\n\r\nWARC-Type: fake é</p>" * 9
    rows = [(5, "u", page), (3, "v\r\nX: y", page), (9, None, page), (1, "w", "short"), (2, "w", "short"), (4, "n", None), (None, "z", "q")]
    path = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    found = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in found.items()} == {
        3: ("response", None), 5: ("revisit", 3), 9: ("revisit", 3), 1: ("response", None), 2: ("response", None), 4: ("response", None), None: ("response", None),
    }
    assert found[3].payload == page.encode() and found[5].payload == b"" and found[5].declared_bytes == len(page.encode())
    assert found[9].declared_digest == hashlib.sha256(page.encode()).hexdigest()


def test_a_page_id_with_several_payloads(spark, tmp_path):
    page, own, more = (f"<p>{word}</p>" * 40 for word in ("shared", "own", "more"))
    rows = [(3, "u", page), (5, "u", page), (5, "v", own), (2, "w", more), (5, "w", more)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "pages.parquet")
    pages.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    got = QUERIES["op7_warc_revisits"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(oracle_sql()["op7_warc_revisits"]).fetchall()))
    warc.write_archives(pages, str(tmp_path / "archives"))
    found = warc.read_archives(spark, str(tmp_path / "archives")).collect()
    assert {r.payload.decode() for r in found if r.record_type == "response"} == {page, own, more}


def test_language_of_held_out_rows_and_mixtures(spark, sf, odd, empty):
    rows = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, sf).collect()}
    langs = view(sf, "documents").project("doc_id, lang").fetchall()
    right = [rows[i].lang_pred == x for i, x in langs if x and rows[i].held_out]
    assert np.mean(right) > 0.95
    found = {r.doc_id: r for r in language.identify(odd).collect()}
    assert len(language.identify(odd).collect()) == odd.count()
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (3, 4, 5, 8))
    assert found[6].lang_pred == "en"
    assert language.identify(empty).count() == 0
    assert language.keep_identified(odd).columns == odd.columns
    logs = np.full((1 << language.BITS, 2), -12.0, np.float32)
    for i, text in enumerate(("the cat and the dog ", "der hund und die katze ")):
        logs[language._grams([text])[0], i] = -3.0
    lead, share = language.Languages(["en", "de"], logs).infer(["the cat and the dog der hund", "der hund und die katze", "..."])
    assert lead.tolist() == [0, 1, -1] and 0.6 < share[0] < 0.8 and share[1] > 0.99


def test_bpe_equals_the_library(spark, sf, odd, empty):
    library = Tokenizer.from_file(tokenizer_path(bpe.MODEL))
    docs = texts(sf)
    for r in QUERIES["op9_bpe"](spark, sf).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoder = bpe.Encoder(bpe.MODEL)
    ids, bounds = encoder.encode(pa.array(ODD_TEXTS))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(t, add_special_tokens=False).ids for t in ODD_TEXTS]
    assert encoder.decode(ids, bounds) == ODD_TEXTS
    assert bpe.bpe_round_trip(odd).count() == odd.count() and bpe.bpe_round_trip(empty).count() == 0


def test_lexicon_holds_its_words_and_shares_suffixes(tmp_path):
    entries = {w.encode(): np.array([i, i + 1], "<u4").tobytes() for i, w in enumerate(["tapping", "taping", "mapping", "map", "tap"])}
    file = tmp_path / "lexicon.bin"
    file.write_bytes(bpe.compile_lexicon(entries))
    lexicon = bpe.Lexicon(str(file))
    words = [*entries, b"ta", b"mappings", b"", b"x"]
    data, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])[:-1]
    place = lexicon.find(data, starts, np.array([len(w) for w in words]))
    got = [lexicon.ids[lexicon.offsets[p] : lexicon.offsets[p + 1]].tolist() if p >= 0 else None for p in place]
    assert got == [[i, i + 1] for i in range(5)] + [None] * 4
    assert len(lexicon.finals) < sum(map(len, entries))


def plain_alignment(text, item):
    table = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if a == b else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
    return max(map(max, table))


def test_alignments_equal_the_plain_table():
    random = np.random.default_rng(5)
    pairs = [(random.integers(1, 6, random.integers(1, 30)), random.integers(1, 6, random.integers(1, 12))) for _ in range(60)]
    best, _ = decontaminate.alignments([a for a, _ in pairs], [b for _, b in pairs])
    assert best.tolist() == [plain_alignment(a.tolist(), b.tolist()) for a, b in pairs]


def test_copies_of_test_items_are_found(spark, sf, odd, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    edited = list(item)
    edited[4], edited[11] = "changed", "other"
    rows = [
        (1, "before it " + " ".join(item).upper() + ". after"), (2, " ".join(edited)), (3, " ".join(item[:5])),
        (4, "nothing of that kind"), (5, None), (None, " ".join(item)),
    ] + [(100 + i, f"copy {i}: " + " ".join(item)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, ""), (None, "x")], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(found) == {1, 2, *range(100, 140)} and found[1].score == 1.0 and found[2].score == (2 * 18 - 2) / 40
    kept = decontaminate.keep_uncontaminated(docs, bench).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept) == [(False, 0), (True, 3), (True, 4), (True, 5)]
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    items = {i: " ".join(t.lower().split()) for i, t in view(sf, "benchmark").project("item_id, text").fetchall()}
    exact = {(d, i) for d, t in texts(sf).items() for i, x in items.items() if x.rstrip(".") in " ".join(t.lower().split())}
    pairs = {(r.doc_id, r.item_id) for r in QUERIES["op10_decontamination"](spark, sf).collect()}
    assert exact <= pairs


def test_copies_are_found_whatever_the_other_documents_hold(spark):
    item = [f"word{i}" for i in range(20)]
    edited = [f"edit{i}" if i in (5, 10, 15) else w for i, w in enumerate(item)]
    rows = [(i, " ".join(edited)) for i in range(1000)] + [(1000 + i, " ".join(item)) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = {r.doc_id: r.score for r in decontaminate.contaminated(docs, bench).collect()}
    assert found == {i: 0.775 if i < 1000 else 1.0 for i in range(1010)}


def test_edited_copies_are_found_as_by_plain_alignment_of_all_pairs(spark):
    random = np.random.default_rng(11)
    items = {i: [f"w{c}" for c in random.integers(0, 40, n)] for i, n in enumerate((1, 2, 3, 4, 5, 8, 13, 20, 20, 33))}
    docs = {0: [f"e{i}" if i % 4 == 3 else w for i, w in enumerate(items[7])], 1: [w for x in items[8] for w in (x, "in")], 2: [], 3: items[9] * 9}
    for i in range(4, 120):
        item, edits = items[random.integers(0, len(items))], random.random() * 0.7
        text = [f"w{c}" for c in random.integers(0, 400, random.integers(0, 30))]
        for word in item:
            kind = random.random() / edits
            text += [word] if kind >= 1 else [["other"], [], [word, "more"], ["x", "y"]][int(kind * 4)]
        docs[i] = text + [f"w{c}" for c in random.integers(0, 400, random.integers(0, 30))]
    plain = {(d, i): plain_alignment(text, item) / (2 * len(item)) for d, text in docs.items() for i, item in items.items()}
    rows = spark.createDataFrame([(d, " ".join(text)) for d, text in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(item)) for i, item in items.items()], "item_id long, text string")
    for threshold in (0.3, 0.5, 0.8):
        found = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(rows, bench, threshold).collect()}
        assert found == {pair: score for pair, score in plain.items() if score >= threshold}
        assert threshold > 0.5 or {(0, 7), (1, 8)} <= set(found)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = common.table(spark, sf, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        after = common.written(stage(spark, docs, sf), name)
        if name != "bpe":
            assert after.columns == docs.columns and after.exceptAll(docs).isEmpty()
        docs = after
    assert 0.7 * before < docs.count() <= before
    library = Tokenizer.from_file(tokenizer_path(bpe.MODEL))
    known = texts(sf)
    assert all(r.ids == library.encode(known[r.doc_id], add_special_tokens=False).ids for r in docs.limit(50).collect())

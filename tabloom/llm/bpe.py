"""Byte-level BPE with a transducer lexicon.

Frequent pieces of the corpus are compiled into a minimal acyclic automaton whose suffixes are shared; the numbers on
its arcs add up to a piece's place in a list of id sequences. Workers map the file into memory, so all workers of an
executor share its pages. Pieces that the lexicon does not hold are merged exactly, many at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bounded, lean, on_worker, plain_text, ragged, ship, shipped, slices, sums, table, words_of
from .registry import query
from .token_counts import heavy_hitters

MODEL = "byte_bpe_50k.json"
#: Pieces in the lexicon.
FREQUENT = 30_000
#: Bytes of the chunks that a worker keeps besides.
CACHED = 16 << 20
#: Pieces of more bytes are merged one by one with a heap, in time n log n.
WIDE = 48
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pattern of the byte-level pre-tokenizer (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where spaces do not simply part words: beside other white space, or at an end.
ODD = [f" {c}" for c in " \t\n\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
NONE = np.int32(1 << 30)


def byte_signs() -> list[str]:
    """The sign that stands for each byte in the vocabulary: itself if printable, else the next sign from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    kept = set(printable)
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class Merges:
    """Vocabulary and merge rules of one tokenizer file."""

    def __init__(self, model: str):
        with open(tokenizer_path(model), encoding="utf-8") as file:
            spec = json.load(file)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("only plain byte-level tokenizers are read")
        ids = spec["model"]["vocab"]
        signs = byte_signs()
        self.first = np.array([ids[s] for s in signs], np.int32)
        back = {s: bytes([b]) for b, s in enumerate(signs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(max(ids.values()), *self.special.values()) + 1
        self.bytes_of = [b""] * size
        for piece, i in ids.items():
            self.bytes_of[i] = b"".join(back.get(c, c.encode()) for c in piece)
        for piece, i in self.special.items():
            self.bytes_of[i] = piece.encode()
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.split = regex.compile(PATTERN)
        self.chunks = regex.compile(f"[ ]?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.specials = regex.compile("|".join(map(regex.escape, self.special)))
        del spec, ids, pairs, keys, made

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.ranks[place], NONE)

    def merge_many(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short pieces (rows of bytes) one after another, and how many each has.

        In every round each row merges its first best pair.
        """
        n, width = raw.shape
        at = np.arange(width)
        inside = at < lengths[:, None]
        ids = np.where(inside, self.first[raw], np.int32(-1))
        ranks = np.full((n, width), NONE, np.int32)
        both = inside[:, 1:]
        ranks[:, :-1][both] = self._ranks(ids[:, :-1][both], ids[:, 1:][both])
        out = np.full((n, width), -1, np.int32)
        rows = np.arange(n)
        while len(rows):
            best = ranks.argmin(1)
            here = np.arange(len(rows))
            rank = ranks[here, best]
            done = rank == NONE
            if done.any():
                out[rows[done], : ids.shape[1]] = ids[done]
                go = ~done
                rows, ids, ranks, best, rank = rows[go], ids[go], ranks[go], best[go], rank[go]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            after = at[: ids.shape[1] - 1] > best[:, None]
            ids = np.where(after, ids[:, 1:], ids[:, :-1])
            ranks = np.where(after, ranks[:, 1:], ranks[:, :-1])
            new = self.made[rank]
            ids[here, best] = new
            right = np.where(best + 1 < ids.shape[1], ids[here, np.minimum(best + 1, ids.shape[1] - 1)], -1)
            ranks[here, best] = np.where(right >= 0, self._ranks(new, np.maximum(right, 0)), NONE)
            inner = best > 0
            ranks[here[inner], best[inner] - 1] = self._ranks(ids[here[inner], best[inner] - 1], new[inner])
        kept = out >= 0
        return out[kept], kept.sum(1)

    def merge_long(self, piece: bytes) -> bytes:
        """Ids of one piece of any length, with a heap of pairs over a linked list."""
        ids = self.first[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank_of.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.rank_of.get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def merge(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces that stand in ``text`` at the given places, one after another, and how many each has."""
        counts = np.zeros(len(starts), np.int64)
        found = []
        low = 0
        for width in (4, 8, 12, 16, 24, WIDE):
            group = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for at in range(0, len(group), 16_384):
                some = group[at : at + 16_384]
                raw = np.zeros((len(some), width + 1), np.uint8)
                raw[np.arange(width + 1) < lengths[some, None]] = text[ragged(starts[some], lengths[some])]
                ids, counts[some] = self.merge_many(raw, lengths[some])
                found.append((some, ids))
        for i in np.flatnonzero(lengths > WIDE):
            ids = np.frombuffer(self.merge_long(text[starts[i] : starts[i] + lengths[i]].tobytes()), "<u4")
            counts[i] = len(ids)
            found.append((np.array([i]), ids))
        return join_runs(counts, found), counts


def join_runs(counts: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Runs of ids, given by groups, in the order of their pieces."""
    out = np.zeros(int(counts.sum()), np.int64)
    starts = np.cumsum(counts) - counts
    for some, ids in found:
        out[ragged(starts[some], counts[some])] = ids
    return out


def flat_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, one after another, and the bounds of each."""
    sizes = pa.compute.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    start = int(np.frombuffer(words.buffers()[1], np.int32)[words.offset]) if len(words) else 0
    data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and words.buffers()[2] else np.zeros(0, np.uint8)
    return data[start : start + bounds[-1]], bounds


def compile_lexicon(entries: dict[bytes, bytes]) -> bytes:
    """Minimal acyclic automaton of the keys, in order, with the number of smaller keys added up along each path.

    File: eight lengths, then the arc keys (state * 256 + byte, sorted), arc targets, arc sums, final states, offsets
    (all 64 bits) and ids (32 bits). Equal suffixes share their states.
    """
    words = sorted(w for w in entries if w)
    known: dict[tuple, int] = {}
    arcs: list[tuple] = []

    def state(final: bool, out: list) -> int:
        shape = (final, tuple(out))
        if shape not in known:
            known[shape] = len(arcs)
            arcs.append(shape)
        return known[shape]

    path: list[list] = [[False, []]]
    last = b""

    def fold_to(depth: int) -> None:
        while len(path) - 1 > depth:
            final, out = path.pop()
            path[-1][1].append((last[len(path) - 1], state(final, out)))

    for word in words:
        shared = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        fold_to(shared)
        path.extend([False, []] for _ in word[shared:])
        path[-1][0] = True
        last = word
    fold_to(0)
    root = state(*path[0])
    held = np.zeros(len(arcs), np.int64)
    rows = []
    for s, (final, out) in enumerate(arcs):
        count = int(final)
        for byte, target in out:
            rows.append((s << 8 | byte, target, count))
            count += int(held[target])
        held[s] = count
    rows.sort()
    keys, targets, sums = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    finals = np.array([a[0] for a in arcs], np.int64)
    ids = [np.frombuffer(entries[w], "<u4") for w in words]
    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    flat = np.frombuffer(flat.tobytes() + bytes(-len(flat) % 2 * 4), np.int64)
    parts = [keys, targets, sums, finals, offsets, flat]
    head = np.array([root, len(words), *map(len, parts)], np.int64)
    return b"".join(p.tobytes() for p in [head, *parts])


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, file: str):
        data = np.memmap(file, np.int64, "r")
        self.root, self.size = int(data[0]), int(data[1])
        at, parts = 8, []
        for n in data[2:8].tolist():
            parts.append(data[at : at + n])
            at += n
        self.keys, self.targets, self.sums, self.finals, self.offsets = parts[:5]
        self.ids = parts[5].view("<u4")

    def find(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Place of each piece that stands in ``text``, -1 where the lexicon does not hold it; all walk together."""
        at = np.full(len(starts), self.root if self.size else -1)
        place = np.zeros(len(starts), np.int64)
        live = np.flatnonzero((lengths > 0) & (at >= 0))
        step = 0
        while len(live):
            key = at[live] << 8 | text[starts[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            at[live[~hit]] = -1
            live, arc = live[hit], arc[hit]
            place[live] += self.sums[arc]
            at[live] = self.targets[arc]
            step += 1
            live = live[lengths[live] > step]
        found = (lengths > 0) & (at >= 0)
        found[found] = self.finals[at[found]] == 1
        return np.where(found, place, -1)


#: Kinds of bytes: 0 cut a word out of the quick way, 1 letters, 2 digits, 3 line ends, 4 signs, 5 the lead of a letter.
_KIND = np.zeros(256, np.uint8)
_KIND[[b for b in range(128) if chr(b).isalpha()]] = 1
_KIND[[b for b in range(128) if chr(b).isdigit()]] = 2
_KIND[10] = 3
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = 4
_KIND[0xC3] = 5


def quick_words(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words hold nothing but ASCII without apostrophes, letters U+00C0 to U+00FF and single line ends, and the
    kind of every byte. In such words the parts of the pre-tokenizer are the runs of one kind."""
    kind = _KIND[text]
    lead = np.flatnonzero(text[:-1] == 0xC3) if len(text) else np.zeros(0, np.int64)
    second = text[lead + 1]
    good = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
    kind[lead[good]] = 1
    kind[lead[good] + 1] = 1
    bad = (kind == 0) | (kind == 5)
    bad[1:] |= (kind[1:] == 3) & (kind[:-1] == 3)
    return sums(bad.astype(np.int64), bounds) == 0, kind


class Encoder:
    """Encodes and decodes on a worker: lexicon first, then merges.

    The distinct words of a few megabytes are encoded together, as arrays of bytes. Words that the pattern may cut in
    other ways than by runs of letters, digits and signs go the slow way, one by one, with a cache.
    """

    def __init__(self, model: str, lexicon: Lexicon | None = None):
        self.merges = Merges(model)
        self.lexicon = lexicon
        self.cache = Bounded(self._slow, CACHED)  # ids of chunks that go the slow way
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in self.merges.special.items()}

    def plain(self, text: str) -> bool:
        """Whether single spaces part the text, so that each of them belongs to the word behind it."""
        if text[:1] == " " or text[-1:] == " " or any(p in text for p in ODD):
            return False
        return not any(s in text for s in self.special)

    def chunks(self, text: str) -> list[str]:
        """Chunks of any text, each with the space before it; special strings stand alone."""
        found, at = [], 0
        for m in self.merges.specials.finditer(text):
            found += [*self.merges.chunks.findall(text[at : m.start()]), m.group()]
            at = m.end()
        return found + self.merges.chunks.findall(text[at:])

    def slow(self, chunk: str) -> bytes:
        """Ids of any chunk, by the full pattern."""
        return self.cache[chunk]

    def _slow(self, chunk: str) -> bytes:
        return b"".join(self.merges.merge_long(p.encode()) for p in self.merges.split.findall(chunk))

    def quick(self, text: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words as they stand after a space, one after another, and how many each has; see ``quick_words``."""
        n = len(bounds) - 1
        heads = bounds[:-1]
        cut = np.ones(len(text), bool)
        cut[1:] = kind[1:] != kind[:-1]
        cut[heads] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, len(text)))
        word = np.searchsorted(heads, starts, "right") - 1
        # The first part of a word takes the space before it.
        first = np.zeros(len(starts), np.int64)
        first[np.searchsorted(starts, heads)] = 1
        spaced = np.insert(text, heads, 0x20)
        starts = starts + word + 1 - first
        lengths = lengths + first
        place = self.lexicon.find(spaced, starts, lengths) if self.lexicon else np.full(len(starts), -1)
        known, rest = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        counts = np.zeros(len(starts), np.int64)
        found = []
        if len(known):
            begin = self.lexicon.offsets[place[known]]
            counts[known] = self.lexicon.offsets[place[known] + 1] - begin
            found.append((known, self.lexicon.ids[ragged(begin, counts[known])]))
        merged, counts[rest] = self.merges.merge(spaced, starts[rest], lengths[rest])
        found.append((rest, merged))
        return join_runs(counts, found), np.bincount(word, counts, n).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the bounds of each text among them."""
        codes, bounds, words = words_of(texts, pattern=" ")
        data, ends = flat_bytes(words)
        fit, kind = quick_words(data, ends)
        fit &= np.diff(ends) > 0
        inside = np.repeat(fit, np.diff(ends))
        ids, sizes = self.quick(data[inside], kind[inside], np.concatenate([[0], np.cumsum(np.diff(ends)[fit])]))
        counts = np.zeros(len(words) + len(texts), np.int64)
        counts[np.flatnonzero(fit)] = sizes
        used = np.zeros(len(words), bool)
        extra: list[bytes] = []
        odd = np.zeros(len(texts), bool)
        for i, text in enumerate(texts.to_pylist()):
            if not self.plain(text):
                odd[i] = True
                extra.append(b"".join(self.special[c] if c in self.special else self.slow(c) for c in self.chunks(text)))
            else:
                extra.append(self.slow(text.split(" ", 1)[0]) if text else b"")
        heads = bounds[:-1]
        tail = np.ones(len(codes), bool)  # words after a space, in texts where spaces simply part words
        tail[heads[np.diff(bounds) > 0]] = False
        tail[np.repeat(odd, np.diff(bounds))] = False
        used[codes[tail]] = True
        slow = np.flatnonzero(used & ~fit)
        rest = [self.slow(f" {w}") for w in words.take(pa.array(slow)).to_pylist()]
        counts[slow] = [len(r) // 4 for r in rest]
        counts[len(words) :] = [len(e) // 4 for e in extra]
        flat = join_runs(
            counts,
            [
                (np.flatnonzero(fit), ids),
                (slow, np.frombuffer(b"".join(rest), "<u4")),
                (np.arange(len(words), len(counts)), np.frombuffer(b"".join(extra), "<u4")),
            ],
        )
        pick = np.where(tail, codes, 0).astype(np.int64)
        taken = np.where(tail, counts[pick], 0)
        full = np.flatnonzero(np.diff(bounds) > 0)
        pick[heads[full]] = len(words) + full
        taken[heads[full]] = counts[len(words) + full]
        starts = np.cumsum(counts) - counts
        return flat[ragged(starts[pick], taken)], np.concatenate([[0], np.cumsum(sums(taken, bounds))])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each sequence of ids."""
        lengths = self.merges.sizes[ids]
        raw = self.merges.flat[ragged(self.merges.starts[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def _encoder(model: str, file: str) -> Encoder:
    return on_worker(("encoder", model, file), lambda: Encoder(model, Lexicon(shipped(file))))


def build_lexicon(docs: DataFrame, model: str = MODEL, most: int = FREQUENT) -> str:
    """Compile the corpus's frequent chunks and bring the file to every executor; returns its name there."""
    encoder = Encoder(model)
    words = pa.array([w for w in heavy_hitters(docs, most) if w], pa.string())
    data, ends = flat_bytes(words)
    fit, kind = quick_words(data, ends)
    inside = np.repeat(fit, np.diff(ends))
    bounds = np.concatenate([[0], np.cumsum(np.diff(ends)[fit])])
    ids, sizes = encoder.quick(data[inside], kind[inside], bounds)
    at = np.cumsum(sizes) - sizes
    # Only words without signs are one part; the others are found by their parts.
    one = sums((kind[inside] != 1).astype(np.int64), bounds) == 0
    entries = {
        f" {w}".encode(): ids[a : a + n].astype("<u4").tobytes()
        for w, a, n, o in zip(words.filter(pa.array(fit)).to_pylist(), at.tolist(), sizes.tolist(), one.tolist(), strict=True)
        if o
    }
    return ship(docs.sparkSession, "lexicon", compile_lexicon(entries))


def bpe_round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row of ``docs``: ids as array, text as decoded from them.

    Ids equal the library's for the whole text without added tokens; special strings inside a text get their own id.
    Null and empty texts have no ids and decode to an empty text. An empty table gives no rows.
    """
    return _encoded(docs, model, ("ids", "decoded"))


def bpe_digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """As ``bpe_round_trip``, with digests of ids (little-endian 32 bits) and of the decoded text in their place."""
    return _encoded(docs, model, ("ids_sha256", "decoded_sha256"))


def bpe_ids(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """As ``bpe_round_trip``, with the digest of the decoded text in its place."""
    return _encoded(docs, model, ("ids", "decoded_sha256"))


KINDS = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def _encoded(docs: DataFrame, model: str, wanted: tuple[str, ...]) -> DataFrame:
    file = build_lexicon(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, file)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = encoder.encode(part.column("text"))
                texts = encoder.decode(ids, bounds)
                columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(np.diff(bounds))}
                raw, at = memoryview(ids.astype("<u4")).cast("B"), (4 * bounds).tolist()
                makers = {
                    "ids": lambda: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))),
                    "decoded": lambda: pa.array(texts, pa.string()),
                    "ids_sha256": lambda: pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:])], pa.string()),
                    "decoded_sha256": lambda: pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                }
                columns |= {name: makers[name]() for name in wanted}
                yield pa.record_batch(columns)

    shape = ", ".join(f"{name} {KINDS[name]}" for name in wanted)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id long, n_tokens long, {shape}")


@query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of all documents, as digests."""
    return bpe_digests(table(spark, sf_dir, "documents"))

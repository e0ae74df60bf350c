"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Items are grouped into size classes; a class of ``w`` words covers items of w up to half as
many more. Every window of w words of every document gets a 64-bit SimHash of its words, from
running bit sums, so a window costs the same whatever its size. An item is filed by its
first and by its last w words. The fingerprints are cut into blocks: two fingerprints within
``RADIUS`` bits agree in some block up to RADIUS // BLOCKS bits, so an item is filed under every such
variant of each block, and looking up a window's blocks finds all items within the radius.

Candidates are then compared exactly: the window of the item's own size, at the offset found
and, if that is near, up to two words to either side, by weighted Jaccard similarity of word shingles. A
shingle weighs 1 / (number of different items that hold it), so wording common to many items counts
less; items of equal words are one. A shingle that only the document has weighs as much as the
item's shingles on average, so for an item of evenly weighted shingles the similarity is the plain one.

The items of one pass are bounded (``BLOCK_ITEMS``); a larger benchmark takes several passes over
the documents, each with its own index. Holders and size classes come from the whole benchmark,
so hits and similarities do not depend on the passes.

Defined cases: null or blank texts have no windows; null or blank items match nothing; items
shorter than a shingle are one shingle of all their words; rows that repeat an id are judged one
by one and the best hit per (doc_id, item_id) stays; null ids are kept as a value; empty
tables give no hits; other columns are ignored.
"""

from __future__ import annotations

import itertools
import struct
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.pieces import hashed_rows
from quarry.llm.skew import materialise, text_batches, worker_cache

RADIUS = 8
BLOCKS = ((0, 21), (21, 21), (42, 22))  # (first bit, bits); two differing bits per block at most
SHINGLE, SIMILARITY = 5, 0.8
BLOCK_ITEMS = 5_000
SEGMENT_WORDS = 1 << 16
KNOWN_WORDS = 200_000
_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())


def token_hash(token: bytes) -> int:
    """64-bit hash of a space-separated token's word; 0 if it has no letter or digit."""
    from xxhash import xxh3_64_intdigest
    if token.isascii():
        word = token.strip(_MARKS).lower()
    else:
        text = token.decode("utf-8", "replace").casefold()
        first, last = 0, len(text)
        while first < last and not text[first].isalnum():
            first += 1
        while last > first and not text[last - 1].isalnum():
            last -= 1
        word = text[first:last].encode()
    return (xxh3_64_intdigest(word) or 1) if word else 0


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """Hashes of the words of each text."""
    return list(hashed_rows(texts, worker_cache("decontaminate_words", dict), token_hash, KNOWN_WORDS))


def window_prints(words: np.ndarray, sums: np.ndarray, w: int) -> np.ndarray:
    """SimHash of every window of ``w`` words; ``sums`` are the running bit sums of the words."""
    ones = sums[w:] - sums[:-w]  # wraps like the sums, so the counts are exact
    return np.packbits(ones > w // 2, axis=1).view("<u8").ravel()


def bit_sums(words: np.ndarray, largest: int) -> np.ndarray:
    kind = "u1" if largest < 256 else "u4"
    bits = np.unpackbits(words.astype("<u8").view("u1").reshape(-1, 8), axis=1)
    sums = np.zeros((len(words) + 1, 64), kind)
    np.cumsum(bits, axis=0, dtype=kind, out=sums[1:])
    return sums


def size_classes(sizes: list[int]) -> list[int]:
    """Window sizes: each item has one of at most its own size, and at least two thirds of it."""
    out: list[int] = []
    for n in sorted(set(sizes)):
        if not out or n > out[-1] * 3 // 2:
            out.append(n)
    return out


@dataclass(frozen=True)
class ClassIndex:
    """Items of one size class: fingerprints, owners, shifts of the item's start, block variants."""
    w: int
    prints: np.ndarray
    owner: np.ndarray
    shift: np.ndarray
    keys: tuple[np.ndarray, ...]
    entry: tuple[np.ndarray, ...]
    seen: tuple[np.ndarray, ...]


def _block(prints: np.ndarray, first: int, bits: int) -> np.ndarray:
    return ((prints >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype("i8")


def build_index(items: list[np.ndarray], sizes: list[int] | None = None) -> list[ClassIndex]:
    """Multi-index over the word hashes of non-empty items; ``sizes`` are those of the whole benchmark."""
    spread = RADIUS // len(BLOCKS)
    out = []
    classes = size_classes(sizes or [len(h) for h in items])
    for w in classes:
        own = [k for k, h in enumerate(items) if max(c for c in classes if c <= len(h)) == w]
        if not own:
            continue
        prints, owner, shift = [], [], []
        for k in own:
            for at in sorted({0, len(items[k]) - w}):
                part = items[k][at:at + w]
                prints.append(window_prints(part, bit_sums(part, w), w)[0])
                owner.append(k)
                shift.append(at)
        prints = np.array(prints, "u8")
        keys, entry, seen = [], [], []
        for first, bits in BLOCKS:
            value = _block(prints, first, bits)
            flips = np.array([sum(1 << b for b in c) for n in range(spread + 1)
                              for c in itertools.combinations(range(bits), n)], "i8")
            near = (value[:, None] ^ flips[None, :]).ravel()
            order = np.argsort(near, kind="stable")
            keys.append(near[order])
            entry.append(np.repeat(np.arange(len(prints)), len(flips))[order])
            table = np.zeros(1 << bits, bool)
            table[near] = True
            seen.append(table)
        out.append(ClassIndex(w, prints, np.array(owner), np.array(shift), tuple(keys), tuple(entry), tuple(seen)))
    return out


def candidates(prints: np.ndarray, index: ClassIndex) -> tuple[np.ndarray, np.ndarray]:
    """(window, entry) pairs within the radius."""
    found = []
    for (first, bits), keys, entry, seen in zip(BLOCKS, index.keys, index.entry, index.seen):
        value = _block(prints, first, bits)
        at = np.flatnonzero(seen.take(value))
        if len(at):
            lo, hi = np.searchsorted(keys, value[at], "left"), np.searchsorted(keys, value[at], "right")
            n = hi - lo
            window = np.repeat(at, n)
            e = entry[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            close = np.bitwise_count(prints[window] ^ index.prints[e]) <= RADIUS
            found.append(np.stack([window[close], e[close]], axis=1))
    if not found:
        return np.empty(0, "i8"), np.empty(0, "i8")
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def shingle_counts(words: np.ndarray, k: int = SHINGLE) -> Counter:
    span, each = min(k, len(words)), words.tolist()
    return Counter(zip(*(each[j:len(each) - span + 1 + j] for j in range(span))))


def shingle_marks(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """20 bits of a hash of every full shingle."""
    n = len(words) - k + 1
    mixed = np.zeros(max(n, 0), "u8")
    for j in range(k if n > 0 else 0):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + words[j:n + j]
    mixed ^= mixed >> np.uint64(32)
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype("i8")


def shingle_key(shingle: tuple) -> int:
    """64-bit hash of a shingle, signed like a Spark long."""
    from xxhash import xxh3_64_digest
    return int.from_bytes(xxh3_64_digest(struct.pack(f"<{len(shingle)}Q", *shingle)), "big", signed=True)


def weighted_similarity(doc: Counter, item: Counter, weight: dict[tuple, float]) -> float:
    """Weighted Jaccard similarity of two shingle multisets; what ``item`` lacks weighs its mean weight."""
    if doc.keys().isdisjoint(item):
        return 0.0
    whole = sum(weight[g] * n for g, n in item.items())
    mean = whole / item.total()
    both = sum(weight[g] * min(n, item[g]) for g, n in doc.items() if g in item)
    total = whole + sum((weight[g] if g in item else mean) * n for g, n in doc.items())
    return both / (total - both)


class _Matcher:
    """The index of one block of items, with the exact check."""

    def __init__(self, texts: list[str], holders: dict[int, int] | None = None, sizes: list[int] | None = None):
        """``holders``: items per shingle key, where several of the whole benchmark hold it."""
        hashed = word_hashes(pa.array(texts, pa.string()))
        self.number = [k for k, h in enumerate(hashed) if len(h)]
        self.items = [hashed[k] for k in self.number]
        self.index = build_index(self.items, sizes)
        self.shingles = [shingle_counts(h) for h in self.items]
        held = holders or {}
        self.weight = {g: 1.0 / held.get(shingle_key(g), 1) for s in self.shingles for g in s}
        self.largest = max((c.w for c in self.index), default=0)
        self.short = np.array([len(h) < SHINGLE for h in self.items])
        self.marks = np.zeros(1 << 20, bool)  # shingles of any item, by 20 bits
        for h in self.items:
            self.marks[shingle_marks(h)] = True

    def _segments(self, docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words, document, offset in the document) in parts of about SEGMENT_WORDS; long documents overlap."""
        words, doc, offset, held = [], [], [], 0
        for d, h in enumerate(docs):
            for at in range(0, max(len(h), 1), SEGMENT_WORDS):
                part = h[at:at + SEGMENT_WORDS + self.largest - 1]
                words.append(part)
                doc.append(np.full(len(part), d))
                offset.append(np.arange(at, at + len(part)))
                held += len(part)
                if held >= SEGMENT_WORDS:
                    yield np.concatenate(words), np.concatenate(doc), np.concatenate(offset)
                    words, doc, offset, held = [], [], [], 0
        if held:
            yield np.concatenate(words), np.concatenate(doc), np.concatenate(offset)

    def hits(self, texts: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """(document, item, first word, words, similarity), the best of each document and item."""
        docs = word_hashes(texts)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for words, doc, offset in self._segments(docs):
            sums = bit_sums(words, self.largest)
            marked = np.zeros(len(words) + 1, "i8")
            found = self.marks[shingle_marks(words)]
            np.cumsum(found, out=marked[1:len(found) + 1])
            marked[len(found) + 1:] = marked[len(found)]
            for c in self.index:
                if len(words) < c.w:
                    continue
                prints = window_prints(words, sums, c.w)
                window, e = candidates(prints, c)
                inside = doc[window] == doc[window + c.w - 1]
                inside &= offset[window + c.w - 1] - offset[window] == c.w - 1
                # the exact check can only succeed where some shingle of an item stands
                low, high = np.maximum(window - c.w // 2 - 2, 0), np.minimum(window + c.w + c.w // 2 + 2, len(words))
                inside &= (marked[high] > marked[low]) | self.short[c.owner[e]]
                for s, k in zip(window[inside].tolist(), e[inside].tolist()):
                    d, item = int(doc[s]), int(c.owner[k])
                    start = int(offset[s]) - int(c.shift[k])
                    if (d, item, start) in tried:
                        continue
                    tried.add((d, item, start))
                    score = {start: self._similarity(docs[d], item, start)}
                    if SIMILARITY / 4 <= score[start] < 1:  # near: the window may sit better
                        for at in (start - 2, start - 1, start + 1, start + 2):
                            if (d, item, at) not in tried:
                                score[at] = self._similarity(docs[d], item, at)
                    for at, got in score.items():
                        if got >= SIMILARITY:
                            best[d, item] = max(best.get((d, item), (0.0, 0)), (got, -at))
        return [(d, self.number[k], -at, len(self.items[k]), s) for (d, k), (s, at) in best.items()]

    def _similarity(self, doc: np.ndarray, item: int, at: int) -> float:
        if at < 0:
            return 0.0
        return weighted_similarity(shingle_counts(doc[at:at + len(self.items[item])]), self.shingles[item], self.weight)


def item_shingles(items: DataFrame) -> DataFrame:
    """(_pass, n_words, words_key, shingle): the different shingles of every item with words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part, row, size, words, shingle = batch.slice(at, 100), [], [], [], []
                for k, h in enumerate(word_hashes(part.column("text"))):
                    keys = [shingle_key(g) for g in shingle_counts(h)] if len(h) else []
                    row += [k] * len(keys)
                    size += [len(h)] * len(keys)
                    words += [shingle_key(tuple(h.tolist()))] * len(keys)
                    shingle += keys
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_pass").take(row), pa.array(size, pa.int64()),
                     pa.array(words, pa.int64()), pa.array(shingle, pa.int64())],
                    names=["_pass", "n_words", "words_key", "shingle"])

    return items.select("_pass", "text").mapInArrow(run, "_pass long, n_words long, words_key long, shingle long")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): benchmark items found in documents.

    Positions count the words of the document from 0.
    """
    items = materialise(benchmark.select(benchmark[item_col].cast("long").alias("item_id"),
                                         benchmark[item_text].cast("string").alias("text"))
                        .where("text is not null").distinct(), "benchmark-items")
    passes = max(1, -(-items.count() // block_items))
    # hashing deals items evenly; a pass holds about block_items of them
    dealt = items.withColumn("_pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
    rows = text_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    shingles = materialise(item_shingles(dealt), "benchmark-shingles")
    sizes = sorted(r[0] for r in shingles.select("n_words").distinct().collect())
    shared = (shingles.groupBy("shingle").agg(F.count_distinct("words_key").alias("n")).where("n > 1"))
    shared = materialise(shingles.select("_pass", "shingle").distinct().join(shared, "shingle"), "benchmark-shared")
    out = None
    for k in range(passes):
        part = dealt.where(F.col("_pass") == k).orderBy("item_id", "text").collect()
        holders = {r["shingle"]: r["n"] for r in shared.where(F.col("_pass") == k).collect()}
        hits = _one_pass(rows, [r["item_id"] for r in part], [r["text"] for r in part], holders, sizes)
        out = hits if out is None else out.unionByName(hits)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("neg"), "n_words")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.neg")).alias("first_word"), "b.n_words", "b.similarity")


def _one_pass(rows: DataFrame, ids: list[int], texts: list[str], holders: dict[int, int], sizes: list[int]) -> DataFrame:
    key = hash((tuple(ids), tuple(texts), tuple(sorted(holders.items())), tuple(sizes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_cache("decontaminate_index", dict)
        if key not in held:
            held.clear()
            held[key] = _Matcher(texts, holders, sizes)
        matcher = held[key]
        for batch in batches:
            column, doc = batch.column("text"), batch.column("doc_id")
            for at in range(0, len(column), 1000):
                found = matcher.hits(column.slice(at, 1000))
                yield pa.RecordBatch.from_arrays(
                    [doc.take(pa.array([at + h[0] for h in found], pa.int64())),
                     pa.array([ids[h[1]] for h in found], pa.int64()), pa.array([h[2] for h in found], pa.int64()),
                     pa.array([h[3] for h in found], pa.int64()), pa.array([h[4] for h in found], pa.float64())],
                    names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

    return rows.mapInArrow(run, "doc_id long, item_id long, first_word long, n_words long, similarity double")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item, all columns as they were."""
    leaks = materialise(find_leaks(docs, benchmark, id_col, text_col), "leaks")
    gone = leaks.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["_gone"]), "left_anti")


cloudpickle.register_pickle_by_value(sys.modules[__name__])

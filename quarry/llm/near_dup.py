"""Near-duplicate groups by MinHash with tensored banding, every link verified on full sets.

A document is the set of its k-word shingles. Its min-hashes are taken for ``collections``
small collections of ``rows`` hashes each; a table key combines two collections, so m
collections give m(m-1)/2 tables for m * rows min-hashes. Documents that share a table key
are candidates. A pair of similarity s is missed only if fewer than two collections agree;
with 14 collections of two hashes that is 1.6e-5 at s = 0.8 and less above.

Steps:
1. Equal sets form one class; only one document per class goes on.
2. Collection keys that occur once cannot be part of a shared table key and drop out.
3. In each bucket (table key) the member with most shared collections is the pivot. All
   members are compared with their pivots on full shingle sets: a few pairs per document,
   whatever the size of the group.
4. Verified links give components. Members of one pivot that ended in different components
   are then compared with each other in blocks, unless the distances to the pivot rule a link
   out (Jaccard distance is a metric). So every pair that shares a table key is verified or
   already connected, and no group is expanded into all its pairs as rows.

Defined cases: null or blank texts have an empty set and link with nothing; fewer than k words
give one shingle of the whole sequence; rows without an id link with nothing (component_id
null, kept); rows that repeat an id are one node; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.pieces import hashed_rows
from quarry.llm.skew import key_bitmap, materialise, maybe_in, salted_join, text_batches, worker_cache

COLLECTIONS, ROWS = 14, 2
KNOWN_WORDS = 150_000  # word hashes kept per worker
BLOCK_DOCS, BLOCK_SHINGLES = 256, 400_000


_MULT = np.random.default_rng(20_240_501).integers(1, 2 ** 63, 64, dtype="u8") * np.uint64(2) + np.uint64(1)


def _word_hash(word: bytes) -> int:
    from xxhash import xxh3_64_intdigest
    return xxh3_64_intdigest(word) or 1 if word else 0


def column_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The shingle set of each text of a column (A-Z lower-cased, words between ASCII white space)."""
    for words in hashed_rows(column, worker_cache("near_words", dict), _word_hash, KNOWN_WORDS, pc.ascii_lower):
        yield shingle_set(words, k)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a sequence of word hashes."""
    if not len(h):
        return np.empty(0, "u8")
    span = min(k, len(h))
    mixed = np.zeros(len(h) - span + 1, "u8")
    for j in range(span):
        mixed += h[j:len(h) - span + 1 + j] * _MULT[j]
    mixed += np.uint64(span)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def minhashes(shingles: np.ndarray, count: int) -> np.ndarray:
    """``count`` min-hashes of a non-empty set, in parts of bounded size."""
    rng = np.random.default_rng(77)
    mult = (rng.integers(1, 2 ** 63, count, dtype="u8") * np.uint64(2) + np.uint64(1))[:, None]
    flip = rng.integers(0, 2 ** 63, count, dtype="u8")[:, None]
    least = None
    for at in range(0, len(shingles), 1 << 16):
        part = ((shingles[None, at:at + (1 << 16)] ^ flip) * mult).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return least


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return text_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def signatures(docs: DataFrame, k: int, collections: int = COLLECTIONS, rows: int = ROWS, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, hi, lo, keys): set size, 128-bit set digest, one key per collection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest
        for batch in batches:
            sizes, digests, keys = [], [], []
            for s in column_sets(batch.column("text"), k):
                sizes.append(len(s))
                digests.append(xxh3_128_digest(s.tobytes()))
                if len(s):
                    mins = minhashes(s, collections * rows).reshape(collections, rows)
                    key = np.arange(1, collections + 1, dtype="u8")
                    for j in range(rows):
                        key = (key ^ mins[:, j]) * np.uint64(0x9E3779B97F4A7C15)
                        key ^= key >> np.uint64(32)
                    keys.append(key.view("i8"))
                else:
                    keys.append(np.empty(0, "i8"))
            pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]),
                 pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "hi", "lo", "keys"])

    return _rows(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_shingles long, hi long, lo long, keys array<long>")


def shingle_sets(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, shingles): full sets as sorted array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view("i8") for s in column_sets(batch.column("text"), k)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))],
                                             names=["doc_id", "shingles"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, shingles array<long>")


def table_keys(classes: DataFrame) -> DataFrame:
    """(rep, shared, bucket) of ``classes`` (rep, keys): one row per pair of collections that others share.

    ``shared`` counts the collections whose key occurs elsewhere.
    """
    each = classes.select("rep", F.posexplode("keys").alias("c", "key"))
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    bitmap = materialise(key_bitmap(often, "key"), "near-collections")
    live = (maybe_in(each, "key", bitmap).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("live"))
            .where(F.size("live") > 1))
    pairs = F.flatten(F.transform("live", lambda a, i: F.transform(
        F.slice("live", i + 2, F.size("live")), lambda b: F.xxhash64(a["key"], b["key"]))))
    return live.select("rep", F.size("live").alias("shared"), F.explode(pairs).alias("bucket"))


def pivot_pairs(keys: DataFrame) -> DataFrame:
    """Distinct (x, p): every member of a bucket with the bucket's pivot."""
    keys = materialise(keys, "near-tables")
    pivots = materialise(keys.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct("shared", (-F.col("rep")).alias("neg"))).alias("_top"))
        .where("_n > 1").select("bucket", "_n", (-F.col("_top.neg")).alias("p")), "near-pivots")
    total = pivots.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return (salted_join(keys, pivots, ["bucket"], [F.col("rep")], "_n", total)
            .where("rep <> p").select(F.col("rep").alias("x"), "p").distinct())


def _with_sets(rows: DataFrame, sets: DataFrame, on: str, name: str) -> DataFrame:
    """``rows`` with the shingle set of column ``on``; a frequent value is joined over salts."""
    counts = rows.groupBy(F.col(on).alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    right = sets.join(counts, sets["doc_id"] == counts["_id"]).select(F.col("_id").alias(on), "_n", F.col("shingles").alias(name))
    spread = [F.col(c) for c in rows.columns if c != on]
    return salted_join(rows, right, [on], spread, "_n", rows.count()).drop("_n")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (x, p) with nx and np_ (set sizes) and shared (size of the intersection)."""
    left = _with_sets(pairs, sets, "x", "_a")
    return (_with_sets(left, sets, "p", "_b")
            .select("x", "p", F.size("_a").cast("long").alias("nx"), F.size("_b").cast("long").alias("np_"),
                    F.size(F.array_intersect("_a", "_b")).cast("long").alias("shared")))


def _is_link(shared, union, percent: int):
    return 100 * shared >= percent * union


def block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between components inside each pivot's group, found block against block.

    ``members``: p, x, nx, d (distance to p), comp. A group of more than ``BLOCK_DOCS`` is cut
    by distance to its pivot, then by hash, into blocks of about that many documents (or
    ``BLOCK_SHINGLES`` shingles); two blocks meet if one has a document outside the pivot's
    component and their distances are near enough for a link.
    """
    reach = 1 - percent / 100
    sized = members.groupBy("p").agg(F.count(F.lit(1)).alias("_gn"), F.sum("nx").alias("_gs"),
                                     F.min("comp").alias("_c0"), F.max("comp").alias("_c1"))
    open_ = materialise(sized.where("_gn > 1 and _c0 <> _c1"), "near-open-groups")
    total = open_.agg(F.coalesce(F.sum("_gn"), F.lit(0))).first()[0]
    if total == 0:
        return members.select(F.col("x").alias("u"), F.col("x").alias("v")).limit(0)
    band = F.when((F.col("_gn") > BLOCK_DOCS) | (F.col("_gs") > BLOCK_SHINGLES), F.floor(F.col("d") * 20)).otherwise(F.lit(0))
    banded = materialise(salted_join(members, open_.select("p", "_gn", "_gs"), ["p"], [F.col("x")], "_gn", total)
                         .withColumn("band", band.cast("int")).drop("_gn", "_gs"), "near-bands")
    cells = banded.groupBy("p", "band").agg(F.count(F.lit(1)).alias("_n"), F.sum("nx").alias("_s"))
    cells = materialise(cells.withColumn("_k", F.greatest(F.ceil(F.col("_n") / BLOCK_DOCS),
                                                          F.ceil(F.col("_s") / BLOCK_SHINGLES)).cast("int")), "near-cells")
    placed = materialise(
        salted_join(banded, cells.select("p", "band", "_n", "_k"), ["p", "band"], [F.col("x")], "_n", total)
        .withColumn("block", F.pmod(F.xxhash64("x"), F.col("_k")).cast("int")).drop("_n", "_k"), "near-blocks")
    facts = materialise(placed.groupBy("p", "band", "block").agg(
        F.min("d").alias("lo"), F.max("d").alias("hi"), F.min("comp").alias("c0"), F.max("comp").alias("c1"),
        F.count(F.lit(1)).alias("_n")), "near-block-facts")
    # two blocks of one component have nothing to find, nor have two whose distances are too far apart
    names = ["band", "block", "lo", "hi", "c0", "c1"]
    a, b = (facts.select("p", *(F.col(c).alias(f"{s}_{c}") for c in names)) for s in "ab")
    meet = materialise(
        a.join(b, "p").where("(a_band < b_band) or (a_band = b_band and a_block <= b_block)")
        .where((F.col("b_lo") - F.col("a_hi") <= reach + 1e-9) & (F.col("a_lo") - F.col("b_hi") <= reach + 1e-9))
        .where("least(a_c0, b_c0) <> greatest(a_c1, b_c1)")
        .select("p", "a_band", "a_block", "b_band", "b_block")
        .withColumn("pair", F.xxhash64("p", "a_band", "a_block", "b_band", "b_block")), "near-block-pairs")
    sides = (meet.select("p", "pair", F.col("a_band").alias("band"), F.col("a_block").alias("block"))
             .unionByName(meet.select("p", "pair", F.col("b_band").alias("band"), F.col("b_block").alias("block"))).distinct())
    dealt = materialise(placed.join(sides, ["p", "band", "block"]).select("pair", "x", "comp"), "near-block-rows")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = np.array([len(s) for s in pdf["_s"]])
        flat, owner = np.concatenate(list(pdf["_s"])), np.repeat(np.arange(len(pdf)), sizes)
        _, code, seen = np.unique(flat, return_inverse=True, return_counts=True)
        column = np.cumsum(seen > 1) - 1
        keep = seen[code] > 1
        comps, comp = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
        common = np.zeros((len(pdf), len(pdf)), "float32")
        code, owner = column[code[keep]], owner[keep]
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):  # shared shingles in slices
            part = (code >= at) & (code < at + 4096)
            table = np.zeros((len(pdf), 4096), "float32")
            table[owner[part], code[part] - at] = 1
            common += table @ table.T
        i, j = np.nonzero(np.triu(100 * common >= percent * (sizes[:, None] + sizes[None, :] - common), 1))
        root = list(range(len(comps)))

        def find(v: int) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for x, y in zip(comp[i].tolist(), comp[j].tolist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        joined = [(comps[v], comps[find(v)]) for v in range(len(comps)) if find(v) != v]
        return pd.DataFrame(joined, columns=["u", "v"]).astype("int64")

    return (_with_sets(dealt, sets, "x", "_s").groupBy("pair").applyInPandas(links, "u long, v long"))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Links join documents whose k-word shingle sets have Jaccard similarity of at least
    ``percent`` / 100; ``component_id`` is the smallest id reachable over links.
    """
    signed = materialise(signatures(docs, k, id_col=id_col, text_col=text_col), "near-signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(full.groupBy("hi", "lo").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_n"), F.first("keys").alias("keys")), "near-classes")
    pairs = materialise(pivot_pairs(table_keys(classes)), "near-pairs")
    wanted = pairs.select(F.col("x").alias("doc_id")).unionByName(pairs.select(F.col("p").alias("doc_id"))).distinct()
    wanted = materialise(wanted, "near-wanted")
    rows = _rows(docs, id_col, text_col)
    some = maybe_in(rows, "doc_id", materialise(key_bitmap(wanted, "doc_id"), "near-wanted-bitmap"))
    sets = materialise(shingle_sets(some.join(wanted, "doc_id", "left_semi"), k)
                       .groupBy("doc_id").agg(F.min("shingles").alias("shingles")), "near-sets")  # of a repeated id the least set

    union = F.col("nx") + F.col("np_") - F.col("shared")
    checked = materialise(verify(pairs, sets).withColumn("linked", _is_link(F.col("shared"), union, percent))
                          .withColumn("d", 1 - F.col("shared") / union), "near-checked")
    # rows that repeat an id may stand in several classes
    key = F.xxhash64("hi", "lo")
    repeats = full.groupBy("doc_id").agg(F.min(key).alias("_least"), F.max(key).alias("_most")).where("_least <> _most").select("doc_id")
    extra = materialise(full.join(repeats, "doc_id").select("hi", "lo", F.col("doc_id").alias("v")).distinct()
                        .join(classes.select("hi", "lo", F.col("rep").alias("u")), ["hi", "lo"])
                        .where("u <> v").select("u", "v"), "near-repeated-ids")
    edges = checked.where("linked").select(F.col("x").alias("u"), F.col("p").alias("v")).unionByName(extra)
    first = components(edges)
    comp = first.select(F.col("node").alias("x"), "comp")
    members = materialise(checked.join(comp, "x", "left").select(
        "p", "x", "nx", "d", F.coalesce("comp", "x").alias("comp")), "near-members")
    more = materialise(block_links(members, sets, percent), "near-block-links")
    # links between components: the components' smallest ids stand for them
    final = first
    if not more.isEmpty():
        final = components(first.select(F.col("node").alias("u"), F.col("comp").alias("v")).unionByName(more))
    named = classes.join(final.select(F.col("node").alias("rep"), "comp"), "rep", "left").select(
        "hi", "lo", "_n", F.coalesce("comp", "rep").alias("comp"))
    named = materialise(named, "near-named")
    total = named.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    linkable = salted_join(full.select("hi", "lo", "doc_id", "n_shingles"), named, ["hi", "lo"], [F.col("doc_id")], "_n", total)
    alone = signed.where("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    every = linkable.select("doc_id", "n_shingles", F.col("comp").alias("component_id")).unionByName(alone)
    return every.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id",
                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id."""
    decided = materialise(near_groups(docs, k, percent, id_col, text_col), "near-decisions")
    gone = decided.where("not kept").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


cloudpickle.register_pickle_by_value(sys.modules[__name__])

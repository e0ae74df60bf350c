"""SimHash near-duplicates by a self-join of the binary trie of all fingerprints.

A fingerprint has one bit per bit of the shingles' 64-bit hashes: set where more than half of
the hashes have it set. Distinct fingerprints are the leaves of a binary trie. The join walks
pairs of nodes of equal depth together, from (root, root); a pair carries the number of bits
in which its two prefixes differ and is dropped as soon as that exceeds the budget. Two
distinct fingerprints have at most 1 + 64 + 2016 others within two bits, so links and node
pairs grow in proportion to the fingerprints, whatever the size of a group of copies.

Steps:
1. Fingerprints per document; equal ones form one leaf with the smallest id as its name.
2. Top of the trie: Spark expands node pairs four levels at a time, as a join of the open
   pairs with the nodes' children, until a pair holds few leaves. Dense parts of the trie
   go deeper than sparse ones.
3. Below: the leaves of a closed pair meet in one task (a bounded number), which walks the
   rest of the two subtrees, level by level over arrays, and returns a spanning forest of
   the links found.
4. Links give components; a document takes the component of its fingerprint.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other; fewer
than k words give one shingle of the whole sequence; rows without an id get a fingerprint and
link with nothing (component_id null); rows that repeat an id are one node, so their
fingerprints are linked; repeated rows stay; an empty table gives an empty result; other
columns are ignored. Long texts are hashed in parts of bounded size.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.skew import materialise, salted_join, text_batches

LEAVES = 1_024  # a node pair is closed when it holds at most twice as many fingerprints
STEP = 4  # trie levels per round
PART = 1 << 16  # shingles hashed at a time
PAIRS = 1 << 18  # node pairs walked at a time in a task


def simhash(text: bytes | None, k: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text (UTF-8): A-Z lower-cased, words between ASCII white space."""
    from xxhash import xxh64_intdigest
    words = (text or b"").lower().split()
    if not words:
        return 0
    line, span = b" ".join(words), min(k, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:len(words) - span + 1]
    ends = ends[span - 1:] - 1
    ones = np.zeros(64, "i8")
    for at in range(0, len(starts), PART):
        cut = zip(starts[at:at + PART].tolist(), ends[at:at + PART].tolist())
        hashes = np.array([xxh64_intdigest(line[s:e], seed) for s, e in cut], "<u8")
        ones += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp holds the 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            prints = np.fromiter((simhash(t.as_py(), k) for t in texts), "u8", len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view("i8"))], names=["doc_id", "fp"])

    rows = text_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _prefix(fp: str, level: int) -> Column:
    """The first ``level`` bits of a fingerprint: the name of its trie node at that depth."""
    return F.shiftrightunsigned(fp, 64 - level) if level else F.lit(0).cast("long")


def node_pairs(leaves: DataFrame, budget: int, most: int = LEAVES) -> list[tuple[int, DataFrame]]:
    """[(level, pairs)]: closed node pairs (a, b), a <= b, which together cover all pairs of leaves within budget.

    ``leaves``: distinct fp. A pair is closed when its nodes hold at most 2 * ``most`` leaves.
    """
    size = leaves.count()
    zero = F.lit(0).cast("long")
    root = leaves.sparkSession.range(1).select(zero.alias("a"), zero.alias("b"), F.lit(size).cast("long").alias("n"))
    open_ = materialise(root, "trie-root")  # written: joins with literals would become nested loops
    closed, level = [], 0
    while True:
        if level + STEP >= 64:
            return [*closed, (level, open_.select("a", "b"))]
        closed.append((level, open_.where(F.col("n") <= 2 * most).select("a", "b")))
        open_ = open_.where(F.col("n") > 2 * most)
        if open_.isEmpty():
            return closed
        live = open_.select("a").unionByName(open_.select(F.col("b").alias("a"))).distinct()
        level += STEP
        kids = (leaves.select(_prefix("fp", level).alias("kid")).groupBy("kid").agg(F.count(F.lit(1)).alias("n"))
                .withColumn("a", F.shiftright("kid", STEP)).join(live, "a", "left_semi"))
        kids = materialise(kids, "trie-nodes")
        left = kids.select("a", F.col("kid").alias("_a"), F.col("n").alias("_na"))
        right = kids.select(F.col("a").alias("b"), F.col("kid").alias("_b"), F.col("n").alias("_nb"))
        open_ = materialise(
            open_.drop("n").join(left, "a").join(right, "b").where("a <> b or _a <= _b")
            .where(F.bit_count(F.col("_a").bitwiseXOR(F.col("_b"))) <= budget)
            .select(F.col("_a").alias("a"), F.col("_b").alias("b"),
                    F.when(F.col("_a") == F.col("_b"), F.col("_na")).otherwise(F.col("_na") + F.col("_nb")).alias("n")),
            "trie-pairs")


def walk(values: np.ndarray, cut: int, level: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of ``values`` within ``budget`` bits, by walking two subtries together.

    ``values``: distinct unsigned fingerprints; values[:cut] sorted below one node of depth
    ``level``, values[cut:] below another. With nothing after ``cut`` the node meets itself.
    A subtrie is a range of the sorted values; a node's children split its range at a bit.
    """
    own = cut == len(values)
    first = np.array([[0], [cut], [0 if own else cut], [len(values)]])
    apart = 0 if own else int(values[0] ^ values[cut]) >> (64 - level) if level else 0
    stack = [(level, first, np.array([apart.bit_count()]))]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    upto: dict[int, np.ndarray] = {}
    while stack:
        level, nodes, apart = stack.pop()
        if len(apart) > PAIRS:  # bounded memory: the second half waits
            half = len(apart) // 2
            stack += [(level, nodes[:, half:], apart[half:]), (level, nodes[:, :half], apart[:half])]
            continue
        alo, ahi, blo, bhi = nodes
        few = (ahi - alo) * (bhi - blo) <= 16
        if few.any():
            found.append(_compare(values, *nodes[:, few], budget))
            nodes, apart = nodes[:, ~few], apart[~few]
            alo, ahi, blo, bhi = nodes
        if not len(apart):
            continue
        if level not in upto:  # number of set bits before each place
            bit = (values >> np.uint64(63 - level)) & np.uint64(1)
            upto[level] = np.concatenate([[0], np.cumsum(bit.astype("i8"))])
        ones = upto[level]
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same = (alo == blo) & (ahi == bhi)
        kids = [(alo, amid, blo, bmid, apart, None), (amid, ahi, bmid, bhi, apart, None),
                (alo, amid, bmid, bhi, apart + 1, None), (amid, ahi, blo, bmid, apart + 1, same)]
        parts = []
        for a0, a1, b0, b1, d, skip in kids:
            keep = (a0 < a1) & (b0 < b1) & (d <= budget)
            if skip is not None:
                keep &= ~skip
            parts.append((np.stack([a0, a1, b0, b1])[:, keep], d[keep]))
        stack.append((level + 1, np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts])))
    if not found:
        return np.empty(0, "i8"), np.empty(0, "i8")
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _compare(values, alo, ahi, blo, bhi, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs between small ranges that are within the budget."""
    size = (ahi - alo) * (bhi - blo)
    before = np.cumsum(size) - size
    k = np.arange(int(size.sum())) - np.repeat(before, size)
    width = np.repeat(bhi - blo, size)
    i, j = np.repeat(alo, size) + k // width, np.repeat(blo, size) + k % width
    near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
    return i[near], j[near]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the smallest place reachable over the links (i, j)."""
    label = np.arange(n)
    while True:
        li, lj = label[i], label[j]
        if (li == lj).all():
            return label
        low = np.minimum(li, lj)
        np.minimum.at(label, li, low)
        np.minimum.at(label, lj, low)
        while (label != label[label]).any():
            label = label[label]


def hamming_links(leaves: DataFrame, budget: int, most: int = LEAVES) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of ``leaves`` (fp, rep) within ``budget`` bits.

    u and v are values of ``rep``.
    """
    parts = []
    for level, pairs in node_pairs(leaves, budget, most):
        sides = (pairs.select("a", "b", F.col("a").alias("node"), F.lit(0).alias("side"))
                 .unionByName(pairs.where("a <> b").select("a", "b", F.col("b").alias("node"), F.lit(1).alias("side"))))
        parts.append(leaves.withColumn("node", _prefix("fp", level)).join(sides, "node")
                     .select(F.lit(level).alias("level"), "a", "b", "side", "fp", "rep"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view("u8")
        side, rep = table.column("side").to_numpy(), table.column("rep").to_numpy()
        order = np.lexsort((fp, side))
        fp, rep = fp[order], rep[order]
        cut = int((side == 0).sum())
        i, j = walk(fp, cut, table.column("level")[0].as_py(), budget)
        label = forest(i, j, len(fp))
        at = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"u": rep[label[at]], "v": rep[at]})

    return rows.groupBy("level", "a", "b").applyInArrow(run, "u long, v long")


def simhash_groups(docs: DataFrame, k: int = 3, budget: int = 2, id_col: str = "doc_id", text_col: str = "text",
                   most: int = LEAVES) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest id reachable over links between fingerprints that differ
    in at most ``budget`` bits.
    """
    prints = materialise(fingerprints(docs, k, id_col, text_col), "trie-prints")
    named = prints.where("doc_id is not null")
    leaves = materialise(named.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_n")), "trie-leaves")
    links = hamming_links(leaves.select("fp", "rep"), budget, most)
    # an id on rows of different fingerprints joins them
    twice = (named.groupBy("doc_id").agg(F.min("fp").alias("fp"), F.max("fp").alias("_last")).where("fp <> _last")
             .select("doc_id"))
    bridges = (named.join(twice, "doc_id").distinct().join(leaves.select("fp", "rep"), "fp")
               .select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    comp = components(links.unionByName(bridges))
    of_print = materialise(leaves.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
                           .select("fp", "_n", F.coalesce("comp", "rep").alias("component_id")), "trie-components")
    total = of_print.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    found = salted_join(named, of_print, ["fp"], [F.col("doc_id")], "_n", total).select("doc_id", "fp", "component_id")
    every = found.unionByName(prints.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))
    return every.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


cloudpickle.register_pickle_by_value(sys.modules[__name__])

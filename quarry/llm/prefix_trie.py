"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns. It is named by its smallest member and its
depth: the nodes whose smallest member is c are the tail of c's own path, so (conv_id, depth)
is a key, and a parent is (parent_conv_id, depth - 1).

Building the nodes:
1. Turns are sorted by range over files; a turn's place is its rank in the table less the
   rank of its conversation's first turn, so no conversation is gathered.
2. A prefix is named by two 64-bit hashes, the exclusive or of its turns' hashes (each with
   its depth). They run over bands of ``band`` turns; the totals of bands run over bands.
3. Equal prefixes are one node (partial aggregation; common prefixes stay cheap).

Subtree totals: the trie is cut into shards: at each depth that is a multiple of ``band``, and
wherever the number of members falls below a power of ``width``. So a piece between cuts has
fewer than ``width`` nodes at each of at most ``band`` depths. Then
* within shards, nodes are sorted by reverse level order (Spark's sort, which spills), and a
  priority queue that spills to sorted runs carries each node's totals forward to the time
  its parent is processed;
* across shard roots, totals go up one cut at a time, as sums over the roots of that rank;
* within shards again, with the totals of the shard roots below as further messages.

Digests of members that end at a node: their ids are sorted by range, joined to strings of
bounded length where they lie, and the strings of one node are hashed as a stream.

Defined cases: null role or text counts as empty; null turns come first; turns that are equal
are ordered by role, then text; repeated rows are turns of their own; rows without a
conversation id are left out; negative ids take SQL's remainder (its sign is that of the id);
an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import sys
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.skew import materialise, salted_join

BAND, WIDTH = 64, 256
QUEUE = 200_000  # messages a queue holds in memory
CHUNK = 1 << 14  # characters of joined ids per row


def ranked_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """(conv_id, rank, hi, lo, bytes): turns in order, with their rank in the whole table and two hashes."""
    turns = rows.select(rows[conv].cast("long").alias("conv_id"), rows[turn].cast("long").alias("turn"),
                        F.coalesce(rows[role].cast("string"), F.lit("")).alias("role"),
                        F.coalesce(rows[text].cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    hashed = (turns.repartitionByRange(*order).sortWithinPartitions(*order)
              .select("conv_id", F.xxhash64("role", "text").alias("hi"),
                      F.xxhash64(F.lit("lo"), "text", "role").alias("lo"), F.octet_length("text").cast("long").alias("bytes")))
    return _with_rank(materialise(hashed, "turns-sorted"))


def _with_rank(written: DataFrame) -> DataFrame:
    """Rows of a written table with ``rank``: their place over all its files, in order of file number and row."""
    rows = written.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_size"))  # one row per file
    before = files.select("_file", F.coalesce(F.sum("_size").over(
        Window.orderBy(F.length("_file"), "_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(before, "_file").select(*written.columns, (F.col("_before") + F.col("_row")).alias("rank"))


MOST_SHARED = 8


def shared_head(conv: Column) -> Column:
    """How many first turns a conversation takes from its family's first."""
    return F.crc32(conv.cast("string").cast("binary")) % (MOST_SHARED + 1)


def rebuilt_turns(rows: DataFrame, family: int = 5) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): (conv_id, depth, hi, lo, bytes) of the rebuilt conversations, (conv_id, n) for each.

    Conversation c begins with the first ``shared_head`` turns of conversation c - c % family
    and goes on with its own turns after as many of its own.
    """
    turns = materialise(ranked_turns(rows), "turns-ranked")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"), F.min("rank").alias("_first"))
    plan = sizes.select("*", (F.col("conv_id") - F.col("conv_id") % family).alias("_base"), shared_head(F.col("conv_id")).alias("_h"))
    base = sizes.select(F.col("conv_id").alias("_base"), F.col("_n").alias("_base_n"))
    convs = materialise(
        plan.join(base, "_base", "left").withColumn("_head", F.least("_h", F.coalesce("_base_n", F.lit(0))))
        .withColumn("n", F.col("_head") + F.greatest(F.col("_n") - F.col("_h"), F.lit(0))), "trie-convs")
    total = turns.count()
    placed = salted_join(turns, convs.select("conv_id", "_n", "_first", "_base", "_h", "_head"), ["conv_id"], [F.col("rank")],
                         "_n", total).withColumn("_place", F.col("rank") - F.col("_first") + 1)
    own = (placed.where("_place > _h or conv_id = _base")
           .withColumn("depth", F.when(F.col("conv_id") == F.col("_base"), F.col("_place"))
                       .otherwise(F.col("_place") - F.col("_h") + F.col("_head"))))
    heads = (placed.where((F.col("conv_id") == F.col("_base")) & (F.col("_place") <= MOST_SHARED))
             .select(F.col("conv_id").alias("_base"), F.col("_place").alias("depth"), "hi", "lo", "bytes"))
    taken = (heads.join(convs.where("conv_id <> _base").select("conv_id", "_base", "_head"), "_base").where("depth <= _head"))
    names = ["conv_id", "depth", "hi", "lo", "bytes"]
    return own.select(*names).unionByName(taken.select(*names)), convs.select("conv_id", "n")


def prefix_rows(turns: DataFrame, band: int = BAND) -> DataFrame:
    """(conv_id, depth, bytes, hi, lo): each turn with the two hashes of the prefix that it ends."""
    salted = turns.select("conv_id", "depth", "bytes", F.floor((F.col("depth") - 1) / band).alias("_band"),
                          F.xxhash64("depth", "hi", "lo").alias("hi"), F.xxhash64(F.lit("lo"), "lo", "depth", "hi").alias("lo"))
    salted = materialise(salted, "trie-turns")
    order = Window.partitionBy("conv_id", "_band").orderBy("depth")
    inside = salted.select("*", F.bit_xor("hi").over(order).alias("_hi"), F.bit_xor("lo").over(order).alias("_lo"))
    first = inside.where("_band = 0").select("conv_id", "depth", "bytes", F.col("_hi").alias("hi"), F.col("_lo").alias("lo"))
    bands = salted.groupBy("conv_id", "_band").agg(F.bit_xor("hi").alias("hi"), F.bit_xor("lo").alias("lo"))
    so_far = Window.partitionBy("conv_id").orderBy("_band")
    before = (bands.select("conv_id", (F.col("_band") + 1).alias("_band"), F.bit_xor("hi").over(so_far).alias("hi"),
                           F.bit_xor("lo").over(so_far).alias("lo")))
    later = (inside.where("_band > 0").drop("hi", "lo").join(before, ["conv_id", "_band"])
             .select("conv_id", "depth", "bytes", F.col("hi").bitwiseXOR(F.col("_hi")).alias("hi"),
                     F.col("lo").bitwiseXOR(F.col("_lo")).alias("lo")))
    return first.unionByName(later)


def trie_nodes(prefixes: DataFrame, convs: DataFrame, band: int = BAND, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): the trie's nodes with their shard roots, and (conv_id, depth, member) of each end.

    nodes: conv_id, depth, parent_conv_id, n_convs, bytes, root_conv, root_depth.
    """
    prefixes = materialise(prefixes, "trie-prefixes")
    key = ["depth", "hi", "lo"]
    nodes = materialise(prefixes.groupBy(*key).agg(
        F.min("conv_id").alias("name"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes")), "trie-prefix-nodes")
    least, members = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()  # the root is one row
    at_top = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"),
                          F.lit(least).cast("long").alias("name"), F.lit(members).cast("long").alias("n_convs"))
    named = salted_join(prefixes.drop("bytes"), nodes, key, [F.col("conv_id")], "n_convs", prefixes.count())
    paths = materialise(named.select("conv_id", "depth", "bytes", "name", "n_convs").unionByName(at_top), "trie-paths")
    ends = paths.join(convs, "conv_id").where("depth = n").select(
        F.col("name").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    # the last turn of a band is seen again before the next band, so that its first turn knows its parent
    rank = F.floor(F.log(F.col("n_convs").cast("double")) / F.log(F.lit(float(width)))).cast("int")
    with_rank = paths.select("*", rank.alias("_rank"), F.floor(F.col("depth") / band).alias("_band"), F.lit(True).alias("_own"))
    again = (with_rank.where((F.col("depth") + 1) % band == 0)
             .withColumns({"_band": F.col("_band") + 1, "_own": F.lit(False)}))
    order = Window.partitionBy("conv_id", "_band").orderBy("depth")
    before = (F.lag("name").over(order), F.lag("_rank").over(order))
    cut = (F.col("depth") % band == 0) | (F.col("_rank") != F.col("_rank_before"))
    seen = (with_rank.unionByName(again).select("*", before[0].alias("parent_conv_id"), before[1].alias("_rank_before"))
            .where("_own"))
    rooted = seen.select("*", F.max(F.when(cut, F.struct("depth", "name"))).over(order).alias("_root"))
    return rooted.where("conv_id = name").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "bytes",
        F.col("_root.name").alias("root_conv"), F.col("_root.depth").alias("root_depth")), ends


class ForwardQueue:
    """Messages (depth, conv, totals) to nodes, taken in reverse level order; beyond ``most`` they go to sorted runs.

    The runs lie where Spark itself spills on that executor, and end with the task.
    """

    def __init__(self, most: int = QUEUE):
        self.most, self.heap, self.runs, self.folder = most, [], [], None

    def send(self, depth: int, conv: int, leaves: int, saved: int) -> None:
        heapq.heappush(self.heap, (-depth, conv, leaves, saved))
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        if self.folder is None:
            local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]  # set by Spark in its workers
            self.folder = tempfile.TemporaryDirectory(prefix="forward-queue-", dir=local or None)
        path = os.path.join(self.folder.name, f"{len(self.runs)}")
        with open(path, "wb") as out:
            for message in sorted(self.heap):
                pickle.dump(message, out)
        self.heap = []
        run = self._read(path)
        self.runs.append([next(run), run])

    @staticmethod
    def _read(path: str) -> Iterator[tuple]:
        with open(path, "rb") as f:
            while True:
                try:
                    yield pickle.load(f)
                except EOFError:
                    return

    def take(self, depth: int, conv: int) -> tuple[int, int]:
        """The summed totals of all messages to a node; its turn comes after all earlier nodes'."""
        leaves = saved = 0
        at = (-depth, conv)
        while self.heap and self.heap[0][:2] == at:
            _, _, n, s = heapq.heappop(self.heap)
            leaves, saved = leaves + n, saved + s
        for run in self.runs:
            while run[0] is not None and run[0][:2] == at:
                leaves, saved = leaves + run[0][2], saved + run[0][3]
                run[0] = next(run[1], None)
        return leaves, saved

    def close(self) -> None:
        for run in self.runs:
            run[1].close()
        if self.folder:
            self.folder.cleanup()


_NODE = "conv_id long, depth long, parent_conv_id long, root_conv long, root_depth long, leaves long, saved long"


def within_shards(nodes: DataFrame, roots_only: bool, most: int = QUEUE) -> DataFrame:
    """Totals of ``nodes`` (``_NODE``) over what lies below them in their shard.

    ``leaves`` and ``saved`` hold a node's own share, and what came from other shards.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = ForwardQueue(most)
        try:
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for k, (conv, depth, parent, root, root_depth, leaves, saved) in enumerate(zip(*columns)):
                    n, s = queue.take(depth, conv)
                    leaves, saved = leaves + n, saved + s
                    columns[5][k], columns[6][k] = leaves, saved
                    if depth != root_depth:
                        queue.send(depth - 1, parent, leaves, saved)
                out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=batch.schema.names)
                if roots_only:
                    out = out.filter(pa.array([d == r for d, r in zip(columns[1], columns[4])], pa.bool_()))
                yield out
        finally:
            queue.close()

    names = [c.split()[0] for c in _NODE.split(", ")]
    shards = nodes.select(*names).repartition("root_conv", "root_depth")
    return shards.sortWithinPartitions(F.desc("depth"), "conv_id").mapInArrow(run, _NODE)


def subtree_totals(nodes: DataFrame, most: int = QUEUE) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of ``nodes`` (``_NODE``): sums over whole subtrees."""
    nodes = materialise(nodes, "trie-shares")
    roots = materialise(within_shards(nodes, True, most).select("conv_id", "depth", "parent_conv_id", "leaves", "saved"),
                        "trie-roots")
    # the shard that a root's parent lies in, and how many cuts lie above it
    up = nodes.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), "root_conv", "root_depth")
    fan = roots.where("depth > 0").groupBy("parent_conv_id", "depth").agg(F.count(F.lit(1)).alias("_n"))
    up = materialise(up.join(fan, ["parent_conv_id", "depth"]), "trie-root-parents")
    below = materialise(salted_join(roots.where("depth > 0"), up, ["parent_conv_id", "depth"], [F.col("conv_id")], "_n",
                                    roots.count()).drop("_n"), "trie-root-edges")
    done, levels = None, []
    level, n_roots = roots.where("depth = 0").select("conv_id", "depth"), roots.count()
    while True:  # ranks of shard roots from the top: those whose parent's shard is of the rank above
        levels.append(level)
        hit = level.select(F.col("conv_id").alias("root_conv"), F.col("depth").alias("root_depth"))
        fan = below.groupBy("root_conv", "root_depth").agg(F.count(F.lit(1)).alias("_n")).join(hit, ["root_conv", "root_depth"])
        fan = materialise(fan, "trie-fan")
        if fan.isEmpty():
            break
        level = materialise(salted_join(below, fan, ["root_conv", "root_depth"], [F.col("conv_id")], "_n", n_roots)
                            .drop("_n"), "trie-rank")
    above = None
    for level in reversed(levels[1:]):  # from the deepest rank: a root's totals go to its parent's shard
        if above is not None:
            sums = above.groupBy(F.col("root_conv").alias("conv_id"), F.col("root_depth").alias("depth")).agg(
                F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
            level = (level.join(sums, ["conv_id", "depth"], "left")
                     .withColumn("leaves", F.col("leaves") + F.coalesce("_leaves", F.lit(0)))
                     .withColumn("saved", F.col("saved") + F.coalesce("_saved", F.lit(0))).drop("_leaves", "_saved"))
        above = materialise(level, "trie-rank-totals")
        done = above if done is None else done.unionByName(above)
    if done is not None:
        sent = done.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
            F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        nodes = (nodes.join(sent, ["conv_id", "depth"], "left")
                 .withColumn("leaves", F.col("leaves") + F.coalesce("_leaves", F.lit(0)))
                 .withColumn("saved", F.col("saved") + F.coalesce("_saved", F.lit(0))))
    return within_shards(nodes, False, most).select(
        "conv_id", "depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def end_digests(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, depth, ends_sha256): SHA-256 over the ascending members (decimal, comma-joined) of each node.

    A digest is one stream by definition; the stream of a node holds strings of about ``chunk`` characters.
    """
    order = ["conv_id", "depth", "member"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size, out = None, 0, [], 0, []
        for batch in batches:
            for conv, depth, member in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (conv, depth) or size >= chunk:
                    if key is not None:
                        out.append((*key, first, ",".join(ids)))
                    key, first, ids, size = (conv, depth), member, [], 0
                ids.append(str(member))
                size += len(ids[-1]) + 1
            if len(out) >= 1_000:
                yield _batch(out, ["conv_id", "depth", "first", "ids"])
                out = []
        if key is not None:
            out.append((*key, first, ",".join(ids)))
        if out:
            yield _batch(out, ["conv_id", "depth", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for conv, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (conv, depth):
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield _batch(out, ["conv_id", "depth", "ends_sha256"])
        if key is not None:
            yield _batch([(*key, state.hexdigest())], ["conv_id", "depth", "ends_sha256"])

    joined = (ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
              .mapInArrow(pieces, "conv_id long, depth long, first long, ids string"))
    return (joined.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
            .mapInArrow(digests, "conv_id long, depth long, ends_sha256 string"))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


def trie_report(rows: DataFrame, family: int = 5, band: int = BAND, width: int = WIDTH, most: int = QUEUE) -> DataFrame:
    """One row per trie node of the rebuilt conversations: its members, children, subtree totals and ends."""
    turns, convs = rebuilt_turns(rows, family)
    nodes, ends = trie_nodes(prefix_rows(turns, band), convs, band, width)
    nodes = materialise(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(nodes.join(children, ["conv_id", "depth"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    totals = subtree_totals(nodes.select(
        "conv_id", "depth", "parent_conv_id", "root_conv", "root_depth",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")), most)
    return (nodes.join(totals, ["conv_id", "depth"]).join(end_digests(ends), ["conv_id", "depth"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))


cloudpickle.register_pickle_by_value(sys.modules[__name__])

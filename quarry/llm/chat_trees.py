"""Reply trees to training conversations: paths by iterative self-joins, branches ranked by score.

A node is a message with a parent. Every node learns its depth and path score by pointer
doubling: in each round a node's pointer jumps to its pointer's pointer, so a thread of
depth d needs about log2(d) self-joins. Leaves are ranked inside their tree by path score,
then depth, then node id; the chosen leaves walk back to the root with the stored jumps,
which yields exactly the messages of their paths. Only ids and scores take part; texts join
once, on the chosen paths.

The template marks turns and keeps texts reversible: inside roles and texts the control
strings cannot occur after escaping.

Defined cases: null role or text counts as empty; a node whose parent is unknown is a root;
several nodes may share a parent (branches); repeated rows of one (tree, node) count once,
the least (role, text) staying; null tree ids form one tree of their own; parents that form a
cycle raise ValueError. Linear conversations: every row is a message, repeated rows too; messages
of equal turn are ordered by role, then text; rows of null turn come before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.skew import materialise

TURN_OPEN, TURN_CLOSE = "### ", "</turn>\n"


def escape(text: Column) -> Column:
    """Reversible: afterwards neither control string occurs, and every backslash starts a pair."""
    out = F.replace(text, F.lit("\\"), F.lit("\\s"))
    out = F.replace(out, F.lit("##"), F.lit("\\h#"))
    return F.replace(out, F.lit("</turn>"), F.lit("\\l/turn>"))


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\l"), F.lit("<"))
    out = F.replace(out, F.lit("\\h"), F.lit("#"))
    out = F.replace(out, F.lit("\\n"), F.lit("\n"))
    return F.replace(out, F.lit("\\s"), F.lit("\\"))


def linear_nodes(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """Rows by (turn, role, text) as a tree: each message answers the one before it. Nodes count from 1."""
    w = Window.partitionBy("tree").orderBy("turn", "role", "text")
    return (rows.select(rows[conv].alias("tree"), rows[turn].cast("long").alias("turn"),
                        F.coalesce(rows[role], F.lit("")).alias("role"), F.coalesce(rows[text], F.lit("")).alias("text"))
            .withColumn("node", F.row_number().over(w).cast("long"))
            .select("tree", "node", "role", "text", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
                    F.lit(0.0).alias("score")))


def _pointers(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, depth, total) and the jump tables: level k points 2**k messages up."""
    nodes = nodes.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    known = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("up"))
    first = (nodes.join(known, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("up")), "left")
             .select("tree", "node", "up", F.lit(1).cast("long").alias("depth"),
                     F.coalesce("score", F.lit(0.0)).alias("total")))
    state = materialise(first, "chat-pointers")
    done, jumps = None, []
    for _ in range(62):
        open_ = state.where(F.col("up").isNotNull())
        closed = state.where(F.col("up").isNull()).select("tree", "node", "depth", "total")
        done = closed if done is None else done.unionByName(closed)
        if open_.isEmpty():
            return done, jumps
        jumps.append(open_.select("tree", "node", "up"))
        far = done.withColumn("up", F.lit(None).cast("long")).unionByName(open_).select(
            F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"),
            F.col("depth").alias("_depth"), F.col("total").alias("_total"))
        state = materialise(
            open_.join(far, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("up") == F.col("_n")))
            .select("tree", "node", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"),
                    (F.col("total") + F.col("_total")).alias("total")), "chat-pointers")
    raise ValueError("the parents form a cycle")


def chosen_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(tree, path, node, depth): the messages of the ``top`` best root-to-leaf paths of each tree.

    ``nodes``: tree, node, parent, score. ``path`` is the rank of the leaf, from 1.
    """
    depths, jumps = _pointers(nodes)
    parents = nodes.where("parent is not null").select(F.col("tree").alias("_t"), F.col("parent").alias("_p")).distinct()
    leaves = depths.join(parents, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_p")), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), F.asc("node"))
    walk = (leaves.withColumn("path", F.row_number().over(order)).where(F.col("path") <= top)
            .select("tree", "path", "node", "depth"))
    for k, jump in enumerate(jumps):
        j = jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "up")
        above = (walk.join(j, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
                 .select("tree", "path", F.col("up").alias("node"), (F.col("depth") - F.lit(2 ** k)).alias("depth")))
        walk = materialise(walk.unionByName(above), "chat-walk")
    return walk


def format_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, path, formatted, loss): one templated conversation per path.

    ``loss`` holds the [start, end) code-point ranges of the assistants' texts in ``formatted``.
    """
    said = (nodes.groupBy(F.col("tree").alias("_t"), F.col("node").alias("_n"))
            .agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text"))).alias("said")))
    turns = (paths.join(said, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
             .select("tree", "path", "depth",
                     F.concat(F.lit(TURN_OPEN), F.replace(escape(F.col("said.role")), F.lit("\n"), F.lit("\\n")),
                              F.lit("\n")).alias("head"),
                     escape(F.col("said.text")).alias("body"),
                     (F.col("said.role") == "assistant").alias("learn")))
    seq = F.array_sort(F.collect_list(F.struct("depth", "head", "body", "learn")))
    whole = turns.groupBy("tree", "path").agg(seq.alias("turns"))
    lengths = F.transform("turns", lambda x: F.struct(
        F.length(x["head"]).alias("head"), F.length(x["body"]).alias("body"), x["learn"].alias("learn")))
    ranges = F.aggregate(
        lengths, F.struct(F.lit(0).cast("long").alias("pos"),
                          F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["pos"] + x["head"] + x["body"] + F.lit(len(TURN_CLOSE))).cast("long").alias("pos"),
            F.when(x["learn"], F.concat(acc["out"], F.array(F.struct(
                (acc["pos"] + x["head"]).cast("long").alias("start"),
                (acc["pos"] + x["head"] + x["body"]).cast("long").alias("end"))))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])
    text = F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(TURN_CLOSE))), "")
    return whole.select("tree", "path", text.alias("formatted"), ranges.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>, unescaped."""
    pieces = F.split(formatted, r"\Q" + TURN_CLOSE + r"\E", -1)
    full = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(full, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(TURN_OPEN) + 1, 2 ** 31 - 1), "\n", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text")))


def conversation_report(formatted: DataFrame) -> DataFrame:
    """Digests read back from formatted conversations (tree, formatted, loss)."""
    turns = read_turns(F.col("formatted"))
    learned = F.array_join(F.transform("loss", lambda r: unescape(
        F.substr(F.col("formatted"), (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")))), "")
    return (formatted.withColumn("_turns", turns).withColumn("_loss", learned)
            .select(F.col("tree").alias("conv_id"), F.size("_turns").cast("long").alias("n_turns"),
                    F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(
                        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
                    F.length("_loss").cast("long").alias("loss_chars"),
                    F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))

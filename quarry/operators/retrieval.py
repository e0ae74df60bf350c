"""Retrieval: vectors by cells with exact answers, and passages by an inverted index of field terms.

Vectors (D33). Every vector is filed under the nearest of a bounded number of centres, fitted
on a bounded sample. A query first searches the cells nearest to it. Its k-th best distance
then rules cells out: by the triangle inequality nothing in a cell is nearer than the distance
to its centre less the cell's radius. The cells left over are searched as well, so the answer
is that of comparing with every row. Queries and vectors meet in blocks of bounded size, each
one matrix product, so neither a crowded cell nor a popular one is gathered.

Passages (D37). Postings (term, document, chunk, count) hold the words of the fields that occur
in a document's chunks; a field group takes the chunks that hold most of its terms.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.skew import materialise, salted_join
from quarry.operators.chunking import overlapping_chunks
from quarry.operators.prompts import with_value

SAMPLE, CELLS, PROBES = 10_000, 64, 4
BLOCK = 4_096  # vectors or queries of a cell that meet at a time
DIGITS = 12  # scores are rounded, so that equal vectors tie wherever they are computed


# ------------------------------------------------------------------ vectors

def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column at unit length (a zero vector stays zero)."""
    if not len(column):
        return np.empty((0, 0))
    rows = np.stack([np.asarray(v, "f8") for v in column.to_pylist()])
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chord lengths between rows of unit length."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def fit_centres(vectors: DataFrame, id_col: str, vec: str, cells: int = CELLS, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Centres of at most ``cells`` cells, by k-means on the ``sample`` vectors of least id hash."""
    some = (vectors.where(F.col(vec).isNotNull()).select(id_col, vec).orderBy(F.xxhash64(id_col), id_col).limit(sample)
            .select(vec).toArrow().column(vec))
    points = _matrix(some)
    if not len(points):
        return points
    rng = np.random.default_rng(1)
    centres = points[rng.permutation(len(points))[:cells]]
    for _ in range(rounds):
        near = _distance(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """Filed vectors: rows (id, vec, cell, block) and cells (cell, blocks, radius)."""

    centres: np.ndarray
    rows: DataFrame
    cells: DataFrame


def build_index(vectors: DataFrame, id_col: str, vec: str, cells: int = CELLS, sample: int = SAMPLE) -> VectorIndex:
    """File every vector under its nearest centre. Rows without a vector or id are left out."""
    centres = fit_centres(vectors, id_col, vec, cells, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = _distance(_matrix(batch.column("vec")), centres)
            near = apart.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near, pa.int64()), pa.array(apart[np.arange(len(near)), near], pa.float64())],
                names=["id", "vec", "cell", "apart"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where(
        "id is not null and vec is not null")
    filed = materialise(rows.mapInArrow(run, "id long, vec array<double>, cell long, apart double"), "vector-cells")
    # at most as many rows as centres
    sizes = filed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.max("apart").alias("radius"))
    sizes = materialise(sizes, "vector-cell-sizes")
    placed = filed.join(F.broadcast(sizes.select("cell", "blocks")), "cell").select(
        "id", "vec", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    return VectorIndex(centres, materialise(placed, "vector-index"), sizes)


def query_cells(queries: DataFrame, index: VectorIndex) -> DataFrame:
    """(query, cell, place, least): every query's cells by nearness; nothing in a cell is nearer than ``least``."""
    centres = index.centres
    radius = np.full(len(centres), -1.0)
    for r in index.cells.select("cell", "radius").collect():  # one row per centre
        radius[r["cell"]] = r["radius"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = np.flatnonzero(radius >= 0)
        for batch in batches:
            if not batch.num_rows or not len(live):
                continue
            apart = _distance(_matrix(batch.column("vec")), centres[live])
            order = apart.argsort(axis=1, kind="stable")
            n, c = apart.shape
            sorted_apart = np.take_along_axis(apart, order, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("query").to_numpy(), c)), pa.array(live[order].ravel(), pa.int64()),
                 pa.array(np.tile(np.arange(c), n), pa.int64()),
                 pa.array(np.maximum(sorted_apart - radius[live][order], 0).ravel(), pa.float64())],
                names=["query", "cell", "place", "least"])

    return queries.select("query", "vec").mapInArrow(run, "query long, cell long, place long, least double")


def _meet(queries: DataFrame, pairs: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """(query, id, score): the best k of each block for the (query, cell) ``pairs``; a row is not its own answer."""
    sizes = F.broadcast(index.cells.select("cell", "blocks"))
    per_cell = pairs.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("asked"))
    asking = (pairs.join(queries, "query").join(F.broadcast(per_cell), "cell").join(sizes, "cell")
              .withColumn("turn", F.pmod(F.xxhash64("query"), F.col("asked")).cast("int"))
              .select("query", "vec", "cell", "turn", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    asked = index.rows.join(F.broadcast(per_cell), "cell").select(
        "id", "vec", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("turn"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        qid, ids = left.column("query").to_numpy(), right.column("id").to_numpy()
        if not len(qid) or not len(ids):
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        score = np.round(_matrix(left.column("vec")) @ _matrix(right.column("vec")).T, DIGITS)
        score[qid[:, None] == ids[None, :]] = -np.inf
        by_id = ids.argsort(kind="stable")
        order = by_id[(-score[:, by_id]).argsort(axis=1, kind="stable")[:, :k]]
        top = np.take_along_axis(score, order, axis=1)
        real = np.isfinite(top)
        return pa.table({"query": np.repeat(qid, order.shape[1])[real.ravel()], "id": ids[order][real], "score": top[real]})

    keys = ["cell", "block", "turn"]
    return asking.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(best, "query long, id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(queries: DataFrame, index: VectorIndex, k: int = 5, probes: int = PROBES, exact: bool = True) -> DataFrame:
    """(query, id, score, rank): the ``k`` rows of the index most like each query (cosine; ties by id).

    ``queries``: query (distinct, whole numbers), vec. With ``exact`` the cells that may still
    hold a better row are searched too; without it only the ``probes`` nearest cells.
    """
    queries = materialise(queries.select(F.col("query").cast("long").alias("query"), F.col("vec").cast("array<double>").alias("vec"))
                          .where("query is not null and vec is not null"), "vector-queries")
    cells = materialise(query_cells(queries, index), "query-cells")
    first = materialise(_meet(queries, cells.where(F.col("place") < probes), index, k), "query-first")
    if not exact:
        return _top(first, k)
    worst = _top(first, k).groupBy("query").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_worst"))
    bound = F.when(F.col("_n") >= k, F.sqrt(F.greatest(F.lit(2.0) - 2 * F.col("_worst"), F.lit(0.0)))).otherwise(F.lit(3.0))
    open_ = (cells.where(F.col("place") >= probes).join(worst, "query", "left")
             .where(F.coalesce(F.col("least") <= bound + 1e-6, F.lit(True))).select("query", "cell"))
    more = _meet(queries, materialise(open_, "query-open"), index, k)
    return _top(first.unionByName(more), k)


# ----------------------------------------------------------------- passages

def words(text: Column) -> Column:
    """Lower-case runs of letters a-z and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def field_groups(fields: DataFrame, indicators: Sequence[str], size: int = 2, descriptions: Mapping[str, str] | None = None) -> DataFrame:
    """(field_group, kind, names, terms): flat fields and indicators in groups of ``size``, with the words that name them.

    ``fields``: rank, field. ``descriptions`` adds a name's words. As many rows as the schema is wide.
    """
    spark, said = fields.sparkSession, dict(descriptions or {})
    listed = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in sorted(indicators)]).cast("array<string>")).alias("pos", "name"))
    both = fields.select(F.lit("fields").alias("kind"), (F.col("rank") - 1).alias("pos"), F.col("field").alias("name")).unionByName(
        listed.select(F.lit("indicators").alias("kind"), F.col("pos").cast("bigint").alias("pos"), "name"))
    pairs = [F.lit(x) for pair in said.items() for x in pair]
    extra = F.create_map(*pairs)[F.col("name")] if pairs else F.lit(None).cast("string")
    each = both.withColumn("_terms", words(F.concat_ws(" ", "name", extra)))
    grouped = each.groupBy("kind", F.floor(F.col("pos") / size).alias("_g")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("_names"), F.flatten(F.collect_list("_terms")).alias("_terms"))
    return grouped.select(F.concat_ws("-", "kind", (F.col("_g") + 1).cast("string")).alias("field_group"), "kind",
                          F.transform("_names", lambda x: x["name"]).alias("names"),
                          F.array_sort(F.array_distinct("_terms")).alias("terms"))


def term_postings(chunks: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """(term, key, chunk_idx, tf): where the groups' terms occur. ``chunks``: key, chunk_idx, chunk.

    Each word is looked up once in the hashed vocabulary, which is as long as the schema is
    wide, so the work on a word does not grow with the number of terms.
    """
    vocabulary = groups.select(F.explode("terms").alias("term")).distinct()
    said = chunks.select(key, "chunk_idx", F.explode(words(F.col("chunk"))).alias("term"))
    return (said.join(F.broadcast(vocabulary), "term", "left_semi")
            .groupBy("term", key, "chunk_idx").agg(F.count(F.lit(1)).alias("tf")))


def best_chunks(postings: DataFrame, groups: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, field_group, chunk_idx): for each group the chunks with most of its terms, then most mentions, then the earliest.

    A term that very many chunks hold meets its groups over salts.
    """
    of_term = groups.select("field_group", F.explode("terms").alias("term")).groupBy("term").agg(
        F.collect_list("field_group").alias("_groups"))
    often = postings.groupBy("term").agg(F.count(F.lit(1)).alias("_n"))
    total = often.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    met = salted_join(postings, of_term.join(often, "term"), ["term"], [F.col(key), F.col("chunk_idx")], "_n", total)
    score = (met.select(key, "chunk_idx", "tf", "term", F.explode("_groups").alias("field_group"))
             .groupBy(key, "field_group", "chunk_idx").agg(F.count(F.lit(1)).alias("_terms"), F.sum("tf").alias("_tf")))
    w = Window.partitionBy(key, "field_group").orderBy(F.desc("_terms"), F.desc("_tf"), "chunk_idx")
    return score.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most).select(key, "field_group", "chunk_idx")


def group_passages(docs: DataFrame, groups: DataFrame, key: str, text: str, most: int = 3, size: int = 1000,
                   overlap: int = 150) -> DataFrame:
    """(key, field_group, kind, names, n_chunks, passages): every document and group, with its chunks in text order.

    Texts move as chunks, and only the chosen ones; a group none of whose terms occur has none.
    """
    groups = materialise(groups, "field-groups")
    chunks = materialise(overlapping_chunks(docs.select(key, text), text, size, overlap).select(key, "chunk_idx", "chunk"), "group-chunks")
    postings = materialise(term_postings(chunks, groups, key), "term-postings")
    chosen = best_chunks(postings, groups, key, most)
    shown = chosen.join(chunks, [key, "chunk_idx"]).groupBy(key, "field_group").agg(
        F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk"))).alias("_chunks"))
    every = with_value(docs.select(key), groups.agg(F.collect_list(F.struct("field_group", "kind", "names")).alias("_groups")), key)
    each = every.select(key, F.inline("_groups"))
    return each.join(shown, [key, "field_group"], "left").select(
        key, "field_group", "kind", "names", F.coalesce(F.size("_chunks"), F.lit(0)).cast("bigint").alias("n_chunks"),
        F.coalesce(F.array_join(F.transform("_chunks", lambda c: c["chunk"]), "\n...\n"), F.lit("")).alias("passages"))


# Runs inside Python workers: ship this module's code by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

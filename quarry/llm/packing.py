"""Packing documents into fixed-length sequences by cutting-stock column generation.

A document's ids are cut into full-length pieces and one rest. Rest lengths, rounded up to
``grain``, form a histogram. A linear program over cutting patterns (how many pieces of each
length share a sequence) minimises the number of sequences; its columns are priced by an
unbounded-knapsack dynamic program on the duals, and pattern counts are rounded down, the
leftover pieces filled largest first. Pieces are ranked inside their length class by document
id, and runs of ranks are assigned to the slots of the patterns.

Only the histogram (at most ``capacity / grain`` lengths) reaches the driver, and only the
runs (at most slots per pattern times patterns, whatever the number of documents) go back.
Ranks inside a class are counted per (class, hash bucket), so a class that most documents
share is ranked in parts.

Defined cases: null text counts as empty (an end id, if asked for, is its only piece; without
one it has none); null ids sort first; repeated rows are packed like any other; an empty
table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import token_ids
from quarry.llm.skew import materialise, text_batches


@dataclass(frozen=True)
class Runs:
    """Ranks [first, first + count) of a length class sit in ``slot`` of sequences from ``base`` on."""
    size: np.ndarray
    first: np.ndarray
    base: np.ndarray
    slot: np.ndarray


def best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of ``sizes`` that fits ``capacity`` (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for room in range(int(sizes[0]), capacity + 1):  # sizes ascend
        fit = int(np.searchsorted(sizes, room, "right"))
        gain = best[room - sizes[:fit]] + value[:fit]
        k = int(gain.argmax())
        if gain[k] > best[room - 1]:
            best[room], pick[room] = gain[k], k
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
            continue
        pattern[pick[room]] += 1
        room -= int(sizes[pick[room]])
    return float(best[capacity]), pattern


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3,
                   rounds: int = 20_000, stall: int = 200) -> list[tuple[np.ndarray, float]]:
    """(pattern, fractional count) of the cutting-stock linear program, by column generation.

    Revised simplex: the basis holds one pattern per size, starting with sequences of one
    size each. It ends when no pattern prices above 1, or within ``gap`` (or half a sequence)
    of the material bound, the summed lengths over the capacity, or after ``stall`` rounds
    without gain (small histograms are degenerate); what it has is then still feasible.
    """
    m = len(sizes)
    least = float(sizes @ demand) / capacity
    patterns = np.diag((capacity // sizes).astype(float))  # columns
    inverse = np.diag(1.0 / np.diag(patterns))
    count = inverse @ demand
    record, since = np.inf, 0
    for k in range(rounds):
        price, column = best_pattern(sizes, inverse.sum(axis=0), capacity)
        total = count.sum()
        record, since = (total, 0) if total < record * (1 - 1e-6) else (record, since + 1)
        if since > stall:
            break
        if price <= 1 + 1e-9 or total <= least + max(0.5, gap * least):
            break
        step = inverse @ column
        ratio = np.full(m, np.inf)
        up = step > 1e-9
        ratio[up] = np.maximum(count[up], 0) / step[up]
        out = int(ratio.argmin())
        count = count - ratio[out] * step
        count[out] = ratio[out]
        patterns[:, out] = column
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        if k % 500 == 499:  # keep rounding errors from adding up
            inverse = np.linalg.inv(patterns)
            count = inverse @ demand
    return [(patterns[:, j], float(count[j])) for j in range(m)]


def plan_sequences(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, whole count): every piece of the histogram placed exactly once."""
    left = demand.astype("int64").copy()
    plan: list[tuple[np.ndarray, int]] = []
    for pattern, share in solve_patterns(sizes, demand.astype(float), capacity):
        pattern = pattern.astype("int64")
        used = pattern > 0
        n = int(min(np.floor(share + 1e-6), (left[used] // pattern[used]).min()))
        if n > 0:
            plan.append((pattern, n))
            left -= n * pattern
    while left.any():
        pattern, room = np.zeros(len(sizes), "int64"), capacity
        for k in np.flatnonzero(left)[::-1]:  # largest first
            pattern[k] = min(left[k], room // sizes[k])
            room -= pattern[k] * sizes[k]
        used = pattern > 0
        n = int((left[used] // pattern[used]).min())
        plan.append((pattern, n))
        left -= n * pattern
    return plan


def plan_runs(histogram: dict[int, int], capacity: int, grain: int) -> Runs:
    """Runs for a histogram {rounded length: pieces}."""
    sizes = np.array(sorted(histogram), "int64")
    demand = np.array([histogram[s] for s in sizes], "int64")
    rows, next_rank, base = [], dict.fromkeys(sizes.tolist(), 0), 0
    whole = sizes >= capacity - capacity % grain  # such a piece fills a sequence
    for s, d in zip(sizes[whole].tolist(), demand[whole].tolist()):
        rows.append((s, 0, base, 0))
        base += d
    if (~whole).any():
        part = sizes[~whole]
        for pattern, n in plan_sequences(part // grain, demand[~whole], capacity // grain):
            slot = 0
            for k in np.flatnonzero(pattern)[::-1]:
                s = int(part[k])
                for _ in range(int(pattern[k])):
                    rows.append((s, next_rank[s], base, slot))
                    next_rank[s] += n
                    slot += 1
            base += n
    cols = np.array(sorted(rows), "int64").reshape(-1, 4)
    return Runs(*(np.ascontiguousarray(cols[:, k]) for k in range(4)))


def piece_rows(docs: DataFrame, path: str, capacity: int, end_id: int | None, id_col: str = "doc_id",
               text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): full pieces, then the rest."""
    rows = text_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = token_ids.encoder(path)
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text"))):
                ids += tail
                for at in range(0, len(ids), 4 * capacity):
                    piece = ids[at:at + 4 * capacity]
                    out.append((doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece))
                    held += len(piece) if with_ids else 64
                if held >= 8 << 20:
                    yield _pieces(out, with_ids)
                    out, held = [], 0
            if out:
                yield _pieces(out, with_ids)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return rows.mapInArrow(run, schema + ", ids array<int>" * with_ids)


def _pieces(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
    if with_ids:
        cols.append(pa.array([np.frombuffer(r[5], "<u4").astype("int32") for r in rows], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(cols, names=names)


def place_pieces(pieces: DataFrame, capacity: int, grain: int = 8, bucket_rows: int = 100_000) -> DataFrame:
    """``pieces`` with sequence_id and offset; every sequence is gapless from 0.

    ``pieces`` is a written table (it is read three times).
    """
    size = (F.ceil(F.col("length") / F.lit(grain)) * F.lit(grain)).cast("long")
    n = pieces.count()
    buckets = max(16, -(-n // bucket_rows))
    dealt = (pieces.withColumn("_size", size)
             .withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int")))
    counts = materialise(dealt.groupBy("_size", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "pack-counts")
    histogram = {r["_size"]: r["n"] for r in counts.groupBy("_size").agg(F.sum("_n").alias("n")).collect()}
    if not histogram:
        return pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    runs = plan_runs(histogram, capacity, grain)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_size").orderBy("_bucket")
                                         .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_size", "_bucket", before.alias("_before"))
    order = Window.partitionBy("_size", "_bucket").orderBy(F.asc_nulls_first("doc_id"), "start", "ids_crc32", "length")
    ranked = (dealt.withColumn("_local", F.row_number().over(order) - 1).join(offsets, ["_size", "_bucket"])
              .withColumn("_rank", F.col("_before") + F.col("_local")).drop("_before", "_local", "_bucket"))
    names = [f for f in ranked.columns if f not in ("_size", "_rank")]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.int64(max(int(runs.first.max()), 1) + 1)
        keys = runs.size * scale + runs.first
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_size", "_rank"))
            at = np.searchsorted(keys, length * scale + np.minimum(rank, scale - 1), "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(runs.base[at] + rank - runs.first[at]), pa.array(runs.slot[at])],
                names=[*names, "sequence_id", "_slot"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    placed = ranked.mapInArrow(assign, f"{fields}, sequence_id long, _slot long")
    inside = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).drop("_slot")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int | None = 2, grain: int = 8,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]."""
    pieces = materialise(piece_rows(docs, path, capacity, end_id, id_col, text_col, with_ids), "pack-pieces")
    return place_pieces(pieces, capacity, grain)


def sequences(placed: DataFrame, capacity: int = 4096, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, used): whole sequences from pieces with ids, padded unless a power of two long."""
    whole = (placed.groupBy("sequence_id")
             .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"), F.sum("length").alias("used")))
    ids = F.flatten(F.transform("_parts", lambda p: p["ids"]))
    power = F.bit_count("used") == 1
    pad = F.when(power, 0).otherwise(F.lit(capacity) - F.col("used")).cast("int")
    return whole.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id), pad)).alias("ids"), "used")


cloudpickle.register_pickle_by_value(sys.modules[__name__])

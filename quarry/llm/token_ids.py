"""Token ids: whole texts through a public tokenizer, and a Parquet layout for the ids.

The tokenizer in use drops white space and never joins characters across it, so a text's ids
are the ids of its space-separated pieces in order. Pieces repeat, so a worker asks the
library for each distinct piece once and keeps the answer in a bounded table; once the table is full,
further pieces are encoded when they come, with the same result. ``tests/llm`` compares this
with encoding whole texts.

The file layout is Parquet: one row per document, ids in an integer list column, rows in
ascending id order over range-partitioned files. The writer keeps dictionary encoding for
ids, falls back to delta encoding (format version 2), and holds row groups and pages to
fixed sizes with page indexes, so a reader can fetch the metadata columns alone, or the
pages of one document.

Defined cases: null text counts as empty (an end id, if one is asked for, still follows); null
document ids sort first; repeated rows are documents of their own; an empty table writes no rows.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.pieces import objects, split_column
from quarry.llm.skew import materialise, text_batches, worker_cache

KNOWN_PIECES = 200_000  # pieces kept per worker; others are encoded when they come
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII, without the apostrophe


def _lowered(texts: pa.Array) -> pa.Array:
    """The vocabulary is lower-case: ASCII letters are lowered already here, unless the text
    has a combining mark, which could compose with one before the tokenizer lowers it."""
    return pc.if_else(pc.match_substring_regex(texts, "[\u0300-\u036f]"), texts, pc.ascii_lower(texts))


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, piece by piece."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.last = np.zeros(max(ends, default=0) + 2, bool)  # ids that end a word
        self.last[ends] = True

    def encode(self, column: pa.Array) -> Iterator[bytes]:
        """One bytes object per text of the column (null as empty)."""
        for part in split_column(column, _lowered):
            ids = self._pieces(part.distinct)
            size = np.fromiter(map(len, ids), "i4", len(ids)) // 4
            begin = np.zeros(len(ids) + 1, "i8")
            np.cumsum(size, out=begin[1:])
            flat = np.frombuffer(b"".join(ids), "<u4")
            n = size[part.codes]  # ids of each piece in the text
            upto = np.zeros(len(n) + 1, "i8")
            np.cumsum(n, out=upto[1:])
            at = np.repeat(begin[part.codes] - upto[:-1], n)
            at += np.arange(len(at))
            every, ends = flat[at], upto[part.ends]
            for k in range(part.rows):
                yield every[ends[k]:ends[k + 1]].tobytes()

    def _pieces(self, distinct: pa.Array) -> list[bytes]:
        """Ids of distinct pieces. Marks that follow a run of letters are a token run of their own."""
        core = pc.utf8_rtrim(distinct, _MARKS)
        length = pc.binary_length(core)
        marked = pc.and_(pc.utf8_is_alpha(core), pc.less(length, pc.binary_length(distinct)))
        coded = pc.if_else(marked, core, distinct).dictionary_encode()
        ids = self._look_up(coded.dictionary)
        out = [ids[k] for k in coded.indices.to_numpy(zero_copy_only=False).tolist()]
        at = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        whole = objects(distinct.take(pa.array(at)).cast(pa.binary()))
        tails = [p[n:] for p, n in zip(whole, length.to_numpy(zero_copy_only=False)[at].tolist())]
        kinds = list(set(tails))
        marks = dict(zip(kinds, self._look_up(pa.array([t.decode() for t in kinds], pa.string()))))
        for k, t in zip(at.tolist(), tails):
            out[k] += marks[t]
        return out

    def _look_up(self, pieces: pa.Array) -> list[bytes]:
        keys = objects(pieces.cast(pa.binary()))
        got = list(map(self.known.get, keys))
        missing = np.array([v is None for v in got], bool)
        if not missing.any():
            return got
        letters = pc.utf8_is_alpha(pieces).to_numpy(zero_copy_only=False)
        for where, encode in ((missing & letters, self._words), (missing & ~letters, self._one_by_one)):
            at = np.flatnonzero(where)
            for k, x in zip(at.tolist(), encode(objects(pieces.take(pa.array(at))))):
                got[k] = x
        if len(self.known) + int(missing.sum()) <= KNOWN_PIECES:
            self.known.update((keys[k], got[k]) for k in np.flatnonzero(missing).tolist())
        return got

    def _one_by_one(self, pieces: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _words(self, words: list[str], step: int = 200) -> list[bytes]:
        """Ids of pieces of letters only, many per call: each is one word, which ends at an id of ``last``."""
        out: list[bytes] = []
        groups = [words[k:k + step] for k in range(0, len(words), step)]
        encoded = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, encoded):
            ids = np.asarray(e.ids, "<u4")
            ends = np.flatnonzero(self.last[np.minimum(ids, len(self.last) - 1)]) + 1
            if len(ends) == len(group):
                data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                out += [data[a:b] for a, b in zip(cuts, cuts[1:])]
            else:  # some letter is no single word to the tokenizer
                out += self._one_by_one(group)
        return out


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary file."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoders = worker_cache("tokens_encoders", dict)
    if path not in encoders:
        encoders[path] = PieceEncoder(path)
    return encoders[path]


def token_rows(docs: DataFrame, path: str, end_id: int | None, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, n_tokens, ids_crc32) per document, the end id included."""
    rows = text_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part, data in _encoded(batch, enc, tail):
                offsets = np.zeros(len(data) + 1, "int32")
                np.cumsum([len(d) // 4 for d in data], out=offsets[1:])
                flat = np.frombuffer(b"".join(data), "<u4").astype("int32")
                yield pa.RecordBatch.from_arrays([
                    part, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array(np.diff(offsets).astype("int64")),
                    pa.array([zlib.crc32(d) for d in data], pa.int64())],
                    names=["doc_id", "ids", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long")


def _encoded(batch: pa.RecordBatch, enc: PieceEncoder, tail: bytes,
             limit: int = 16 << 20) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(ids column, id bytes) of a batch in parts of about ``limit`` bytes."""
    first, size, data = 0, 0, []
    for k, ids in enumerate(enc.encode(batch.column("text"))):
        data.append(ids + tail)
        size += len(ids)
        if size >= limit:
            yield batch.column("doc_id").slice(first, len(data)), data
            first, size, data = k + 1, 0, []
    if data:
        yield batch.column("doc_id").slice(first, len(data)), data


def write_token_files(docs: DataFrame, out: str, path: str, end_id: int | None, id_col: str = "doc_id",
                      text_col: str = "text", files: int | None = None, row_group_mb: int = 64,
                      page_kb: int = 256) -> None:
    """Write the documents' ids to ``out`` in ascending id order (see the module text).

    Texts, not ids, are dealt to the range partitions, and each file is tokenized where it is written.
    """
    spark = docs.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(docs[id_col].cast("long").alias(id_col), text_col)
               .repartitionByRange(n, F.col(id_col).asc_nulls_first())
               .sortWithinPartitions(F.col(id_col).asc_nulls_first()))
    (token_rows(ordered, path, end_id, id_col, text_col).write
     .option("parquet.block.size", row_group_mb << 20).option("parquet.page.size", page_kb << 10)
     .option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", 1 << 20)
     .option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd")
     .parquet(out))


def read_token_rows(spark, out: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Rows of written token files; only the named columns and matching row groups are read."""
    rows = spark.read.parquet(out)
    rows = rows if where is None else rows.where(where)
    return rows.select(*columns) if columns else rows


def token_index(spark, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from written files; the checksum is taken from the ids read.

    ``start`` counts the ids of all documents before this one: a running sum inside each
    file, plus the totals of the files before it (one row per file).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            ends = lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("row"), batch.column("doc_id"),
                 pa.array(np.diff(ends).astype("int64")), pa.array(crc, pa.int64())],
                names=["file", "row", "doc_id", "n_tokens", "ids_crc32"])

    rows = spark.read.parquet(out).select(F.col("_metadata.file_name").alias("file"),
                                          F.col("_metadata.row_index").alias("row"), "doc_id", "ids")
    read = materialise(rows.mapInArrow(run, "file string, row long, doc_id long, n_tokens long, ids_crc32 long"), "token-index")
    per_file = read.groupBy("file").agg(F.sum("n_tokens").alias("_sum"))
    before = (per_file.withColumn("_before", F.coalesce(F.sum("_sum").over(
        Window.orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum"))
    order = Window.partitionBy("file").orderBy("row")
    inside = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (read.withColumn("_inside", inside).join(before, "file")
            .select("doc_id", (F.col("_before") + F.col("_inside")).cast("long").alias("start"), "n_tokens", "ids_crc32"))


# Task code travels by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

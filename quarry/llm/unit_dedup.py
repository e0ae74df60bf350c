"""Substring deduplication by hashing lines (paragraphs) and the sentences inside them.

A text is cut into lines, and a line into sentences, so that a passage pasted into the middle
of a paragraph still gives equal units. A unit is normalised (case, white space) and hashed to
128 bits. Digests are grouped over the whole corpus; the occurrence earliest in rank (document
id, then position) is kept, all later ones are repeats.

* A repeated whole line is removed, however short.
* Repeated sentences inside other lines are removed in runs of at least ``min_chars``
  characters, so that common short sentences stay where they are. A run goes on over lines and
  over whatever lies between units without words: blank lines, line ends, lone marks.

The earliest occurrence always stays: were its line removed as a repeat, that line's own
earliest copy would hold an earlier one. Removed spans are offsets into the original text. A
passage without a sentence end inside is found only where it is a whole line.

Scale: a first pass counts 64 bits of each digest (combined before the shuffle) and turns the
repeated ones into a bitmap of fixed size; a second pass keeps only units in the bitmap, and
only these are grouped and joined. A line that a third of all documents share is one row of
the grouped table and is joined back over salts.

Defined cases: null text counts as empty; null ids rank last; rows that repeat an id and its
text are one occurrence and get the same spans; rows that repeat an id with another text are
told apart by their text's hash; an empty table gives an empty result; other columns are kept,
but for own columns called n_removed, removed_words or spans, which the result's replace.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.skew import key_bitmap, materialise, maybe_in, salted_join, text_batches

UNIT = r"[^.!?]+[.!?]*|[.!?]"  # covers every character of a line; units of marks alone have no words
MIN_CHARS = 150  # of a run of repeated sentences inside lines
ADDED = ("n_removed", "removed_words", "spans")
_SCHEMA = "hi long, lo long, doc_id long, copy long, line int, place int, start int, end int, words int, whole int"


def text_units(text: str) -> Iterator[tuple[str, int, int, int, int, int, int]]:
    """(normalised unit, line, place, start, end, words, whole) of a text.

    ``place`` numbers the sentences with words, so that neighbours differ by one; a line of
    several sentences is a further unit of place -1. ``whole`` marks units that fill their line.
    """
    find, at, place = re.compile(UNIT).findall, 0, 0
    for n, line in enumerate(text.split("\n")):
        end, units, begin = at + len(line), [], at
        for unit in find(line):
            words = unit.lower().split()
            if words and (len(words) > 1 or words[0] not in ".!?"):
                units.append((" ".join(words), begin, begin + len(unit), len(words)))
            begin += len(unit)
        if units:
            words = line.lower().split()
            whole = " ".join(words)
            if len(units) == 1 and units[0][0] == whole:
                yield whole, n, place, at, end, len(words), 1
            else:
                yield whole, n, -1, at, end, len(words), 1
                for k, (norm, first, last, size) in enumerate(units):
                    yield norm, n, place + k, first, last, size, 0
            place += len(units)
        at = end + 1


def unit_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per unit with a word: digest (hi, lo), doc_id, copy (text hash), and what ``text_units`` gives."""
    rows = text_batches(docs).select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("copy", F.xxhash64("text"))
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        def flush() -> pa.RecordBatch:
            digest = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            where = np.array(places, "int64").reshape(-1, 6)
            return pa.RecordBatch.from_arrays(
                [pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(ids, pa.int64()), pa.array(copies, pa.int64()),
                 *(pa.array(where[:, k].astype("int32")) for k in range(6))], names=names)

        digests, ids, copies, places = [], [], [], []
        for batch in batches:
            for doc, copy, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "copy", "text"))):
                for norm, *where in text_units(text):
                    digests.append(xxh3_128_digest(norm.encode("utf-8", "surrogatepass")))
                    places.append(where)
                    ids.append(doc)
                    copies.append(copy)
                if len(digests) >= 50_000:
                    yield flush()
                    digests, ids, copies, places = [], [], [], []
        if digests:
            yield flush()

    return rows.mapInArrow(run, _SCHEMA)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, copy, n_removed, removed_words, spans): documents that lose repeated units.

    ``spans`` is the ordered array<struct<start, end>> of removed units, none inside another.
    """
    units = unit_rows(docs, id_col, text_col)
    often = units.groupBy("lo").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    bitmap = materialise(key_bitmap(often, "lo"), "unit-bitmap")
    likely = materialise(maybe_in(units, "lo", bitmap).distinct(), "unit-likely")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start", "copy")
    groups = materialise(likely.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("_n"), F.min(rank).alias("_first"))
                         .where("_n > 1"), "unit-groups")
    total = groups.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    later = (salted_join(likely, groups, ["hi", "lo"], [F.col("doc_id"), F.col("start"), F.col("copy")], "_n", total)
             .where(rank != F.col("_first")).select("doc_id", "copy", "line", "place", "start", "end", "words", "whole"))
    doc = ["doc_id", "copy"]
    runs = Window.partitionBy(*doc).orderBy("place")
    sentence = F.col("place") >= 0
    gap = F.col("place") - F.lag("place").over(runs)  # lines of several sentences come first, as place -1
    numbered = later.withColumn("_new", F.when(~sentence | (F.coalesce(F.when(F.lag("place").over(runs) >= 0, gap), F.lit(9)) > 1), 1)
                                .otherwise(0)).withColumn("_run", F.sum("_new").over(runs.rowsBetween(Window.unboundedPreceding, 0)))
    weighed = (numbered.withColumn("_chars", F.sum(F.col("end") - F.col("start")).over(Window.partitionBy(*doc, "_run")))
               .withColumn("_covered", F.max((~sentence).cast("int")).over(Window.partitionBy(*doc, "line"))))
    gone = ~sentence | ((F.col("_covered") == 0) & ((F.col("whole") == 1) | (F.col("_chars") >= min_chars)))
    return (weighed.where(gone).groupBy(*doc)
            .agg(F.count(F.lit(1)).alias("n_removed"), F.sum("words").alias("removed_words"),
                 F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows of ``docs`` with the repeated units cut out of the text.

    Adds n_removed, removed_words and spans (offsets into the original text). Only documents
    that may lose something are moved; the others are passed through.
    """
    docs = docs.drop(*ADDED)
    spans = materialise(repeated_spans(docs, id_col, text_col, min_chars), "unit-spans")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumn("_copy", F.xxhash64(text))
    hit = spans.select(F.col("doc_id").alias("_doc"), F.col("copy").alias("_copy"),
                       "n_removed", "removed_words", "spans")
    bitmap = materialise(key_bitmap(hit, "_copy"), "unit-docs")
    touched = maybe_in(keyed, "_copy", bitmap)
    same = maybe_in(keyed, "_copy", bitmap, invert=True)
    joined = touched.withColumnRenamed("_copy", "_c").join(
        hit, (F.col("_c") == F.col("_copy")) & F.col(id_col).cast("long").eqNullSafe(F.col("_doc")), "left")
    # the text between the spans: before the first, between neighbours, after the last
    cuts = F.transform("spans", lambda s, i: F.struct(
        F.coalesce(F.get(F.col("spans"), i - 1)["end"], F.lit(0)).alias("from"), s["start"].alias("to")))
    tail = F.struct(F.element_at("spans", -1)["end"].alias("from"), F.length(text).alias("to"))
    left = F.array_join(F.transform(F.concat(cuts, F.array(tail)), lambda c: F.substr(
        text, c["from"] + 1, F.greatest(c["to"] - c["from"], F.lit(0)))), "")
    cleaned = F.when(F.col("spans").isNull(), F.col(text_col)).otherwise(left)
    columns = [c for c in docs.columns if c != text_col]
    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    return (joined.select(*columns, cleaned.alias(text_col), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                          F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"), "spans")
            .unionByName(same.select(*columns, F.col(text_col), F.lit(0).cast("long").alias("n_removed"),
                                     F.lit(0).cast("long").alias("removed_words"), none.alias("spans"))))


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: removed units and words, their spans as text, length and digest of what stays."""
    done = remove_repeats(docs.select(id_col, text_col), id_col, text_col, min_chars)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return done.select(
        id_col, "n_removed", "removed_words",
        F.array_join(F.transform(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")),
                                 lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
        F.length(text).cast("long").alias("kept_chars"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""language identification by a hashed character-trigram profile of fixed size.

A profile holds one whole-number score per language and trigram bucket: a million times the
log of the bucket's add-one smoothed frequency in that language's labelled texts. Its size is
``BUCKETS`` times the number of languages, whatever the corpus, so it travels with the task
and a document is scored inside its own row: no explode, no shuffle, and it serves the
micro-batches of a stream as well. Scores are whole numbers, so sums do not depend on order.

Counts are taken over all labelled texts, whole, and added up per task before they are
shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.skew import text_batches

# --------------------------------------------------------------------------
# Fixed values of the profile (shared with the SQL oracle).
# --------------------------------------------------------------------------
BUCKETS = 8_192  # a power of two
BATCH, SLICE = 256, 64  # documents in an Arrow batch, and those unpacked to Python at a time
WEIGHTS = (5_003, 2_711, 17)  # of a trigram's three code points
SCALE = 1_000_000
MOST_LANGUAGES = 1_000  # more distinct labels than this are not languages


def trigram_buckets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Bucket of every trigram of each text: lower-cased, runs of other than letters one space, a space at both ends."""
    for start in range(0, len(texts), SLICE):
        letters = pc.replace_substring_regex(pc.utf8_lower(texts.slice(start, SLICE)), r"[^\p{L}]+", " ")
        for text in letters.to_pylist():
            words = (text or "").strip(" ")
            if not words:
                yield np.empty(0, "i8")
                continue
            c = np.frombuffer(f" {words} ".encode("utf-32-le"), "<u4")
            a, b, d = (np.uint32(w) for w in WEIGHTS)  # 32-bit overflow leaves the remainder by a power of two as it is
            yield ((c[:-2] * a + c[1:-1] * b + c[2:] * d) & np.uint32(BUCKETS - 1)).astype("i8")


@dataclass(frozen=True)
class LanguageModel:
    """Scores per bucket (row) and language (column), languages in ascending order."""

    languages: tuple[str, ...]
    scores: np.ndarray

    def best(self, texts: pa.Array) -> pa.Array:
        """The best-scoring language of each text (of equal ones the last by name); null for a text without letters."""
        found: list[str | None] = []
        for buckets in trigram_buckets(texts):
            if len(buckets) and self.languages:
                total = np.bincount(buckets, minlength=BUCKETS) @ self.scores
                found.append(self.languages[len(total) - 1 - int(total[::-1].argmax())])
            else:
                found.append(None)
        return pa.array(found, pa.string())

    def detect(self, docs: DataFrame, text_col: str = "text", name: str = "detected") -> DataFrame:
        """``docs`` with the detected language in a further column ``name``."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, self.best(batch.column(text_col).cast(pa.string()))],
                                                 names=[*batch.schema.names, name])

        schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])
        return text_batches(docs, BATCH).mapInArrow(run, schema)


def bucket_counts(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, bucket, n): trigrams of all labelled texts per language and bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, buckets in zip(batch.column("lang").to_pylist(), trigram_buckets(batch.column("text").cast(pa.string()))):
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, "i8")
                counts[lang] += np.bincount(buckets, minlength=BUCKETS)
                if len(counts) > MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} distinct languages")
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])],
                                             names=["lang", "bucket", "n"])

    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    parts = text_batches(rows, BATCH).where("lang is not null and text is not null").mapInArrow(run, "lang string, bucket long, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, text_col: str, lang_col: str) -> LanguageModel:
    """The model of all labelled rows; at most ``BUCKETS`` counts a language reach the driver."""
    counts = bucket_counts(labelled, text_col, lang_col).toPandas()
    languages = tuple(sorted(counts["lang"].unique()))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} distinct languages")
    table = np.zeros((BUCKETS, len(languages)), "i8")
    column = {lang: k for k, lang in enumerate(languages)}
    table[counts["bucket"].to_numpy("i8"), counts["lang"].map(column).to_numpy("i8")] = counts["n"].to_numpy("i8")
    share = (table + 1) / (table.sum(axis=0) + BUCKETS)
    return LanguageModel(languages, np.round(SCALE * np.log(share)).astype("i8"))


# Runs inside Python workers: ship this module's code by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Corpus operators: tiering rules and trigram language identification."""

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from quarry.operators import corpus, language
from quarry.plans.catalog import QUERIES


def test_tier_rules(spark):
    rows = [("scanned", True, "en", 3, 0, "Hard"), ("native", False, "en", 3, 0, "Hard"),
            ("native", True, "en", 16, 0, "Hard"), ("native", True, "fr", 3, 0, "Hard"),
            ("native", True, "unknown", 9, 0, "Medium"), ("native", True, "en", 2, 5, "Medium"),
            ("native", True, "insufficient_text", 8, 4, "Simple")]
    df = spark.createDataFrame(rows, "scan string, ok boolean, lang string, pages int, tables int, want string")
    got = df.select(corpus.complexity_tier(F.col("scan"), F.col("ok"), F.col("lang"), F.col("pages"),
                                           F.col("tables")).alias("t"), "want").collect()
    assert all(r.t == r.want for r in got)


def test_language_detection_accuracy(spark):
    res = QUERIES["language_detect"](spark, "/root/testdata/sf0.001").collect()
    ok = sum(1 for r in res if r.detected == r.lang)
    assert len(res) > 50 and ok / len(res) >= 0.95


def _buckets(text):
    """Trigram buckets of a text by plain loops."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not letters:
        return []
    padded = " " + " ".join(letters) + " "
    return [(ord(a) * 5003 + ord(b) * 2711 + ord(c) * 17) % 8192 for a, b, c in zip(padded, padded[1:], padded[2:])]


def test_trigram_buckets_equal_plain_loops():
    texts = ["Hello, world", "", "  ", "12 34", "Übermaß naïve", "a", "x" * 5_000 + "\n\tend"]
    got = [b.tolist() for b in language.trigram_buckets(pa.array(texts))]
    assert got == [_buckets(t) for t in texts]


def test_model_counts_all_labelled_texts_and_detects(spark):
    rows = [("the cat and the dog", "en"), ("the end of the day", "en"), ("der hund und die katze", "de"), ("das ende des tages", "de"),
            (None, "de"), ("kein label hier", None)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    model = language.train(df, "text", "lang")
    assert model.languages == ("de", "en")
    for k, lang in enumerate(model.languages):
        counts = np.bincount([b for t, g in rows if g == lang and t for b in _buckets(t)], minlength=8192)
        assert (model.scores[:, k] == np.round(1e6 * np.log((counts + 1) / (counts.sum() + 8192)))).all()
    out = {r.text: r.found for r in model.detect(df.select("text"), "text", "found").collect()}
    assert out["the cat and the dog"] == "en" and out["das ende des tages"] == "de" and out[None] is None
    empty = language.train(df.limit(0), "text", "lang")
    assert empty.languages == () and {r.detected for r in empty.detect(df.select("text")).collect()} == {None}


def test_a_language_needs_text_long_enough_as_a_whole(spark):
    df = spark.createDataFrame([("x" * 51, "en", True), (" " * 99 + "x" * 50, "en", True), ("x" * 51, None, True), ("x" * 51, "en", False)],
                               "t string, d string, ok boolean")
    got = [r.g for r in df.select(corpus.gated_language(F.col("t"), F.col("d"), F.col("ok")).alias("g")).collect()]
    assert got == ["en", "insufficient_text", "unknown", "unknown"]


def test_the_profile_does_not_read_the_language_column(spark):
    from quarry.plans import fixtures as fx
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = fx.language_model(spark, "/root/testdata/sf0.001")
    one = corpus.profile(fx.doc_facts_from(docs, model)).select("filename", "language")
    other = corpus.profile(fx.doc_facts_from(docs.drop("lang"), model)).select("filename", "language")
    assert sorted(one.collect()) == sorted(other.collect())

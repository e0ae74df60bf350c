"""Response parsing (P24/P25/T6) and prompt assembly."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import prompts as P


@pytest.mark.parametrize("raw,rule,value", [
    ('```json\n{"a": "1"}\n```', "fenced", {"a": "1"}),
    ('```\n{"a": "1"}\n```', "fenced", {"a": "1"}),
    ('Sure! {"a": "1"} Done.', "braces", {"a": "1"}),
    ('```json\n{"a": "1"} x\n```', "braces", {"a": "1"}),                  # fence fails, braces succeed
    ('```json\n{"a": 1,}\n``` and {"b": "2"}', "none", {}),               # both rules fail
    ("{'a': '1'}", "none", {}),                                          # single quotes rejected
    ('{"a": "1"', "none", {}),                                           # truncated
    ('{"a": "1"}],[{"b": "2"}', "none", {}),                              # two objects in two lists
    ('{"a": "1"},"b":{"c": "2"}', "none", {}),                            # members after the object
    ('{"a": "1"},"end":1},{"v":{"b": "2"}', "none", {}),
    ('{"a": "1"}}', "none", {}),
    ('{"a": "1", "a": "2"}', "braces", {"a": "2"}),                       # the last of repeated keys wins
    ("no json here", "none", {}),
])
def test_extract_json(spark, raw, rule, value):
    df = P.parse_responses(spark.createDataFrame([(raw,)], "raw_text string"))
    r = df.first()
    assert r.rule == rule and json.loads(r.parsed) == value


def test_prompt_shape(spark):
    df = spark.createDataFrame([("DOC TEXT",)], "text string")
    tables = F.array(F.struct(F.lit(0).alias("index"), F.lit("| a |").alias("markdown")),
                     F.struct(F.lit(1).alias("index"), F.lit("").alias("markdown")))
    block = P.field_block(F.array(F.lit("Product Name"), F.lit("Owner")))
    p = df.select(P.build_prompt(block, F.col("text"), tables).alias("p")).first().p
    assert '  "Product Name": "..."\n  "Owner": "..."' in p
    assert "EPD DOCUMENT:\nDOC TEXT\n\nTABLE DATA:\n| a |\n\nRespond" in p
    assert "ACIDIFICATION, EUTROFICATION, FRESH WATER" in p
    empty = df.select(P.build_prompt(block, F.col("text"),
                                     F.array().cast("array<struct<index:int,markdown:string>>")).alias("p")).first().p
    assert "(no tables extracted)" in empty


def test_short_model_name(spark):
    df = spark.createDataFrame([("microsoft/Phi-4-mini-instruct",)], "m string")
    assert df.select(P.short_model_name(F.col("m")).alias("s")).first().s == "phi-4-mini-zero-shot"


def test_model_sees_bounded_batches(spark):
    """prompts and texts reach Python in batches of at most a few hundred, whatever the partition holds."""
    from quarry.operators import language
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for make in (lambda d: P.run_extractor(d, "text", "id", lambda: lambda p: p), lambda d: language.LanguageModel((), None).detect(d)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        try:
            df = make(spark.range(0, 1500, 1, 1).select("id", F.lit("a text").alias("text")))
            assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
            assert df.count() == 1500
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_language_model_is_read_without_the_library():
    """workers need not have the library; what a task carries must not import it."""
    import subprocess
    import sys

    from pyspark import cloudpickle
    from quarry.operators import language
    sent = cloudpickle.dumps(language.LanguageModel((), None))
    done = subprocess.run([sys.executable, "-c", "import pickle, sys; pickle.loads(sys.stdin.buffer.read())"], input=sent,
                          cwd="/", env={}, capture_output=True)
    assert done.returncode == 0, done.stderr.decode()[-500:]

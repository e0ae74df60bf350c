"""Vector search against brute force, recall of the cells alone, and passages by field terms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import prompts, retrieval

ROWS = "id long, vec array<float>"


def _vectors(n=600, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.4
    rows[50:60] = rows[50]  # copies: ties go by id
    rows[70] = 0
    return rows.astype("f4")


def _brute(rows, queries, k):
    x = rows.astype("f8")
    size = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(size > 0, size, 1)
    out = {}
    for q in queries:
        score = np.round(unit @ unit[q], 12)
        out[q] = sorted((i for i in range(len(rows)) if i != q), key=lambda i: (-score[i], i))[:k]
    return out


def _found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query"], {})[r["rank"]] = r["id"]
    return {q: [ids[k] for k in sorted(ids)] for q, ids in out.items()}


@pytest.fixture(scope="module")
def filed(spark):
    rows = _vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(None, rows[0].tolist()), (9_000, None)], ROWS).repartition(5)
    return rows, df, retrieval.build_index(df, "id", "vec", cells=20)


def _queries(df, step=25):
    return df.where(F.col("id") % step == 0).select(F.col("id").alias("query"), "vec")


@pytest.mark.parametrize("block", [4_096, 7])
def test_search_equals_brute_force(spark, filed, monkeypatch, block):
    rows, df, _ = filed
    monkeypatch.setattr(retrieval, "BLOCK", block)  # crowded cells are met in blocks
    index = retrieval.build_index(df, "id", "vec", cells=20)
    got = _found(retrieval.search(_queries(df), index, k=5, probes=2))
    assert got == _brute(rows, range(0, 600, 25), 5)


def test_the_nearest_cells_alone_have_recall(filed):
    rows, df, index = filed
    want = _brute(rows, range(0, 600, 25), 5)
    got = _found(retrieval.search(_queries(df), index, k=5, probes=4, exact=False))
    assert sum(len(set(got.get(q, [])) & set(ids)) for q, ids in want.items()) / (5 * len(want)) >= 0.9


def test_fewer_rows_than_asked_and_none(spark):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], ROWS)
    index = retrieval.build_index(few, "id", "vec")
    assert _found(retrieval.search(_queries(few, 1), index, k=5)) == {1: [2], 2: [1]}
    none = few.limit(0)
    assert retrieval.search(_queries(few, 1), retrieval.build_index(none, "id", "vec"), k=5).count() == 0
    assert retrieval.search(_queries(none, 1), index, k=5).count() == 0


def test_passages_are_the_chunks_with_most_terms(spark):
    fields = spark.createDataFrame([(1, "Order Status"), (2, "Priority"), (3, "Flags")], "rank long, field string")
    groups = retrieval.field_groups(fields, ("TAX", "QTY"), 2, {"TAX": "levy on sale"})
    got = {r.field_group: (r.kind, r.names, r.terms) for r in groups.collect()}
    assert got == {"fields-1": ("fields", ["Order Status", "Priority"], ["order", "priority", "status"]),
                   "fields-2": ("fields", ["Flags"], ["flags"]),
                   "indicators-1": ("indicators", ["QTY", "TAX"], ["levy", "on", "qty", "sale", "tax"])}
    pad = "x" * 10
    text = "".join(s.ljust(20) for s in ("order", "none", "status order", "order order", "status priority order"))
    docs = spark.createDataFrame([(1, text), (2, pad), (3, ""), (4, None)], "doc_id long, text string")
    shown = retrieval.group_passages(docs, groups, "doc_id", "text", most=2, size=20, overlap=0).collect()
    assert len(shown) == 12
    by = {(r.doc_id, r.field_group): (r.n_chunks, r.passages) for r in shown}
    assert by[1, "fields-1"] == (2, "status order        \n...\nstatus priority order"[:20] + "\n...\n" + "status priority orde")
    assert by[1, "fields-2"] == (0, "") and by[2, "fields-1"] == (0, "") and by[4, "indicators-1"] == (0, "")


def test_every_document_gets_examples_but_itself(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    for size, each in ((0, 0), (1, None), (2, None), (3, 2), (20, 2)):
        pool = docs.select("doc_id").where(F.col("doc_id") < size)
        picks = prompts.draw_examples(docs.select("doc_id"), pool, "doc_id", k=2).collect()
        seen = {}
        for r in picks:
            assert r.example != r.doc_id and r.example < size
            seen.setdefault(r.doc_id, set()).add(r.example)
        for d in range(50):
            want = min(2, size - (d < size)) if each is None else each
            assert len(seen.get(d, ())) == want
        if size == 20:
            assert len({r.example for r in picks}) > 10  # the pool is used, not its first few
    block = prompts.example_block(docs, prompts.draw_examples(docs, docs.where("doc_id < 3"), "doc_id"), docs, "doc_id", "text").collect()
    one = next(r for r in block if r.doc_id == 9)
    assert one.examples == "".join(f"EXAMPLE DOCUMENT:\ntext {e}\n\n" for e in one.example_ids) and len(one.example_ids) == 2


def test_words_are_looked_up_not_compared_with_every_term(spark):
    """the vocabulary is a hashed table; no word is held against each term of a wide schema."""
    from quarry.operators import retrieval
    chunks = spark.createDataFrame([(1, 0, "Red red blue"), (1, 1, "green"), (2, 0, None), (None, 0, "red")],
                                   "doc_id bigint, chunk_idx int, chunk string")
    groups = spark.createDataFrame([("g1", ["red", "blue"]), ("g2", ["red", "black"])], "field_group string, terms array<string>")
    found = retrieval.term_postings(chunks, groups, "doc_id")
    assert "array_contains" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.select("term", "doc_id", "chunk_idx", "tf").collect()), key=str) == [
        ("blue", 1, 0, 1), ("red", 1, 0, 2), ("red", None, 0, 1)]

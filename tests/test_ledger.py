"""Cascade rules, sweeps, exact quantiles and text cleaning on inputs that tell neighbouring rules apart."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quarry.functions.skew import exact_quantiles, salted_join
from quarry.operators import chunking, ledger

SCHEMA = "doc long, tier int, confidence double, correct boolean, price decimal(10,4), latency decimal(18,2)"


def attempts(spark, rows):
    return spark.createDataFrame([(d, t, c, ok, Decimal(p), Decimal(1)) for d, t, c, ok, p in rows], SCHEMA)


def test_cascade_accepts_only_above_the_tier_threshold(spark):
    a = attempts(spark, [(1, 1, 0.5, False, "1"), (1, 2, 0.6, True, "2"), (1, 3, 0.1, False, "4"),   # equal: not accepted
                         (2, 1, 0.51, True, "1"), (2, 2, 0.9, False, "2"),
                         (3, 1, 0.1, True, "1"), (3, 2, 0.1, True, "2")])                          # last tier accepts
    got = {r.doc: (r.accepted_tier, r.correct, float(r.cost)) for r in ledger.cascade(a, {1: 0.5, 2: 0.55, 3: 0.9}).collect()}
    assert got == {1: (2, True, 3.0), 2: (1, True, 1.0), 3: (2, True, 3.0)}


def test_sweep_follows_the_tier_order(spark):
    a = attempts(spark, [(1, 1, 0.9, False, "1"), (1, 2, 0.9, True, "5"), (2, 2, 0.2, True, "5")])
    grid = ledger.sweep_grid({"up": (1, 2), "down": (2, 1)}, steps=2, decay=0.0)
    got = {(r.tier_order, r.threshold): (r.n_docs, r.accuracy, r.total_cost) for r in ledger.threshold_sweep(a, grid).collect()}
    assert got[("up", 0.5)] == (2, 0.5, 6.0) and got[("down", 0.5)] == (2, 1.0, 10.0)
    assert got[("up", 1.0)] == (2, 1.0, 11.0) and got[("down", 1.0)] == (2, 0.5, 11.0)


def test_quantiles_are_exact_with_ties_and_nulls(spark):
    rows = [("a", float(v % 7)) for v in range(1001)] + [("b", 2.5)] + [("b", None)]
    got = {r.g: (r.n, r.q0, r.q1) for r in
           exact_quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x", [0.5, 0.95]).collect()}
    values = sorted(x for g, x in rows if g == "a")
    assert got == {"a": (1001, values[500], values[950]), "b": (1, 2.5, 2.5)}


def test_hot_key_meets_its_row_in_parts(spark):
    left = spark.range(9000).select((F.when(F.col("id") < 6000, 0).otherwise(F.col("id"))).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        out = salted_join(left, right, ["k"], [F.col("id")], "n", 9000)
        sizes = out.where("k = 0").groupBy(F.spark_partition_id()).count().collect()
        assert out.count() == 9000 and max(r["count"] for r in sizes) < 6000
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_cleaning_collapses_before_it_removes_markers(spark):
    text = "A\n\n\n\nPage 1 of 2\nB see Page 2 of 9 here "
    got = spark.createDataFrame([(text,)], "t string").select(chunking.clean_text(F.col("t")).alias("c")).first().c
    assert got == "A\n\n\nB see  here"


def _brute_sweep(rows, grid):
    """{(name, step): (docs, hits, cost)} by walking every document through every grid point."""
    best = {}
    for d, t, c, ok, p in rows:
        if (d, t) not in best or (c, ok, Decimal(p)) > best[d, t]:
            best[d, t] = (c, ok, Decimal(p))
    out = {}
    for g in grid:
        docs = hits = 0
        cost = Decimal(0)
        for d in {r[0] for r in rows}:
            spent, end = Decimal(0), None
            for t, least in zip(g.order, g.thresholds):
                if (d, t) in best:
                    c, ok, p = best[d, t]
                    spent, end = spent + p, ok
                    if c > least:
                        break
            if end is not None:
                docs, hits, cost = docs + 1, hits + end, cost + spent
        if docs:
            out[g.name, g.step] = (docs, hits / docs, float(cost))
    return out


@pytest.mark.parametrize("decay", [0.0, 0.05, -0.1])
def test_sweep_by_breakpoints_equals_every_point_walked(spark, decay):
    rng = random.Random(5)
    rows = [(d, t, rng.choice([0.0, 0.2, 0.25, 0.5, 0.55, 1.0, rng.random()]), rng.random() < .5, str(rng.randint(1, 9)))
            for d in range(60) for t in rng.sample([1, 2, 3], rng.randint(0, 3)) for _ in range(rng.randint(1, 2))]
    grid = ledger.sweep_grid({"up": (1, 2, 3), "down": (3, 2, 1), "two": (2,)}, steps=5, decay=decay)
    falling = ledger.CascadeConfig("falls", 0.0, (1, 2), (0.5, 0.1)), ledger.CascadeConfig("falls", 1.0, (1, 2), (0.1, 0.9))
    grid = [*grid, *falling]
    got = {(r.tier_order, r.threshold): (r.n_docs, r.accuracy, r.total_cost) for r in ledger.threshold_sweep(attempts(spark, rows), grid).collect()}
    want = _brute_sweep(rows, grid)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_sweep_of_no_attempts(spark):
    assert ledger.threshold_sweep(attempts(spark, []), ledger.sweep_grid({"up": (1, 2)})).count() == 0


def test_weighted_quantiles_equal_repeated_rows(spark):
    """rows that carry their number give the quantiles of the rows written out."""
    rows = [("a", 3.0, 5), ("a", 1.0, 2), ("a", 1.0, 1), ("a", 9.0, 4), ("b", 2.0, 1), ("b", None, 7), ("c", 5.0, 1000)]
    df = spark.createDataFrame(rows, "g string, x double, w int")
    plain = df.select("g", F.explode(F.array_repeat("x", F.col("w"))).alias("x"))
    got = exact_quantiles(df, ["g"], "x", [0.25, 0.5, 0.95], "w").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, exact_quantiles(plain, ["g"], "x", [0.25, 0.5, 0.95]).collect()))

"""Harness identities and record semantics (the reference's own checks, in Spark)."""

import json

from pyspark.sql import functions as F

from quarry.operators import scoring as S
from quarry.plans import fixtures as fx

SPEC = S.ScoringSpec(indicators=("GWP-TOTAL", "PERT"))


def _gold(spark, records):
    rows = [(i, r.get("file_name", ""), json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "orig_index bigint, file_name string, body string")


def _preds(spark, records, seqs=None):
    rows = [(r.get("file_name", ""), (seqs or list(range(len(records))))[i], json.dumps(r))
            for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "file_name string, seq bigint, body string")


GOLD = [{"file_name": "a.pdf", "Product Name": "Tile é", "Owner": "N/A", "Standard List": ["EN 15804", "ISO"],
         "GWP-TOTAL": {"A1": "1.0", "A2": "N/A", "D1": "x", "Unit": "kg CO₂e"},
         "PERT": {"A1-A3": "2.5E+01", "Unit": "MJ"}},
        {"file_name": "b.pdf", "Product Name": "Paint", "GWP-TOTAL": "not an object",
         "PERT": {"A1-A3": "AGG", "Unit": "MJ"}}]


def test_self_score_is_perfect(spark):
    rec = S.score_records(_gold(spark, GOLD), _preds(spark, GOLD), SPEC).orderBy("orig_index").collect()
    for r in rec:
        assert r.f1_overall == 1.0 and r.f1_populated == 1.0 and r.f1_metadata == 1.0 and r.f1_lca == 1.0
    assert rec[0].f1_na == 1.0 and rec[0].schema_valid
    assert not rec[1].schema_valid  # GWP-TOTAL is not an object in the prediction either


def test_empty_prediction(spark):
    rec = S.score_records(_gold(spark, GOLD[:1]), _preds(spark, [{"file_name": "a.pdf"}]), SPEC).first()
    assert rec.f1_overall < 1.0 and rec.f1_populated == 0.0 and not rec.schema_valid
    # the empty gold list still scores against the missing prediction: list F1 0 here (gold list non-empty)
    assert rec.f1_list == 0.0


def test_all_na_prediction(spark):
    na = {"file_name": "a.pdf", "Product Name": "N/A", "Owner": "N/A", "Standard List": "N/A",
          "GWP-TOTAL": {"A1": "N/A", "A2": "N/A", "Unit": "N/A"}, "PERT": {"A1-A3": "N/A", "Unit": "N/A"}}
    rec = S.score_records(_gold(spark, GOLD[:1]), _preds(spark, [na]), SPEC).first()
    assert rec.f1_na == 1.0 and rec.f1_populated == 0.0


def test_leaves_skip_stages_and_non_object_indicators(spark):
    lv = S.field_scores(_gold(spark, GOLD), _preds(spark, GOLD), SPEC)
    fields = {(r.orig_index, r.field) for r in lv.collect()}
    assert (0, "GWP-TOTAL.D1") not in fields       # custom stage never scored
    assert not any(f.startswith("GWP-TOTAL") for i, f in fields if i == 1)  # gold not an object: dropped
    assert (0, "GWP-TOTAL.Unit") in fields and (0, "Standard List") in fields


def test_last_prediction_wins_and_missing_gold(spark):
    wrong = dict(GOLD[0], **{"Product Name": "other"})
    preds = _preds(spark, [GOLD[0], wrong, {"file_name": "zzz.pdf"}], seqs=[2, 1, 0])
    rec = {r.orig_index: r for r in S.score_records(_gold(spark, GOLD), preds, SPEC).collect()}
    assert rec[0].f1_overall == 1.0              # seq 2 beats seq 1
    assert rec[1].has_prediction is False and rec[1].f1_overall < 1.0
    un = S.unmatched_predictions(_gold(spark, GOLD), preds).collect()
    assert [r.file_name for r in un] == ["zzz.pdf"]


def test_gold_duplicates_fan_out(spark):
    g = _gold(spark, [GOLD[0], GOLD[0]])
    rec = S.score_records(g, _preds(spark, GOLD[:1]), SPEC).collect()
    assert len(rec) == 2 and all(r.f1_overall == 1.0 for r in rec)


def test_duplicate_keys_last_value_wins(spark):
    gold = spark.createDataFrame([(0, "d.pdf", '{"file_name":"d.pdf","X":"old","X":"new"}')],
                                 "orig_index bigint, file_name string, body string")
    pred = spark.createDataFrame([("d.pdf", 0, '{"X":"new","Y":null}')], "file_name string, seq bigint, body string")
    lv = S.field_scores(gold, pred, SPEC).collect()
    assert [(r.field, r.gold_value, r.match) for r in lv] == [("X", "new", 1.0)]


def test_null_and_absent_differ(spark):
    gold = spark.createDataFrame([(0, "n.pdf", '{"A":"None","B":"x"}')], "orig_index bigint, file_name string, body string")
    pred = spark.createDataFrame([("n.pdf", 0, '{"A":null}')], "file_name string, seq bigint, body string")
    lv = {r.field: r for r in S.field_scores(gold, pred, SPEC).collect()}
    assert lv["A"].pred_value == "None" and lv["A"].match == 1.0
    assert lv["B"].pred_value == "MISSING"


def test_list_f1_semantics(spark):
    cases = [('["a","b"]', '["A"]', True, 2 * 1.0 * 0.5 / 1.5), ('[]', None, False, 1.0),
             ('["a"]', 'a', True, 1.0), ('["a"]', 'N/A', True, 0.0), ('x', '[]', True, 1.0)]
    df = spark.createDataFrame([(g, p, pr) for g, p, pr, _ in cases], "g string, p string, pr boolean")
    got = [r.f for r in df.select(S.list_f1(F.col("g"), F.col("p"), F.col("pr")).alias("f")).collect()]
    assert got == [c[3] for c in cases]


def test_f1_bounds_and_order_invariance(spark):
    sf = "/root/testdata/sf0.001"
    gold, preds = fx.gold_records(spark, sf), fx.pred_records(spark, sf)
    a = S.score_records(gold, preds, fx.FIXTURE_SPEC)
    b = S.score_records(gold.repartition(3).orderBy(F.rand(1)), preds.repartition(5), fx.FIXTURE_SPEC)
    key = ["orig_index", "f1_overall", "f1_populated", "f1_na", "f1_metadata", "f1_lca", "f1_list"]
    ra, rb = sorted(map(tuple, a.select(key).collect())), sorted(map(tuple, b.select(key).collect()))
    assert ra == rb
    for r in a.collect():
        for c in key[1:]:
            assert 0.0 <= getattr(r, c) <= 1.0


def test_scoring_plan_is_python_free_and_lean(spark):
    sf = "/root/testdata/sf0.001"
    df = S.score_records(fx.gold_records(spark, sf), fx.pred_records(spark, sf), fx.FIXTURE_SPEC)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # the per-record aggregate reuses the join's partitioning after a sort-merge join
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        smj = S.score_records(fx.gold_records(spark, sf), fx.pred_records(spark, sf), fx.FIXTURE_SPEC)
        p = smj._jdf.queryExecution().optimizedPlan().toString()
        assert p.count("from_json") > 0
        phys = smj._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in phys
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_name_is_salted_and_scores_match(spark):
    # one file name holds most records: it must be salted and still score exactly as unsalted
    recs = [dict(GOLD[0], **{"Product Name": f"p{i}"}) for i in range(200)] + GOLD[1:]
    gold = _gold(spark, recs)
    preds = _preds(spark, [dict(GOLD[0], **{"Product Name": "p7"}), GOLD[1]])
    hot = [r.file_name for r in S.hot_names(gold, floor=20).collect()]
    assert hot == ["a.pdf"]
    salted = S.score_records(gold, preds, SPEC)
    rows = {r.orig_index: r for r in salted.collect()}
    assert len(rows) == 201
    assert rows[7].f1_metadata == 1.0 and rows[8].f1_metadata < 1.0
    assert all(r.has_prediction for r in rows.values())
    paired = S.pair_records(gold, preds, floor=20)
    more = S.pair_records(gold, preds, floor=5)
    buckets = lambda df: df.where("file_name = 'a.pdf'").select("salt").distinct().count()
    assert buckets(more) > buckets(paired)  # tasks grow with the name's rows
    assert paired.where("file_name = 'a.pdf'").select("salt").distinct().count() > 1
    unsalted = S.pair_records(gold, preds)
    assert unsalted.count() == paired.count() == 201


def test_neighbours_over_file_borders(spark):
    """Passes of one key spread over several files: each meets the pass before it, once."""
    rows = [("hot", p, s, f"v{p}{s}") for p in ("x", None) for s in range(300)] + [("a", "x", 0, "only"), ("b", "x", 1, "q"), ("b", "x", 0, "p"),
                                                                                 ("b", None, 5, "z"), (None, None, 1, "n1"), (None, None, 2, "n2")]
    df = spark.createDataFrame(rows, "file_name string, product string, seq bigint, body string").repartition(4)
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = S.neighbours(df, ("file_name", "product"), ("seq", "body"), "body").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        want = {("hot", p, s + 1, f"v{p}{s}", f"v{p}{s - 1}") for p in ("x", None) for s in range(1, 300)}
        want |= {("b", "x", 2, "q", "p"), (None, None, 2, "n2", "n1")}
        assert len(got) == len(want) and {(r.file_name, r["product"], r["pass"], r.body, r["_before"]) for r in got} == want


def test_a_name_with_most_gold_records_takes_several_tasks(spark):
    gold = spark.range(6000).select(F.col("id").alias("orig_index"), F.when(F.col("id") < 4000, "hot").otherwise(F.col("id").cast("string")).alias("file_name"),
                                    F.lit("{}").alias("body"))
    tried = spark.createDataFrame([("hot",), ("5000",), ("none",)], "file_name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept = S.restrict_to_attempted(gold, tried)
        sizes = [r["count"] for r in kept.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4001 and max(sizes) < 3000 and kept.columns == gold.columns
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_floats_are_shown_as_python_shows_them(spark):
    import random
    import struct

    from quarry.functions.records import float_text
    rng = random.Random(8)
    values = [1.0, 1e-5, 1.5e-4, 1e-4, 9999999.0, 1e7, 1.25e15, 1e16, 1.5e16, 1e22, 123456.789, -2.5e-10, 100.0, 1e15]
    values += [struct.unpack("d", rng.randbytes(8))[0] for _ in range(400)] + [rng.uniform(-1e6, 1e6) for _ in range(200)]
    values = [float(f"{v:.13e}") for v in values if v == v and abs(v) > 1e-300]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", float_text(F.col("v")).alias("t")).collect()
    other = [(r.t, str(values[r.i])) for r in rows if r.t != str(values[r.i])]
    # an older JVM prints more digits than it needs for a few values
    assert len(other) < len(values) / 100 and all(float(a) == float(b) and len(a) > len(b) for a, b in other)


def test_json_types_reach_the_matcher(spark):
    cases = [  # gold value, predicted value, match
        ("1e-05", 1e-05, 1.0), ("0.00001", 1e-05, 0.0), ("True", True, 1.0), ("true", True, 1.0), ("true", "true", 1.0),
        ("2.50", 2.5, 0.0), ("2.5", 2.50, 1.0), ("2.50", "2.50", 1.0), (1.0, "1.0", 1.0), (1, "1.0", 0.0), (7, "7", 1.0), ("1e+16", 1e16, 1.0)]
    listed = [  # gold list, predicted value, match: Python's falsy values give an empty list
        ([], 0, 1.0), ([], "0", 0.0), (["0"], "0", 1.0), ([], False, 1.0), ([], {}, 1.0), (["{}"], "{}", 1.0), ([], "{}", 0.0),
        ([], 0.0, 1.0), (["false"], "false", 1.0), (["1.5"], 1.5, 1.0), ([], "", 1.0), ([], None, 1.0)]
    gold, pred = [], []
    for i, (field, (g, p, _)) in enumerate([("Product Name", c) for c in cases] + [("Tags List", c) for c in listed]):
        gold.append((i, f"f{i}", json.dumps({"file_name": f"f{i}", field: g})))
        pred.append((f"f{i}", 1, json.dumps({"file_name": f"f{i}", field: p})))
    got = S.field_scores(spark.createDataFrame(gold, "orig_index bigint, file_name string, body string"),
                         spark.createDataFrame(pred, "file_name string, seq bigint, body string")).collect()
    assert {r.orig_index: r.match for r in got} == {i: c[2] for i, c in enumerate(cases + listed)}


def test_records_are_paired_in_tasks_of_bounded_size(spark):
    """The pairing's tasks follow the number of records, not the bytes they are packed into."""
    from quarry.functions.skew import ROWS_PER_TASK
    n = 3 * ROWS_PER_TASK
    gold = spark.range(n).select(F.col("id").alias("orig_index"), F.col("id").cast("string").alias("file_name"), F.lit("{}").alias("body"))
    preds = gold.select("file_name", F.lit(1).cast("bigint").alias("seq"), "body")
    paired = S.pair_records(gold, preds, names=gold.select("file_name"))
    assert "REPARTITION_BY_NUM" in paired._jdf.queryExecution().executedPlan().toString()
    assert paired.where("has_prediction").count() == n


def test_leaf_rows_are_the_raw_leaves(spark):
    """The row form lists what ``raw_leaves`` lists, on odd members too, and keeps a row of every record."""
    gold = GOLD + [{"file_name": "c.pdf"}, {}, {"GWP-TOTAL": {}, "PERT": {"Unit": None, "A1": "2.50"}, "Tags List": "x", "Flag": True, "Size": 1.50}]
    preds = [{"GWP-TOTAL": {"A1": "1.0", "Unit": None}, "Owner": None, "Standard List": 0}, {}, {"PERT": "no object"}, {"a": 1},
             {"PERT": {"A1": 2.5}, "Tags List": "{}", "Flag": "True", "Size": "1.5"}]
    texts = [(i, json.dumps(g), json.dumps(p)) for i, (g, p) in enumerate(zip(gold, preds, strict=True))]
    texts += [(90, '{"PERT":{"A1":"1","A1":"2","Unit":"MJ"},"X":"a","X":"b"}', '{"PERT":{"A1":"3","A1":"2"},"X":"c","X":"b"}'), (91, "no json", "{}")]
    df = spark.createDataFrame(texts, "i int, g string, p string").select(
        "i", "g", "p", S.parse_object(F.col("g")).alias("gm"), F.coalesce(S.parse_object(F.col("p")), S.empty_map()).alias("pm"))
    want = df.select("i", F.inline(S.raw_leaves(F.col("gm"), F.col("pm"), SPEC, F.col("g"), F.col("p"))))
    rows = S.leaf_rows(df, "gm", "pm", SPEC, "g", "p")
    order = lambda d: sorted(map(tuple, d.select(*want.columns).collect()), key=repr)
    assert order(rows.where("field is not null")) == order(want) and want.count() == 19
    assert {r.i for r in rows.collect()} == {t[0] for t in texts}
    units = {(r.i, r.field.split(".")[0], r.gold_unit) for r in rows.where("category like 'lca%'").collect()}
    assert units == {(0, "GWP-TOTAL", "kg CO₂e"), (0, "PERT", "MJ"), (1, "PERT", "MJ"), (4, "PERT", "None"), (90, "PERT", "MJ")}


def test_leaves_are_listed_outside_nested_lambdas(spark):
    """Listing leaves inside lambdas ran interpreted, and inline's filter listed them again."""
    sf = "/root/testdata/sf0.001"
    lv = S.field_scores(fx.gold_records(spark, sf), fx.pred_records(spark, sf), fx.FIXTURE_SPEC)
    plan = lv._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" not in plan and "flatten(" not in plan


def test_identical_numbers_that_are_not_finite_do_not_match(spark):
    """F8: identical texts skip parsing only where the number must be finite."""
    cases = [("nan", None), ("Infinity", None), ("1e400", None), ("9" * 400, None), ("1.5", 1.0), ("N/A", 1.0), ("kein", 1.0), ("1e5", 1.0)]
    raw = spark.createDataFrame([("f", "lca_numeric", v, v, None, None, None) for v, _ in cases], S.RAW_LEAF.replace("struct<", "")[:-1].replace(":", " "))
    got = {r.gold_value: r.match for r in S.typed_leaves(raw).collect()}
    assert {v: (got[v] == 1.0) for v, _ in cases} == {v: m == 1.0 for v, m in cases}


ODD_TEXTS = ['{"a":1}', ' {"a":"1","Unit":null}', "{}", "N/A", "", None, "no object", '{"a":1,"a":2,"b":3}', '{"a":1} junk', '{"a":1', '{"a":"', '{"}',
             '{"a":1},{"a":2}', '{"a":1},{"mark":"1"},{"a":2}', "{'x':'", '{"x":[1', ']}', '{"x":[{"y":1}],"z":{"q":NaN}}', '{"a":NaN,"b":1e400,"c":2.50}',
             '{"a":"CO₂e \\u00e9 \\"q\\"","b":" x "}', '{"mark":"5"}', '{"a":tru}']


def test_objects_parsed_in_one_go_are_those_parsed_one_by_one(spark):
    """texts that do not stand for themselves (errors, several objects, repeated keys) are left to be parsed alone."""
    from quarry.functions.records import with_objects
    rows = [(i, a, b, c) for i, (a, b) in enumerate((a, b) for a in ODD_TEXTS for b in ODD_TEXTS) for c in ('{"k":"v"}',)]
    df = spark.createDataFrame(rows, "i int, a string, b string, c string")
    alone = [S.parse_object(F.col(c)).alias(f"m{c}") for c in "abc"]
    got = with_objects(df, [F.col(c) for c in "abc"], "objects").select("i", "a", "b", "objects", F.array("a", "b", "c").alias("t"), *alone).collect()
    assert len(got) == len(rows)
    assert all(r.objects is None or r.objects == [r.ma, r.mb, r.mc] for r in got)
    clean = {'{"a":1}', ' {"a":"1","Unit":null}', "{}", "N/A", "", None, "no object", '{"x":[{"y":1}],"z":{"q":NaN}}', '{"a":NaN,"b":1e400,"c":2.50}',
             '{"a":"CO₂e \\u00e9 \\"q\\"","b":" x "}', '{"mark":"5"}'}
    assert all(r.objects is not None for r in got if r.a in clean and r.b in clean)


def test_leaf_rows_of_odd_indicator_texts(spark):
    """leaves are those of the one-by-one form whatever the indicators' texts, lists and flat members hold."""
    lists = [["x", "Y"], [], ["0"], "0", 0, None, False, "{}", {}, "a", ["x", None], ["y", "X"], 1.5, "[1"]
    texts = [(i, json.dumps({"GWP-TOTAL": a, "PERT": {"A1": "1", "Unit": "MJ"}, "Standard List": lists[i % len(lists)], "Size": [1.50, "1.50", True, "0"][i % 4]}),
              json.dumps({"PERT": b, "GWP-TOTAL": {"A1": "2"}, "Standard List": lists[i // len(lists) % len(lists)], "Size": ["1.5", 1.5, "True", 0][i // 4 % 4]}))
             for i, (a, b) in enumerate((a, b) for a in ODD_TEXTS for b in ODD_TEXTS)]
    df = spark.createDataFrame(texts, "i int, g string, p string").select(
        "i", "g", "p", S.parse_object(F.col("g")).alias("gm"), F.coalesce(S.parse_object(F.col("p")), S.empty_map()).alias("pm"))
    want = df.select("i", F.inline(S.raw_leaves(F.col("gm"), F.col("pm"), SPEC, F.col("g"), F.col("p"))))
    rows = S.leaf_rows(df, "gm", "pm", SPEC, "g", "p").where("field is not null")
    order = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert order(rows.select(*want.columns)) == order(want)
    assert order(S.typed_leaves(rows)) == order(S.typed_leaves(want))  # lists scored as members or as leaves


def test_field_scores_parse_objects_jointly_and_move_bodies_once(spark):
    """each object was parsed alone, a member's row carried both bodies, predictions were sorted with two copies of each."""
    sf = "/root/testdata/sf0.001"
    lv = S.field_scores(fx.gold_records(spark, sf), fx.pred_records(spark, sf), fx.FIXTURE_SPEC)
    plan = lv._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrayType(MapType(StringType,StringType" in plan and "max_by" not in plan


def test_latest_prediction_of_odd_rows(spark):
    rows = [("a", 1, "x"), ("a", 2, None), ("a", 2, "b"), ("a", 2, "c"), ("b", None, "p"), ("b", None, None), ("c", 1, "y"), ("c", None, "z"),
            (None, 3, "n"), (None, 4, "m"), ("d", 1, None)]
    got = S.latest_predictions(spark.createDataFrame(rows, "file_name string, seq bigint, body string")).collect()
    assert {(r.file_name, r.pred_body) for r in got} == {("a", "c"), ("b", "p"), ("c", "y"), (None, "m"), ("d", None)}

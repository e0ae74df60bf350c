"""Extraction scoring: nested gold/predicted records -> leaf matches -> F1 slices.

Contract for inputs (schema-less JSON held as text):

* gold:  ``orig_index BIGINT, file_name STRING, body STRING``
* preds: ``file_name STRING, seq BIGINT, body STRING`` (``seq`` orders
  repeated predictions for one name; the highest wins, J1)

Plan shape: predictions are reduced to one row per ``file_name`` (partial
aggregation map-side) and gold is left-joined on ``(file_name, salt)``, where
names holding a large share of the records are salted over several buckets
(``pair_records``). After the join each record's bodies are parsed once and all
its nested objects in one go, two explodes list its leaves as rows, typed matching runs as codegen'd row expressions, and a per-record aggregate on
``(file_name, salt, ...)`` reuses the join's partitioning (no further shuffle).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.records import (
    LOOKS_FALSY,
    LOOKS_TYPED,
    dedupe_keys,
    empty_map,
    has_distinct_keys,
    object_map,
    parse_array,
    parse_object,
    python_text,
    typed_member,
    with_objects,
)
from quarry.functions.skew import ROWS_PER_TASK, materialise, salted_join, sorted_rows
from quarry.functions.text import (
    MISSING_MARKER,
    NA_MARKER,
    NONE_MARKER,
    NUMERIC_ATOL,
    NUMERIC_RTOL,
    bind,
    exact_mean,
    is_na,
    normalise_string,
    numeric_close,
    parse_numeric,
    py_strip,
)

# --------------------------------------------------------------------------
# Fixed values of the record domain (must equal the reference).
# --------------------------------------------------------------------------
LCA_INDICATORS = (
    "GWP-TOTAL", "GWP-FOSSIL", "GWP-BIOGENIC",
    "FRESH WATER", "ACIDIFICATION", "EUTROFICATION",
    "PERT", "PENRT", "PERE", "PERM", "PENRE", "PENRM",
)
LCA_STAGES = (
    "A1", "A2", "A3", "A1-A3",
    "A4", "A5", "A4-A5",
    "B1", "B2", "B3", "B4", "B5", "B6", "B7", "B1-B7",
    "C1", "C2", "C3", "C4", "C1-C4",
    "D", "Unit",
)
SKIP_FIELDS = ("_orig_index", "file_name", "_verify", "_quarantine_reason")
LCA_SKIP_STAGES = ("D1", "D2")
LIST_FIELDS = ("Standard List", "Tags List")
UNIT_KEY = "Unit"

LEAF_FIELDS = ("field", "category", "gold_value", "pred_value", "gold_is_na", "match")
SLICES = ("overall", "populated", "na", "metadata", "lca", "list")


@dataclass(frozen=True)
class ScoringSpec:
    """Which keys are indicators / lists / provenance, and numeric tolerances."""

    indicators: tuple[str, ...] = LCA_INDICATORS
    list_fields: tuple[str, ...] = LIST_FIELDS
    skip_fields: tuple[str, ...] = SKIP_FIELDS
    skip_stages: tuple[str, ...] = LCA_SKIP_STAGES
    unit_key: str = UNIT_KEY
    rtol: float = NUMERIC_RTOL
    atol: float = NUMERIC_ATOL
    either: bool = False  # accept the relative or the absolute tolerance, not their sum


# ---------------------------------------------------------------- joins

def latest_predictions(preds: DataFrame) -> DataFrame:
    """One prediction per ``file_name``, the one with the highest ``seq`` (equal ones: greatest body)."""
    # not max_by(body, ...), which sorts and moves two copies of each body
    return preds.groupBy("file_name").agg(F.max(F.struct("seq", "body"))["body"].alias("pred_body"))


def unmatched_predictions(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """Prediction names with no gold record (reported, never scored)."""
    names = preds.select("file_name").distinct()
    return names.join(gold.select("file_name"), "file_name", "left_anti")


def restrict_to_attempted(gold: DataFrame, attempted: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Keep gold records whose document was attempted (skips do not count).

    A name with very many gold records is joined over salts. ``names`` (one ``file_name``
    row per gold record) defaults to the gold set's own column, as in ``pair_records``.
    """
    counts = (gold if names is None else names).groupBy("file_name").agg(F.count(F.lit(1)).alias("_n"))
    wanted = materialise(counts.join(attempted.select("file_name").distinct(), "file_name", "left_semi"), "attempted-names")
    total = wanted.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return salted_join(gold, wanted, ["file_name"], [F.col("orig_index")], "_n", total).select(*gold.columns)


HOT_PARTS = 4096   # a name is hot when it holds more than 1/HOT_PARTS of all gold records ...
HOT_FLOOR = 1000   # ... and more than this many


def hot_names(names: DataFrame, parts: int = HOT_PARTS, floor: int = HOT_FLOOR) -> DataFrame:
    """(file_name, buckets): names to be spread, over one bucket per share of the records.

    ``names`` is the gold ``file_name`` column (one row per record). A share is
    ``max(total / parts, floor)`` records, so fewer than ``parts`` names can be hot: the
    result has a proven bound and may be broadcast, and no bucket holds more than about a share.
    """
    counts = names.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))
    share = F.greatest(counts.select(F.sum("n")).scalar() / F.lit(float(parts)), F.lit(float(floor)))
    return counts.where(F.col("n") > share).select("file_name", F.ceil(F.col("n") / share).cast("int").alias("buckets"))


def pair_records(gold: DataFrame, preds: DataFrame, names: DataFrame | None = None, parts: int = HOT_PARTS,
                 floor: int = HOT_FLOOR) -> DataFrame:
    """J1+J3: gold LEFT JOIN latest prediction on ``file_name``, salted for hot names.

    Gold duplicates each score against the same prediction; gold without a prediction is
    scored against ``{}``. Records of a hot name are dealt over its buckets by
    ``orig_index``, and that name's single prediction row is repeated once per bucket, so
    the tasks of a name grow with its rows. Other names keep salt 0. ``names`` (one
    ``file_name`` row per gold record) defaults to the gold set's own column;
    pass the key column of the stored table when ``gold`` is costly to derive. It is then counted
    too, and the records are dealt to one task per ``ROWS_PER_TASK``: well-packed JSON would be
    merged into a few tasks that each unpack and sort a hundred times that.
    """
    latest = latest_predictions(preds)
    hot = F.broadcast(hot_names(gold.select("file_name") if names is None else names, parts, floor))
    g = (gold.select("orig_index", "file_name", F.col("body").alias("gold_body"))
         .join(hot, "file_name", "left")
         .withColumn("salt", F.pmod(F.xxhash64("orig_index"), F.coalesce("buckets", F.lit(1))).cast("int"))
         .drop("buckets"))
    if names is not None:
        g = g.repartition(-(-names.count() // ROWS_PER_TASK) or 1, "file_name", "salt")
    p = (latest.join(hot, "file_name", "left")
         .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("buckets", F.lit(1)) - 1)))
         .drop("buckets"))
    return (g.join(p, ["file_name", "salt"], "left")
            .withColumn("has_prediction", F.col("pred_body").isNotNull()))


# ------------------------------------------------------------ leaf matching

def list_f1(gold_raw: Column, pred_raw: Column, pred_present: Column, gold_array: Column | None = None) -> Column:
    """P5: set-based F1 of two JSON-text lists (order-insensitive).

    Non-list gold counts as empty. A non-list prediction becomes a singleton
    unless it is falsy or N/A. Both empty -> 1.0. ``gold_array`` is the gold list where it is parsed already.
    """
    gold_list = F.coalesce(parse_array(gold_raw) if gold_array is None else gold_array, F.array().cast("array<string>"))
    pred_arr = parse_array(pred_raw)
    truthy = (pred_raw.isNotNull() & (pred_raw != "") & ~pred_raw.rlike(r"^\s*\{\s*\}\s*$")
              & ~is_na(pred_raw))
    pred_list = (F.when(~pred_present, F.array().cast("array<string>"))
                 .when(pred_arr.isNotNull(), pred_arr)
                 .when(truthy, F.array(pred_raw))
                 .otherwise(F.array().cast("array<string>")))

    def as_set(arr: Column) -> Column:
        return F.array_distinct(F.transform(arr, lambda x: normalise_string(F.coalesce(x, F.lit(NONE_MARKER)))))

    def score(sets: Column) -> Column:
        counts = F.struct(F.size(F.array_intersect(sets.g, sets.p)).cast("double").alias("tp"),
                          F.size(sets.g).alias("ng"), F.size(sets.p).alias("np"))

        def f1(c: Column) -> Column:
            pr = F.struct(F.when(c.np > 0, c.tp / c.np).otherwise(F.lit(0.0)).alias("p"),
                          F.when(c.ng > 0, c.tp / c.ng).otherwise(F.lit(0.0)).alias("r"))
            return F.when((c.ng == 0) & (c.np == 0), F.lit(1.0)).otherwise(bind(pr, lambda q: (
                F.when(q.p + q.r > 0, F.lit(2.0) * q.p * q.r / (q.p + q.r)).otherwise(F.lit(0.0)))))

        return bind(counts, f1)

    return bind(F.struct(as_set(gold_list).alias("g"), as_set(pred_list).alias("p")), score)


RAW_LEAF = ("struct<field:string,category:string,gold_value:string,pred_value:string,"
            "gold_raw:string,pred_raw:string,pred_present:boolean>")


def _raw(field: Column, category: Column | str, gold_v: Column, pred_v: Column,
         gold_raw: Column | None = None, pred_raw: Column | None = None,
         pred_present: Column | None = None) -> Column:
    cat = F.lit(category) if isinstance(category, str) else category
    none = F.lit(None).cast("string")
    return F.struct(field.alias("field"), cat.alias("category"), gold_v.alias("gold_value"),
                    pred_v.alias("pred_value"), (none if gold_raw is None else gold_raw).alias("gold_raw"),
                    (none if pred_raw is None else pred_raw).alias("pred_raw"),
                    (F.lit(None).cast("boolean") if pred_present is None else pred_present).alias("pred_present"))


def _lookup(m: Column, key: Column) -> Column:
    return F.when(F.map_contains_key(m, key), F.coalesce(m[key], F.lit(NONE_MARKER))).otherwise(F.lit(MISSING_MARKER))


def _shown(text: Column, body: Column | None, key: Column, bound: bool = True) -> Column:
    """A flat member as Python's ``str()`` shows it: JSON numbers and booleans by their type, where ``body`` is given."""
    if body is None:
        return text

    def show(t: Column) -> Column:
        return F.when(t.rlike(LOOKS_TYPED), python_text(typed_member(body, key), t)).otherwise(t)
    return bind(text, show) if bound else show(text)


def _list_text(text: Column, body: Column | None, key: Column, bound: bool = True) -> Column:
    """A predicted list member: what only looks like 0, false or {} is told apart by its type ("" is falsy)."""
    if body is None:
        return text
    is_text = F.schema_of_variant(typed_member(body, key)) == "STRING"
    return (F.when(text.rlike(LOOKS_FALSY), F.when(is_text, F.to_json(F.array(text))).otherwise(F.lit("")))
            .when(text.rlike(LOOKS_TYPED), _shown(text, body, key, bound)).otherwise(text))


def raw_leaves(gold_map: Column, pred_map: Column, spec: ScoringSpec = ScoringSpec(), gold_body: Column | None = None,
               pred_body: Column | None = None) -> Column:
    """N1 + P7-P9: gold-driven leaf texts (``field``, ``category``, gold, predicted).

    Each indicator's gold and predicted objects are parsed once (bound
    through a one-element array), never once per stage. With the bodies, flat values whose
    text could be a number or a boolean are shown by their JSON type.
    """
    empty = F.array().cast(f"array<{RAW_LEAF}>")
    skip_stages = list(spec.skip_stages)

    def indicator(e: Column) -> Column:
        bound = F.struct(parse_object(e.value).alias("g"),
                         F.coalesce(parse_object(pred_map[e.key]), empty_map()).alias("p"))

        def per_stage(b: Column) -> Column:
            stages = F.filter(F.map_entries(b.g), lambda s: ~s.key.isin(skip_stages))
            return F.transform(stages, lambda s: _raw(
                F.concat(e.key, F.lit("."), s.key),
                F.when(s.key == spec.unit_key, F.lit("lca_unit")).otherwise(F.lit("lca_numeric")),
                F.coalesce(s.value, F.lit(NONE_MARKER)), _lookup(b.p, s.key)))

        return F.coalesce(bind(bound, per_stage), empty)

    def listed(e: Column) -> Column:
        present = F.map_contains_key(pred_map, e.key)
        shown = F.when(present, F.coalesce(pred_map[e.key], F.lit(NONE_MARKER))).otherwise(F.lit("[]"))
        return F.array(_raw(e.key, "list", F.coalesce(e.value, F.lit(NONE_MARKER)), shown,
                            e.value, _list_text(pred_map[e.key], pred_body, e.key), present))

    def metadata(e: Column) -> Column:
        return F.array(_raw(e.key, "metadata", F.coalesce(_shown(e.value, gold_body, e.key), F.lit(NONE_MARKER)),
                            _shown(_lookup(pred_map, e.key), pred_body, e.key)))

    entries = F.filter(F.map_entries(gold_map), lambda e: ~e.key.isin(list(spec.skip_fields)))
    per_entry = F.transform(
        entries,
        lambda e: F.when(e.key.isin(list(spec.indicators)), indicator(e))
        .when(e.key.isin(list(spec.list_fields)), listed(e))
        .otherwise(metadata(e)),
    )
    return F.coalesce(F.flatten(per_entry), empty)


def _found(m: Column, key: Column) -> Column:
    """The text of a member, null where there is none."""
    return F.coalesce(m[key], F.when(F.map_contains_key(m, key), F.lit(NONE_MARKER)))


LIST_COLUMNS = ("gold_raw", "pred_raw", "pred_present", "list_match", "list_na")


def leaf_rows(records: DataFrame, gold_map: str, pred_map: str, spec: ScoringSpec = ScoringSpec(),
              gold_body: str | None = None, pred_body: str | None = None) -> DataFrame:
    """``raw_leaves`` as rows: each record's other columns with the fields of one leaf and, for a
    leaf of an indicator, ``gold_unit``, the text of that indicator's unit (null without one).

    Two explodes (members, then the stages of an indicator) keep the listing in compiled row
    expressions; all indicators of a record, gold and predicted, are parsed in one go. Lists are
    scored as members (``list_match``, ``list_na``), so that rows of stages carry no list. A member
    that gives no leaf (skipped, an indicator that is no object) stays as one row of null fields, so
    that every record keeps a row. The explodes are outer ones: Spark puts a filter before others
    that evaluates their input again.
    """
    used = {gold_map, pred_map, gold_body, pred_body}
    keep = [c for c in records.columns if c not in used]
    also = [c for c in (gold_body, pred_body) if c is not None]
    key, value, gm, pm = F.col("_key"), F.col("_value"), F.col(gold_map), F.col(pred_map)
    gb, pb = (None if c is None else F.col(c) for c in (gold_body, pred_body))
    names = list(spec.indicators)
    objects = with_objects(records.select(*keep, gold_map, pred_map, *also), [m[F.lit(k)] for m in (gm, pm) for k in names], "_objects")
    place = F.coalesce(F.array_position(F.array(*map(F.lit, names)), key), F.lit(0)).cast("int")  # from 1; 0: no indicator
    skipped, listed = key.isNull() | key.isin(list(spec.skip_fields)), key.isin(list(spec.list_fields))
    kind = F.when(skipped, F.lit(0)).when(place > 0, F.lit(1)).when(listed, F.lit(2)).otherwise(F.lit(3))
    members = objects.select(*keep, pred_map, *also, "_objects", F.explode_outer(gold_map).alias("_key", "_value")).select(
        *keep, pred_map, *also, "_objects", "_key", "_value", place.alias("_place"), kind.alias("_kind"),
        pm[key].alias("_text"), F.map_contains_key(pm, key).alias("_present"))
    text, present, place, kind = F.col("_text"), F.col("_present"), F.col("_place"), F.col("_kind")
    indicator, listed, flat = kind == 1, kind == 2, kind == 3
    each, typed = indicator & F.col("_objects").isNull(), f"{LOOKS_TYPED}|{LOOKS_FALSY}"
    # a row of a member holds what that member needs: not the other objects, a body only where a type is asked for
    members = members.select(
        *keep, "_key", "_kind", "_present", each.alias("_each"),
        F.when(~indicator | each, value).alias("_value"), F.when(~indicator | each, text).alias("_text"),
        *([] if gb is None else [F.when(flat & value.rlike(typed), gb).alias(gold_body)]),
        *([] if pb is None else [F.when((flat | listed) & text.rlike(typed), pb).alias(pred_body)]),
        F.when(indicator, F.get("_objects", place - 1)).alias("_g"),
        F.when(indicator, F.get("_objects", place + (len(names) - 1))).alias("_p"))
    found = F.when(present, F.coalesce(text, F.lit(NONE_MARKER)))
    members = members.select(
        "*", F.when(listed, F.coalesce(found, F.lit("[]"))).when(flat, F.coalesce(found, F.lit(MISSING_MARKER))).alias("_found"),
        F.when(listed, parse_array(value)).alias("_array"))
    shown, array = F.col("_found"), F.col("_array")
    pred_raw = _list_text(text, pb, key, bound=False)
    same = present & array.isNotNull() & F.coalesce(text == value, F.lit(False))
    members = members.select(
        *keep, "_key", "_kind", F.when(F.col("_each"), parse_object(value)).otherwise(F.col("_g")).alias("_g"),
        F.when(indicator, F.coalesce(F.when(F.col("_each"), parse_object(text)).otherwise(F.col("_p")), empty_map())).alias("_p"),
        F.when(listed, F.coalesce(value, F.lit(NONE_MARKER)))
        .when(flat, F.coalesce(_shown(value, gb, key, bound=False), F.lit(NONE_MARKER))).alias("_gold"),
        F.when(flat, _shown(shown, pb, key, bound=False)).otherwise(shown).alias("_pred"), F.when(listed, value).alias("gold_raw"),
        F.when(listed, pred_raw).alias("pred_raw"), F.when(listed, present).alias("pred_present"),
        F.when(listed & same, F.lit(1.0)).when(listed, list_f1(value, pred_raw, present, array)).alias("list_match"),
        F.when(listed, F.coalesce(F.size(array) == 0, F.lit(True))).alias("list_na"))
    stages = members.select(*keep, "_key", "_kind", "_p", "_gold", "_pred", *LIST_COLUMNS,
                            _found(F.col("_g"), F.lit(spec.unit_key)).alias("_unit"), F.explode_outer("_g").alias("_stage", "_value"))
    stage, p, leaf, other = F.col("_stage"), F.col("_p"), F.col("_leaf"), kind > 1
    stages = stages.select("*", ((kind == 1) & stage.isNotNull() & ~stage.isin(list(spec.skip_stages))).alias("_leaf"))
    predicted = F.coalesce(_found(p, stage), F.lit(MISSING_MARKER))
    return stages.select(
        *keep, F.when(leaf, F.concat(key, F.lit("."), stage)).when(other, key).alias("field"),
        F.when(leaf, F.when(stage == spec.unit_key, F.lit("lca_unit")).otherwise(F.lit("lca_numeric")))
        .when(kind == 2, F.lit("list")).when(kind == 3, F.lit("metadata")).alias("category"),
        F.when(leaf, F.coalesce(value, F.lit(NONE_MARKER))).otherwise(F.col("_gold")).alias("gold_value"),
        F.when(leaf, predicted).otherwise(F.col("_pred")).alias("pred_value"),
        *LIST_COLUMNS, F.when(leaf, F.col("_unit")).alias("gold_unit"))


def schema_valid(pred_map: Column, spec: ScoringSpec = ScoringSpec()) -> Column:
    """Every indicator present, each an object holding ``Unit``.

    Only key presence matters, so the object's keys are listed without
    building a map (duplicates do not change presence).
    """
    checks = [F.coalesce(F.array_contains(F.json_object_keys(pred_map[F.lit(k)]), F.lit(spec.unit_key)),
                         F.lit(False)) for k in spec.indicators]
    out = checks[0]
    for c in checks[1:]:
        out = out & c
    return out


def _slice_cond(name: str, leaf: Column) -> Column:
    return {
        "overall": F.lit(True),
        "populated": ~leaf.gold_is_na,
        "na": leaf.gold_is_na,
        "metadata": leaf.category == "metadata",
        "lca": leaf.category.isin("lca_numeric", "lca_unit"),
        "list": leaf.category == "list",
    }[name]


def f1_from_stats(st: Column, s: str) -> Column:
    """A1: micro F1 of one slice (TP = match, FP = FN = 1 - match); empty -> 0.0.

    Whole matches are counted exactly and only fractional matches summed, so
    the result does not depend on the order the leaves are visited.
    """
    tp = st[f"one_{s}"].cast("double") + st[f"fs_{s}"]
    fp = st[f"zero_{s}"].cast("double") + st[f"fc_{s}"]
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    return (F.when(st[f"n_{s}"] == 0, F.lit(0.0))
            .when(p + p == 0, F.lit(0.0))
            .otherwise(F.lit(2.0) * p * p / (p + p)))


def _paired_maps(paired: DataFrame, spec: ScoringSpec) -> DataFrame:
    """Parse both bodies once per record; validity needs only the prediction."""
    def deduped(c: str) -> Column:  # lambdas only where a key repeats
        return F.when(has_distinct_keys(F.col(c)), F.col(c)).otherwise(dedupe_keys(F.col(c)))

    return paired.select(
        "orig_index", "file_name", "salt", "has_prediction", "gold_body", "pred_body",
        object_map(F.col("gold_body")).alias("_gm"), object_map(F.col("pred_body")).alias("_pm"),
    ).select(
        "orig_index", "file_name", "salt", "has_prediction", "gold_body", "pred_body",
        deduped("_gm").alias("gm"), F.coalesce(deduped("_pm"), empty_map()).alias("pm"),
    ).select("orig_index", "file_name", "salt", "has_prediction",
             schema_valid(F.col("pm"), spec).alias("schema_valid"), "gm", "pm", "gold_body", "pred_body")


def typed_leaves(raw: DataFrame, spec: ScoringSpec = ScoringSpec()) -> DataFrame:
    """P1-P6 as row-level (codegen) expressions over exploded raw leaves.

    Parsed numbers are staged as columns first, so each value is parsed once
    however many branches test it. Identical texts need no parsing unless the gold one could be
    NaN or infinite: those have an ``n``, an exponent or hundreds of digits.
    """
    numeric, gold_text = F.col("category") == "lca_numeric", F.col("gold_value")
    differs = ~F.coalesce(F.col("pred_value") == gold_text, F.lit(False))
    odd = F.length(gold_text) > 300
    for letter in "eEnN":
        odd = odd | gold_text.contains(letter)
    odd = odd & (gold_text != NA_MARKER)
    parsed = numeric & (differs | odd)
    staged = raw.select("*", F.when(parsed, parse_numeric(gold_text)).alias("_g"),
                        F.when(parsed, parse_numeric(F.col("pred_value"))).alias("_p"))
    is_list = F.col("category") == "list"
    if "list_match" in raw.columns:
        list_match, list_na = F.col("list_match"), F.col("list_na")
    else:
        list_match = list_f1(F.col("gold_raw"), F.col("pred_raw"), F.col("pred_present"))
        list_na = F.coalesce(F.size(parse_array(F.col("gold_raw"))) == 0, F.lit(True))
    gold_v, pred_v, g, p = F.col("gold_value"), F.col("pred_value"), F.col("_g"), F.col("_p")
    # Identical text matches without folding, except numbers that parse to NaN or infinity
    # (also by overflow), which never equal themselves under the tolerance test.
    finite = g.isNull() | (F.abs(g) < F.lit(float("inf")))
    same = (pred_v == gold_v) & (~numeric | (finite & ~F.coalesce(F.isnan(g), F.lit(False))))
    match = (F.when(F.col("category").isNull(), F.lit(None).cast("double"))
             .when(is_list, list_match)
             .when(same, F.lit(1.0))
             .when(g.isNotNull() & p.isNotNull(),
                   numeric_close(p, g, spec.rtol, spec.atol, bound=False, either=spec.either).cast("double"))
             .otherwise((normalise_string(pred_v, bound=False)
                         == normalise_string(gold_v, bound=False)).cast("double")))
    gold_is_na = F.when(is_list, list_na).otherwise(is_na(gold_v))
    keep = [c for c in raw.columns if c not in (*LIST_COLUMNS, "gold_unit")]
    return staged.select(*keep, gold_is_na.alias("gold_is_na"), match.alias("match"))


def _leaf_rows(gold: DataFrame, preds: DataFrame, spec: ScoringSpec, names: DataFrame | None = None) -> DataFrame:
    maps = _paired_maps(pair_records(gold, preds, names=names), spec)
    raw = leaf_rows(maps, "gm", "pm", spec, "gold_body", "pred_body")
    return typed_leaves(raw, spec)


def _slice_aggs(s: str) -> list[Column]:
    leaf = F.struct(F.col("category").alias("category"), F.col("gold_is_na").alias("gold_is_na"))
    c = _slice_cond(s, leaf) & F.col("match").isNotNull()
    m = F.col("match")
    frac = (m > 0) & (m < 1)
    return [F.count_if(c).alias(f"n_{s}"), F.count_if(c & (m == 1.0)).alias(f"one_{s}"),
            F.count_if(c & (m == 0.0)).alias(f"zero_{s}"),
            F.coalesce(F.sum(F.when(c & frac, m)), F.lit(0.0)).alias(f"fs_{s}"),
            F.coalesce(F.sum(F.when(c & frac, F.lit(1.0) - m)), F.lit(0.0)).alias(f"fc_{s}")]


def score_records(gold: DataFrame, preds: DataFrame, spec: ScoringSpec = ScoringSpec(),
                  names: DataFrame | None = None) -> DataFrame:
    """M5/A2: one row per gold record with the six F1 slices and validity.

    ``orig_index`` must be unique per gold record (it is the record key).

    Leaves are generated per record and matched with row-level expressions;
    the per-record aggregate groups by ``(file_name, salt)`` first, which the
    join already partitioned on, so it adds no exchange after a sort-merge join.
    """
    leaves = _leaf_rows(gold, preds, spec, names)
    stats = leaves.groupBy("file_name", "salt", "orig_index", "schema_valid", "has_prediction").agg(
        *[a for s in SLICES for a in _slice_aggs(s)])
    st = F.struct(*[F.col(c) for c in stats.columns if c[:2] in ("n_", "on", "ze", "fs", "fc")])
    return stats.select(
        "orig_index", "file_name", "schema_valid", "has_prediction",
        F.col("n_overall").cast("bigint").alias("n_fields"),
        *[f1_from_stats(st, s).alias(f"f1_{s}") for s in SLICES])


def field_scores(gold: DataFrame, preds: DataFrame, spec: ScoringSpec = ScoringSpec(),
                 names: DataFrame | None = None) -> DataFrame:
    """M4: the FieldScore fact table, one row per scored leaf."""
    return _leaf_rows(gold, preds, spec, names).where(F.col("field").isNotNull()).select(
        "orig_index", "file_name", *LEAF_FIELDS)


def summary_row(record_scores: DataFrame, model: Column | str, cost_usd: Column | float = 0.0,
                latency_s: Column | float = 0.0) -> DataFrame:
    """A3-A5: dataset macro means (fixed-point, order-independent), schema-valid percent, cost and latency.

    ``cost_usd``/``latency_s`` are dataset totals supplied by the caller.
    Divisions are guarded so an empty score set yields zeros.
    """
    n = F.count(F.lit(1))
    cost = F.lit(cost_usd) if isinstance(cost_usd, (int, float)) else cost_usd
    lat = F.lit(latency_s) if isinstance(latency_s, (int, float)) else latency_s
    means = [F.coalesce(exact_mean(F.col(f"f1_{s}")), F.lit(0.0)).alias(f"f1_{s}")
             for s in ("overall", "populated", "na", "metadata", "lca")]
    out = record_scores.agg(
        n.alias("n_records"), *means,
        F.coalesce(F.count_if("schema_valid") * 100.0 / F.nullif(n, F.lit(0)), F.lit(0.0))
        .alias("schema_valid_pct"),
    )
    return out.select(
        (F.lit(model) if isinstance(model, str) else model).alias("model"),
        F.col("n_records").cast("bigint").alias("n_records"),
        *[f"f1_{s}" for s in ("overall", "populated", "na", "metadata", "lca")],
        "schema_valid_pct",
        cost.cast("double").alias("cost_usd_total"),
        F.coalesce(F.try_divide(cost.cast("double"), F.col("n_records")), F.lit(0.0)).alias("cost_usd_per_record"),
        lat.cast("double").alias("latency_s_total"),
        F.coalesce(F.try_divide(lat.cast("double"), F.col("n_records")), F.lit(0.0)).alias("latency_s_per_record"),
    )


def score_report(record_scores: DataFrame) -> DataFrame:
    """Per-record rows plus one AVERAGE row (``schema_ok`` as 'k/n', index -1)."""
    cols = ["f1_overall", "f1_populated", "f1_na", "f1_metadata", "f1_lca"]
    detail = record_scores.select(
        F.lit("record").alias("row_kind"),
        F.coalesce(F.nullif(F.col("file_name"), F.lit("")), F.col("orig_index").cast("string")).alias("label"),
        F.col("orig_index"), *cols,
        F.when(F.col("schema_valid"), F.lit("yes")).otherwise(F.lit("no")).alias("schema_ok"),
    )
    total = record_scores.agg(
        *[exact_mean(F.col(c)).alias(c) for c in cols],
        F.count_if("schema_valid").alias("k"), F.count(F.lit(1)).alias("n"),
    ).select(
        F.lit("average").alias("row_kind"), F.lit("AVERAGE").alias("label"),
        F.lit(-1).cast("bigint").alias("orig_index"), *cols,
        F.concat(F.col("k").cast("string"), F.lit("/"), F.col("n").cast("string")).alias("schema_ok"),
    )
    return detail.unionByName(total)


def scores_export(record_scores: DataFrame, model: str | Column) -> DataFrame:
    """S8 projection: the per-record CSV columns (unrounded; round at presentation, T7)."""
    return record_scores.select(
        (F.lit(model) if isinstance(model, str) else model).alias("model"), "file_name", "orig_index",
        "f1_overall", "f1_populated", "f1_na", "f1_metadata", "f1_lca", "schema_valid")


__all__ = [
    "LCA_INDICATORS", "LCA_STAGES", "LIST_FIELDS", "SKIP_FIELDS", "LCA_SKIP_STAGES",
    "ScoringSpec", "hot_names", "latest_predictions", "unmatched_predictions", "restrict_to_attempted",
    "pair_records", "raw_leaves", "leaf_rows", "typed_leaves", "schema_valid", "f1_from_stats", "score_records",
    "field_scores", "summary_row", "score_report", "scores_export", "list_f1", "py_strip",
]


def flatten_leaves(body_map: Column, spec: ScoringSpec = ScoringSpec()) -> Column:
    """All leaf paths of one record (``field`` or ``indicator.stage``) -> raw value text."""
    entries = F.filter(F.map_entries(body_map), lambda e: ~e.key.isin(list(spec.skip_fields)))

    def expand(e: Column) -> Column:
        inner = parse_object(e.value)
        nested = F.transform(F.map_entries(inner), lambda s: F.struct(
            F.concat(e.key, F.lit("."), s.key).alias("key"), s.value.alias("value")))
        return F.when(e.key.isin(list(spec.indicators)) & inner.isNotNull(), nested).otherwise(
            F.array(F.struct(e.key.alias("key"), e.value.alias("value"))))

    return F.map_from_entries(F.flatten(F.transform(entries, expand)))


def neighbours(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], value: str) -> DataFrame:
    """``by``, ``pass`` (from 1, in ``order``), ``value`` and ``_before``, the value one pass earlier.

    Rows are sorted by range over files. Neighbours meet inside their file; a file's first
    row gets the last row of the file before it (one row per file). A key with very many rows
    spans several files, so it is never gathered.
    """
    keep = list(dict.fromkeys((*by, *order, value)))
    ranked = sorted_rows(rows.select(*keep), [*by, *order], "passes-sorted")
    inside = Window.partitionBy("_file").orderBy("_row")
    prior = F.lag(F.struct(*by, F.col(value).alias("_value"))).over(inside)
    lagged = ranked.withColumn("_prior", prior)
    ends = ranked.groupBy("_file").agg(F.max_by(F.struct(*by, F.col(value).alias("_value")), "_row").alias("_last"))
    border = ends.select("_file", F.lag("_last").over(Window.orderBy(F.length("_file"), "_file")).alias("_border"))
    met = (lagged.join(border, "_file")
           .withColumn("_prior", F.when(F.col("_row") == 0, F.col("_border")).otherwise(F.col("_prior"))))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col("_prior")[c])
    first = ranked.groupBy(*by).agg(F.min("rank").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    after = met.where(F.col("_prior").isNotNull() & same)
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_k{i}") for i, c in enumerate(by)] + [
        F.concat_ws("", *[F.col(c).isNull().cast("string") for c in by]).alias("_nulls")]  # null keys join too
    names = [f"_k{i}" for i in range(len(by))] + ["_nulls"]
    total = first.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    numbered = salted_join(after.select("*", *keys), first.select(*keys, "_first", "_n"), names, [F.col("rank")], "_n", total)
    return numbered.select(*by, (F.col("rank") - F.col("_first") + 1).alias("pass"), value, F.col("_prior._value").alias("_before"))


def pass_divergence(preds: DataFrame, spec: ScoringSpec = ScoringSpec(), by: tuple[str, ...] = ("file_name",)) -> DataFrame:
    """Documents extracted several times: share of leaf paths whose values differ between
    each pass and the one before it (neighbours in ``seq``, not all pairs).

    ``by`` names the key of a repeated extraction, such as (file_name, product). ``pass`` counts
    from the key's first pass, so the first row is pass 2.
    """
    j = neighbours(preds, by, ("seq", "body"), "body").where(F.col("_before").isNotNull()).select(
        *by, F.col("pass").cast("bigint").alias("pass"), flatten_leaves(parse_object(F.col("body")), spec).alias("a"),
        flatten_leaves(parse_object(F.col("_before")), spec).alias("b"))
    keys = F.array_union(F.map_keys("a"), F.map_keys("b"))
    diff = F.filter(keys, lambda k: ~(F.map_contains_key("a", k) & F.map_contains_key("b", k)
                                      & F.col("a")[k].eqNullSafe(F.col("b")[k])))
    return j.select(*by, "pass", F.size(keys).cast("bigint").alias("n_paths"),
                    F.size(diff).cast("bigint").alias("n_diff"),
                    F.try_divide(F.size(diff).cast("double"), F.size(keys)).alias("divergence"))

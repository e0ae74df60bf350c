"""Prompt assembly, model hook and response parsing as DataFrame operations.

The model itself is a user-supplied callable run through ``mapInArrow``
(built once per partition); everything around it — field discovery, prompt
text, chat messages, JSON extraction — is expressions over columns.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.skew import materialise, salted_join, sorted_rows, text_batches
from quarry.functions.text import strict_json_object
from quarry.operators.scoring import LCA_INDICATORS, LCA_STAGES, SKIP_FIELDS

# --------------------------------------------------------------------------
# The extraction prompt and system message (must equal the reference).
# --------------------------------------------------------------------------
SYSTEM_PROMPT = ("You are an expert EPD data extraction assistant. "
                 "Extract structured data from EPD documents and return valid JSON only.")
PROMPT_HEAD = ("Extract all fields from the EPD document below.\n\n"
               "Return a JSON object with EXACTLY these flat string fields "
               "(use \"N/A\" for any field not found in the document):\n")
PROMPT_INDICATORS = "Also include these 12 nested LCA indicator objects ("
PROMPT_STAGES = "),\neach containing lifecycle stage keys: "
PROMPT_STAGE_NOTE = ("\n(use \"N/A\" for stages not reported; Unit should be the exact string "
                     "from the document).\n\n")
PROMPT_DOC = "EPD DOCUMENT:\n"
PROMPT_TABLES = "\n\nTABLE DATA:\n"
PROMPT_TAIL = "\n\nRespond with ONLY the JSON object, no markdown fences or explanation."
NO_TABLES = "(no tables extracted)"
GROUP_INDICATORS = "Extract these nested LCA indicator objects from the EPD passages below ("
NO_PASSAGES = "(no passage found)"
FENCE_PATTERN = r"```(?:json)?\s*(\{[\s\S]*?\})\s*```"
MOST_SALTS, ROWS_PER_SALT = 4_096, 500
PROMPTS_PER_BATCH = 256
BRACES_PATTERN = r"\{[\s\S]*\}"


def flat_fields(gold: DataFrame, indicators: tuple[str, ...] = LCA_INDICATORS,
                skip: tuple[str, ...] = SKIP_FIELDS) -> DataFrame:
    """Distinct flat field names in first-seen order (record, then key position).

    Only the keys of a body are read. One partial aggregation per field name gives its first
    place; ranks are places in the names' range-sorted files, so no window runs over them all.
    """
    names = F.array_distinct(F.json_object_keys("body"))
    keys = gold.select("orig_index", F.posexplode(names).alias("pos", "field"))
    keys = keys.where(~F.col("field").isin(list(skip) + list(indicators)))
    first = keys.groupBy("field").agg(F.min(F.struct("orig_index", "pos")).alias("first")).select(
        "field", F.col("first.orig_index").alias("first_index"), F.col("first.pos").cast("bigint").alias("first_pos"))
    ranked = sorted_rows(first, ["first_index", "first_pos", "field"], "field-order")
    return ranked.select("field", "first_index", "first_pos", (F.col("rank") + 1).alias("rank"))


def with_value(rows: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``one``, a table of a single row.

    The row is repeated over salts, one per share of ``rows``, which are dealt over them by
    ``key``. It is written, so the planner knows its size and may broadcast it instead.
    """
    salts = max(1, min(MOST_SALTS, rows.count() // ROWS_PER_SALT))
    copies = materialise(one.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")), "single-row")
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    return dealt.join(copies, "_salt").drop("_salt")


def with_field_block(docs: DataFrame, fields: DataFrame, key: str, descriptions: Column | None = None) -> DataFrame:
    """``docs`` with ``fields_block``, the lines of all ``fields`` (rank, field) in order.

    A prompt names every field, so the block is as long as the schema is wide.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "field"))), lambda x: x.field)
    return with_value(docs, fields.agg(field_block(ordered, descriptions).alias("fields_block")), key)


def field_block(fields: Column, descriptions: Column | None = None) -> Column:
    """The ``{ "field": "..." }`` block from an ordered array of names.

    D38: with a ``descriptions`` map, each line carries ``  // description``.
    """
    def line(f: Column) -> Column:
        base = F.concat(F.lit('  "'), f, F.lit('": "..."'))
        if descriptions is None:
            return base
        d = descriptions[f]
        return F.when(d.isNull(), base).otherwise(F.concat(base, F.lit("  // "), d))
    lines = F.transform(fields, line)
    return F.concat(F.lit("{\n"), F.array_join(lines, "\n"), F.lit("\n}\n\n"))


def spread_hash(number: Column) -> Column:
    """Whole numbers scattered over [0, 2**32) by a fixed odd factor."""
    return F.pmod(number * F.lit(2654435761), F.lit(4294967296))


def draw_examples(docs: DataFrame, pool: DataFrame, key: str, k: int = 2) -> DataFrame:
    """(key, place, example): ``k`` examples of ``pool`` for every document, never itself.

    The pool is put in a scattered order and ranked, however large it is. A document starts
    at a place of its own and takes the next k + 1 ranks, round the end, of which itself drops
    out; so it has k examples wherever the pool has so many, and all examples are used alike.
    Ids are whole numbers, distinct in ``pool``.
    """
    order = [spread_hash(F.col(key)), F.col(key)]
    ranked = materialise(sorted_rows(pool.select(key), order, "example-order").select(F.col(key).alias("example"), "rank"),
                         "example-ranks")
    size, total = ranked.count(), docs.count()
    if size == 0:
        return docs.select(key, F.lit(0).alias("place"), F.col(key).alias("example")).limit(0)
    ahead = F.explode(F.sequence(F.lit(0), F.lit(min(k + 1, size) - 1))).alias("place")
    start = F.pmod(spread_hash(F.col(key) + F.lit(7)), F.lit(size))
    wanted = docs.select(key, ahead, start.alias("_start")).select(key, "place", F.pmod(F.col("_start") + F.col("place"), F.lit(size)).alias("rank"))
    per_rank = wanted.groupBy("rank").agg(F.count(F.lit(1)).alias("_n"))
    met = salted_join(wanted, ranked.join(per_rank, "rank"), ["rank"], [F.col(key)], "_n", total * (k + 1))
    # of k + 1 ranks in a row the document itself is at most one
    mine = Window.partitionBy(key).orderBy("place")
    return (met.where(F.col("example") != F.col(key)).withColumn("place", F.row_number().over(mine))
            .where(F.col("place") <= k).select(key, "place", "example"))


def example_block(docs: DataFrame, picks: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, example_ids, examples): the drawn examples' texts, in order, as one block; empty without examples.

    An example that many documents have drawn is joined over salts.
    """
    often = picks.groupBy("example").agg(F.count(F.lit(1)).alias("_n"))
    total = often.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    right = texts.select(F.col(key).alias("example"), F.col(text).alias("_text")).join(often, "example")
    met = salted_join(picks, right, ["example"], [F.col(key)], "_n", total).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("place", "example", "_text"))).alias("_picks"))
    every = docs.select(key).join(met, key, "left")
    block = F.array_join(F.transform("_picks", lambda e: F.concat(F.lit("EXAMPLE DOCUMENT:\n"), e["_text"], F.lit("\n\n"))), "")
    return every.select(key, F.coalesce(F.transform("_picks", lambda e: e["example"]), F.array().cast("array<bigint>")).alias("example_ids"),
                        F.coalesce(block, F.lit("")).alias("examples"))


def tables_block(tables: Column) -> Column:
    """Non-blank table markdown joined by blank lines; an empty list gives the placeholder."""
    md = F.filter(F.transform(tables, lambda t: t.markdown), lambda m: m.isNotNull() & (m != ""))
    return F.when(tables.isNull() | (F.size(tables) == 0), F.lit(NO_TABLES)).otherwise(F.array_join(md, "\n\n"))


def build_prompt(fields_block: Column, text: Column, tables: Column,
                 indicators: tuple[str, ...] = LCA_INDICATORS, stages: tuple[str, ...] = LCA_STAGES) -> Column:
    """The extraction prompt for one document (``fields_block`` from ``field_block``)."""
    return F.concat(
        F.lit(PROMPT_HEAD), fields_block,
        F.lit(PROMPT_INDICATORS + ", ".join(sorted(indicators)) + PROMPT_STAGES + ", ".join(stages)
              + PROMPT_STAGE_NOTE + PROMPT_DOC),
        text, F.lit(PROMPT_TABLES), tables_block(tables), F.lit(PROMPT_TAIL))


def build_group_prompt(kind: Column, names: Column, passages: Column, tables: Column,
                       stages: tuple[str, ...] = LCA_STAGES) -> Column:
    """The prompt for one group of names over its passages (``kind`` is fields or indicators)."""
    flat = F.concat(F.lit(PROMPT_HEAD), field_block(names))
    nested = F.concat(F.lit(GROUP_INDICATORS), F.array_join(names, ", "), F.lit(PROMPT_STAGES + ", ".join(stages) + PROMPT_STAGE_NOTE))
    return F.concat(F.when(kind == "fields", flat).otherwise(nested), F.lit(PROMPT_DOC),
                    F.when(passages == "", F.lit(NO_PASSAGES)).otherwise(passages),
                    F.lit(PROMPT_TABLES), tables_block(tables), F.lit(PROMPT_TAIL))


def chat_messages(prompt: Column) -> Column:
    """``[{role, content}]`` — system instruction then the user prompt."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")),
                   F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def parse_responses(responses: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """P24 + P25 + S11: parsed record (``{}`` on failure) beside the raw text.

    The two candidates and their strict checks are staged as columns so each
    regex and JSON parse runs once per row.
    """
    staged = (responses
              .withColumn("_fenced", F.regexp_extract(F.col(text_col), FENCE_PATTERN, 1))
              .withColumn("_braces", F.regexp_extract(F.col(text_col), BRACES_PATTERN, 0)))
    checked = (staged
               .withColumn("_ok1", (F.col("_fenced") != "") & strict_json_object(F.col("_fenced")))
               .withColumn("_ok2", ~F.col("_ok1") & (F.col("_braces") != "") & strict_json_object(F.col("_braces"))))
    out = checked.select(
        *responses.columns,
        F.when(F.col("_ok1"), F.lit("fenced")).when(F.col("_ok2"), F.lit("braces")).otherwise(F.lit("none"))
        .alias("rule"),
        F.when(F.col("_ok1"), F.col("_fenced")).when(F.col("_ok2"), F.col("_braces")).otherwise(F.lit("{}"))
        .alias("parsed"))
    return out


def short_model_name(model: Column, mode: str = "zero-shot") -> Column:
    """Last path part, lower-cased, ``-instruct`` dropped, mode appended."""
    base = F.replace(F.lower(F.element_at(F.split(model, "/"), -1)), F.lit("-instruct"), F.lit(""))
    return F.concat(base, F.lit(f"-{mode}"))


def run_extractor(df: DataFrame, prompt_col: str, key_col: str,
                  make_model: Callable[[], Callable[[str], str]]) -> DataFrame:
    """user-supplied model over prompts; returns ``key, raw_text, seconds``.

    The model is constructed once per partition; Arrow batches of ``PROMPTS_PER_BATCH`` whole
    prompts bound memory, and a prompt's row is read without unpacking its batch.
    Generation is not repeatable, so callers should persist the result
    (checkpoint or table) before scoring it.
    """
    src = df.select(F.col(key_col).alias("key"), F.col(prompt_col).alias("prompt"))
    key_type = src.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for b in batches:
            texts, secs = [], []
            for p in b.column("prompt"):
                prompt = p.as_py()
                t0 = time.perf_counter()
                texts.append(model(prompt))
                secs.append(time.perf_counter() - t0)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(texts, pa.string()), pa.array(secs, pa.float64())],
                                             names=["key", "raw_text", "seconds"])

    return text_batches(src, PROMPTS_PER_BATCH).mapInArrow(run, f"key {key_type}, raw_text string, seconds double")


# ``run_extractor`` runs inside Python workers: ship this module's code by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Named queries: ``(spark, sf_dir) -> DataFrame`` over the driver tables.

Each query reads whole tables (or data Spark derives from them) and returns
an un-collected DataFrame whose column names equal the SQL oracle's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.records import empty_map, parse_object
from quarry.functions.skew import exact_quantiles, materialise, salted_join
from quarry.functions.text import bind, exact_mean, is_na, normalise_string, parse_numeric
from quarry.operators import chunking, convert, corpus, curation, ledger, prompts, retrieval, scoring
from quarry.plans import fixtures as fx
from quarry.session import shared_dir
from quarry.sources import readers, sinks
from quarry.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# ------------------------------------------------------------------ scoring

def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_records(fx.gold_records(spark, sf), fx.pred_records(spark, sf), fx.FIXTURE_SPEC,
                                 names=fx.gold_names(spark, sf))


@register("score_summary")
def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A3-A5 over J1 + N1 + P1-P9 + A1-A2: the flagship evaluation row."""
    return scoring.summary_row(_scored(spark, sf), "fixture-model")


@register("score_records")
def score_records(spark: SparkSession, sf: str) -> DataFrame:
    """M5/A2: per-record F1 slices, schema validity."""
    return _scored(spark, sf)


@register("score_leaves")
def score_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """M4: FieldScore fact table."""
    return scoring.field_scores(fx.gold_records(spark, sf), fx.pred_records(spark, sf), fx.FIXTURE_SPEC,
                                names=fx.gold_names(spark, sf))


@register("score_report")
def score_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per-record rows plus the AVERAGE row."""
    return scoring.score_report(materialise(_scored(spark, sf), "record-scores"))


@register("unmatched_predictions")
def unmatched_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions whose name has no gold record."""
    return scoring.unmatched_predictions(fx.gold_records(spark, sf), fx.pred_records(spark, sf))


@register("attempted_summary")
def attempted_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Score only gold records whose document was attempted."""
    preds = fx.pred_records(spark, sf)
    gold = scoring.restrict_to_attempted(fx.gold_records(spark, sf), preds, fx.gold_names(spark, sf))
    # hot-name statistics from the full key column (salting only moves work, never changes results)
    rec = scoring.score_records(gold, preds, fx.FIXTURE_SPEC, names=fx.gold_names(spark, sf))
    return rec.agg(F.count(F.lit(1)).cast("bigint").alias("n_records"),
                   *[exact_mean(F.col(f"f1_{s}")).alias(f"f1_{s}") for s in scoring.SLICES])


# ----------------------------------------------------------------- curation


def _normalised(spark: SparkSession, sf: str) -> DataFrame:
    return curation.normalise_records(fx.variant_records(spark, sf))


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    reasons, clean = fx.decisions(spark, sf)
    return curation.manifest(_normalised(spark, sf), reasons, clean)


@register("variant_counts")
def variant_counts(spark: SparkSession, sf: str) -> DataFrame:
    """P10 + A9: records per schema variant, zero rows included."""
    return curation.count_rows_by(_normalised(spark, sf), "variant", curation.VARIANTS)


@register("normalised_fields")
def normalised_fields(spark: SparkSession, sf: str) -> DataFrame:
    """P11 + J9: canonical keys after renaming, first occurrence wins (long form)."""
    recs = fx.variant_records(spark, sf).select("orig_index", parse_object(F.col("body")).alias("m"))
    recs = recs.withColumn("variant", curation.detect_variant(F.col("m")))
    ent = recs.select("orig_index", F.inline(curation.renamed_entries(F.col("m"), F.col("variant"))))
    return ent.select("orig_index", F.col("pos").cast("bigint").alias("pos"), "key", "source_key", "value")


@register("field_presence")
def field_presence(spark: SparkSession, sf: str) -> DataFrame:
    """Raw key presence counts and the all-records flag."""
    return curation.field_presence(fx.variant_records(spark, sf))


@register("field_coverage")
def field_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """The 12 canonical indicators' coverage after normalising."""
    return curation.coverage(_normalised(spark, sf))


@register("gold_manifest")
def gold_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """J8 + P13 + P14 + U2: manifest rows for clean and quarantined records."""
    return _manifest(spark, sf)


@register("quarantine_breakdown")
def quarantine_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """A10: quarantined records per reason code."""
    m = _manifest(spark, sf).where(F.col("bucket") == "QUARANTINE")
    return m.groupBy("notes").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("clean_subkeys")
def clean_subkeys(spark: SparkSession, sf: str) -> DataFrame:
    """P12 + S6: indicator sub-keys left in the clean bucket after stripping."""
    norm = _normalised(spark, sf)
    clean, _ = curation.split_buckets(norm, _manifest(spark, sf))
    m = parse_object(F.col("body"))
    ind = clean.select("orig_index", F.explode(F.map_filter(m, lambda k, v: k.isin(list(curation.LCA_INDICATORS))))
                       .alias("indicator", "raw"))
    return ind.select("orig_index", "indicator", F.explode(F.map_keys(parse_object(F.col("raw")))).alias("subkey"))


@register("bre_agg_records")
def bre_agg_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose GWP-TOTAL.A1 is the aggregated-stage marker AGG."""
    # written first: a filter on a body is pushed below its making, which then runs once per reference
    norm = materialise(_normalised(spark, sf), "normalised-records")
    m = parse_object(F.col("body"))
    a1 = bind(m[F.lit("GWP-TOTAL")], lambda g: parse_object(g)[F.lit("A1")])
    df = norm.where(F.coalesce(a1 == "AGG", F.lit(False)))
    shown = [F.coalesce(m[F.lit(k)], F.lit("{}")).alias(k.lower().replace("-", "_").replace(" ", "_"))
             for k in curation.SHOWN_INDICATORS]
    return df.select("orig_index", "file_name", *shown)


@register("record_listing")
def record_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Index, name and a 70-character preview of GWP-TOTAL (EMPTY when absent)."""
    m = parse_object(F.col("body"))
    g = m[F.lit("GWP-TOTAL")]
    preview = F.when(g.isNull() | g.rlike(r"^\s*\{\s*\}\s*$") | (g == ""), F.lit("EMPTY")).otherwise(F.substring(g, 1, 70))
    return _normalised(spark, sf).select("orig_index", "file_name", preview.alias("gwp_preview"))


@register("record_file_names")
def record_file_names(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct non-empty file names of a record set."""
    return fx.variant_records(spark, sf).where(F.col("file_name") != "").select("file_name").distinct()


@register("contamination")
def contamination(spark: SparkSession, sf: str) -> DataFrame:
    """Records with sentence-like or padded keys."""
    bad = curation.contaminated_keys(parse_object(F.col("body")))
    return (fx.variant_records(spark, sf).select("orig_index", F.size(bad).cast("bigint").alias("n_bad_keys"))
            .where(F.col("n_bad_keys") > 0))


@register("fill_ratio")
def fill_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Share of populated (non-N/A) leaves per normalised record."""
    return curation.fill_ratio(_normalised(spark, sf))


@register("multi_product")
def multi_product(spark: SparkSession, sf: str) -> DataFrame:
    """Documents holding more than one product."""
    m = parse_object(F.col("body"))
    df = _normalised(spark, sf).select("file_name", m[F.lit("Product Name")].alias("product"))
    return df.groupBy("file_name").agg(F.count(F.lit(1)).cast("bigint").alias("n_records"),
                                       F.countDistinct("product").cast("bigint").alias("n_products")) \
        .where(F.col("n_products") > 1)


@register("operator_rollup")
def operator_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Records per programme operator, spelling variants folded."""
    m = parse_object(F.col("body"))
    op = F.upper(F.trim(m[F.lit("EPD Certification Body /Publisher/Program operator")]))
    return _normalised(spark, sf).groupBy(op.alias("operator")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("standard_version")
def standard_version(spark: SparkSession, sf: str) -> DataFrame:
    """EN 15804 amendment (+A1 / +A2) detected from the standard list."""
    m = parse_object(F.col("body"))
    std = F.coalesce(F.from_json(m[F.lit("Standard List")], "array<string>"), F.array().cast("array<string>"))
    version = (F.when(F.exists(std, lambda s: s.rlike(r"15804\s*\+\s*A2")), F.lit("A2"))
               .when(F.exists(std, lambda s: s.rlike(r"15804\s*\+\s*A1")), F.lit("A1"))
               .otherwise(F.lit("unknown")))
    return _normalised(spark, sf).groupBy(version.alias("version")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("sum_consistency")
def sum_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """A1-A3 against A1 + A2 + A3 within tolerance, for every indicator reported."""
    return curation.sum_consistency(_normalised(spark, sf))


@register("sci_notation")
def sci_notation(spark: SparkSession, sf: str) -> DataFrame:
    """Value classes of every indicator and stage."""
    return curation.notation_classes(_normalised(spark, sf))


# ------------------------------------------------------------------- corpus


def _profile(spark: SparkSession, sf: str, detect: bool = True) -> DataFrame:
    return corpus.profile(fx.doc_facts(spark, sf, detect))


@register("doc_profile")
def doc_profile(spark: SparkSession, sf: str) -> DataFrame:
    """P17-P21 + M7: audit row per document."""
    return _profile(spark, sf)


@register("corpus_summary")
def corpus_summary(spark: SparkSession, sf: str) -> DataFrame:
    """native/scanned/tagged/non-English/failed and tier counts."""
    return corpus.corpus_summary(_profile(spark, sf))


@register("tier_listing")
def tier_listing(spark: SparkSession, sf: str) -> DataFrame:
    """O1: documents per tier, most pages first."""
    return corpus.tier_listing(_profile(spark, sf))


@register("gold_name_match")
def gold_name_match(spark: SparkSession, sf: str) -> DataFrame:
    """J5 + P15: exact, else normalised, gold file-name match per document."""
    return corpus.match_names(_profile(spark, sf, detect=False), fx.audit_gold_names(spark, sf))


@register("match_counts")
def match_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Matched and unmatched document counts."""
    m = corpus.match_names(_profile(spark, sf, detect=False), fx.audit_gold_names(spark, sf))
    return m.agg(F.count_if(F.col("gold_standard_match") != "").cast("bigint").alias("n_matched"),
                 F.count_if(F.col("gold_standard_match") == "").cast("bigint").alias("n_unmatched"))


@register("sidecar_resolve")
def sidecar_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """J6 + P16: prioritised stem candidates resolved against existing sidecars."""
    return corpus.resolve_stems(fx.resolver_gold_names(spark, sf), fx.sidecar_stems(spark, sf))


@register("usable_sidecars")
def usable_sidecars(spark: SparkSession, sf: str) -> DataFrame:
    """Usable sidecar per gold record, or the reason it is skipped."""
    side = fx.sidecar_stems(spark, sf)
    return corpus.usable_sidecars(corpus.resolve_stems(fx.resolver_gold_names(spark, sf), side), side)


@register("resume_remaining")
def resume_remaining(spark: SparkSession, sf: str) -> DataFrame:
    """Documents still to process, given those a previous run finished (incl. failures)."""
    docs = fx.doc_facts(spark, sf, detect=False)
    done = docs.where(F.pmod("doc_id", F.lit(4)) == 0)
    return corpus.remaining(docs.select("filename"), done)


@register("run_outcomes")
def run_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Succeeded and failed conversions."""
    p = _profile(spark, sf, detect=False)
    return p.agg(F.count_if("docling_success").cast("bigint").alias("n_ok"),
                 F.count_if(~F.col("docling_success")).cast("bigint").alias("n_failed"))


@register("page_stats")
def page_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Pages per document (1,800-character pages) and characters per page."""
    d = fx.table(spark, sf, "documents")
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / F.lit(fx.PAGE_CHARS))).cast("int")
    pages = F.transform(F.sequence(F.lit(0), n - 1),
                        lambda i: F.substring(F.col("text"), i * fx.PAGE_CHARS + 1, fx.PAGE_CHARS))
    total = F.aggregate(pages, F.lit(0), lambda acc, p: acc + F.length(p))
    return d.select("doc_id", n.alias("n_pages"), total.alias("text_length"),
                    (total / n).alias("chars_per_page"))


@register("silent_failures")
def silent_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Conversions whose stripped text is under 100 characters."""
    from quarry.functions.text import py_strip
    d = fx.table(spark, sf, "documents").select("doc_id", F.length(py_strip(F.col("text"))).alias("stripped_len"))
    return d.where(F.col("stripped_len") < 100)


@register("doc_routing")
def doc_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Up-front route per document from its profile."""
    p = _profile(spark, sf)
    route = (F.when(p.native_vs_scanned == "scanned", F.lit("vision"))
             .when(p.complexity_tier.isin("Hard", "Medium"), F.lit("layout")).otherwise(F.lit("text")))
    return p.groupBy(route.alias("route")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("stratified_sample")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic hash-ranked quota per tier (the limit is the feature)."""
    p = corpus.profile(fx.doc_facts(spark, sf), keep=("doc_id",))
    h = F.pmod(F.col("doc_id") * F.lit(2654435761), F.lit(4294967296))
    w = Window.partitionBy("complexity_tier").orderBy(h, F.col("doc_id"))
    return (p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 5)
            .select("complexity_tier", "filename", F.col("rank").cast("bigint").alias("rank")))


@register("html_sidecars")
def html_sidecars(spark: SparkSession, sf: str) -> DataFrame:
    """N5 + F1: HTML pages -> sidecar rows (per-partition converter, per-row errors)."""
    pages = fx.table(spark, sf, "pages")
    side = convert.convert_documents(pages.select(F.col("page_id").cast("string").alias("name"), "html"),
                                     "name", "html")
    return side.select(F.col("filename").alias("page_id"), "success", F.length("text").alias("text_length"),
                       F.size("tables").alias("table_count"), "page_count", "error")


@register("html_table_stats")
def html_table_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Table count and table text length of converted pages."""
    pages = fx.table(spark, sf, "pages")
    side = convert.convert_documents(pages.select(F.col("page_id").cast("string").alias("name"), "html"),
                                     "name", "html")
    return corpus.table_stats(side)


# ---------------------------------------------------------- files and back


@register("audit_csv")
def audit_csv(spark: SparkSession, sf: str) -> DataFrame:
    """S3 + M7: the 16-column audit rows written as CSV and read back typed."""
    path = shared_dir(spark, "audit-csv")
    rows = corpus.audit_rows(fx.doc_facts(spark, sf), fx.audit_gold_names(spark, sf))
    rows.write.option("header", True).csv(path)
    return readers.read_audit(spark, path)


@register("manifest_csv")
def manifest_csv(spark: SparkSession, sf: str) -> DataFrame:
    """S7 + S3: the manifest written as CSV and read back typed."""
    path = shared_dir(spark, "manifest-csv")
    sinks.write_manifest(_manifest(spark, sf), path)
    return readers.read_manifest(spark, path).withColumn("notes", F.coalesce("notes", F.lit("")))


@register("bucket_files")
def bucket_files(spark: SparkSession, sf: str) -> DataFrame:
    """S6 + N6: both buckets written and read back: bucket from the folder, the quarantine reason from the record."""
    path = shared_dir(spark, "buckets")
    norm = materialise(_normalised(spark, sf), "normalised-records")
    man = materialise(curation.manifest(norm, *fx.decisions(spark, sf)), "manifest")
    sinks.write_buckets(*curation.split_buckets(norm, man), path)
    both = readers.read_buckets(spark, path)
    m = parse_object(F.col("body"))
    return both.select("orig_index", "bucket", "file_name", m[F.lit("Product Name")].alias("product"),
                       m[F.lit("_quarantine_reason")].alias("quarantine_reason"))


@register("scores_csv")
def scores_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Per-record scores written as CSV (rounded there only) and read back typed."""
    path = shared_dir(spark, "scores-csv")
    sinks.write_scores(scoring.scores_export(_scored(spark, sf), prompts.short_model_name(F.lit("org/Fixture-1B-Instruct"))), path)
    return readers.read_scores(spark, path)


@register("results_json")
def results_json(spark: SparkSession, sf: str) -> DataFrame:
    """S10 + S11: parsed responses beside their raw texts, as JSON Lines and back."""
    path = shared_dir(spark, "results-json")
    r = prompts.parse_responses(_responses(spark, sf))
    sinks.write_results(r.withColumn("file_name", fx.order_file_name(F.col("o_orderkey"))), path)
    back = readers.read_results(spark, path, "o_orderkey bigint, file_name string, raw_text string, rule string, parsed string")
    return back.select("o_orderkey", "file_name", "rule", F.sha2("parsed", 256).alias("parsed_sha"), F.sha2("raw_text", 256).alias("raw_sha"))


def _written_sidecars(spark: SparkSession, sf: str) -> str:
    """Sidecar rows of all documents, written in one folder per language."""
    path = shared_dir(spark, "sidecars")
    docs = fx.doc_facts(spark, sf, detect=False).join(fx.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    sinks.write_sidecars(docs.select(
        "filename", F.col("docling_success").alias("success"), "text", F.col("page_count").cast("int").alias("page_count"),
        F.col("docling_seconds").alias("processing_time_s"), F.col("docling_error").alias("error"), "lang"), path, "lang")
    return path


@register("sidecar_files")
def sidecar_files(spark: SparkSession, sf: str) -> DataFrame:
    """S2 + S5: sidecars written as JSON Lines, and those of named languages read back."""
    side = readers.only(readers.read_sidecars(spark, _written_sidecars(spark, sf), lines=True), "de, en", "lang")
    return side.select("filename", "lang", "success", "page_count", "processing_time_s", F.length("text").alias("text_length"), "error")


@register("document_listing")
def document_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Files listed by suffix in each language's folder (contents unread), with the documents they hold."""
    path = _written_sidecars(spark, sf)
    listed = readers.list_documents(spark, f"{path}/lang=*", "json").select("filename", (F.col("length") > 0).alias("filled"))
    side = readers.read_sidecars(spark, path, lines=True).select("lang", F.col("_metadata.file_name").alias("file"))
    per_file = side.groupBy("lang", "file").agg(F.count(F.lit(1)).alias("n"))
    names = listed.groupBy("filename").agg(F.bool_and("filled").alias("filled"))
    met = per_file.join(names, per_file["file"] == names["filename"], "left")
    return met.groupBy("lang").agg(F.sum("n").alias("n_documents"), F.bool_and(F.coalesce("filled", F.lit(False))).alias("listed"))


@register("ledger_append")
def ledger_append(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs appended to one ledger, the second one twice; committed rows per model and run read back."""
    path = shared_dir(spark, "ledger")
    a = fx.attempts(spark, sf).withColumn("model", F.col("event_type"))
    for run in (0, 1, 1):
        rows = ledger.ledger_rows(a.where(F.pmod("event_id", F.lit(2)) == run), "model", "correct", "price", "latency")
        sinks.append_ledger(rows, path, run_id=f"run {run}")
    led = sinks.read_ledger(spark, path)
    return led.withColumn("run", F.split_part("run_id", F.lit(" "), F.lit(2)).cast("bigint")).drop("run_id")


# --------------------------------------------------------- prompts/responses


def _asked(spark: SparkSession, sf: str, docs: DataFrame, descriptions: Column | None = None) -> DataFrame:
    """``docs`` with ``fields_block``: the flat fields of the gold corpus."""
    fields = prompts.flat_fields(fx.gold_records(spark, sf), indicators=fx.FIXTURE_SPEC.indicators)
    return prompts.with_field_block(docs, fields, "doc_id", descriptions)


def _no_tables() -> Column:
    return F.array().cast("array<struct<index:int,markdown:string>>")


@register("flat_fields")
def flat_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered distinct flat field names over the gold corpus."""
    return prompts.flat_fields(fx.gold_records(spark, sf), indicators=fx.FIXTURE_SPEC.indicators)


def _fixture_tables() -> Column:
    """Tables of a document by doc_id % 3: none, one, or two with a blank one between."""
    grid = lambda head, c: F.concat(F.lit(f"| {head} |\n| "), F.col(c).cast("string"), F.lit(" |"))
    one = lambda k, md: F.struct(F.lit(k).alias("index"), md.alias("markdown"))
    chars, lang = grid("chars", "n_chars"), grid("lang", "lang")
    k = F.pmod("doc_id", F.lit(3))
    return (F.when(k == 0, F.array().cast("array<struct<index:int,markdown:string>>"))
            .when(k == 1, F.array(one(0, chars))).otherwise(F.array(one(0, chars), one(1, F.lit("")), one(2, lang))))


@register("document_prompts")
def document_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Extraction prompt per document with its tables (length and SHA-256 of the text)."""
    docs = _asked(spark, sf, fx.table(spark, sf, "documents"))
    p = prompts.build_prompt(F.col("fields_block"), F.col("text"), _fixture_tables())
    return docs.select("doc_id", F.length(p).alias("prompt_chars"), F.sha2(p, 256).alias("prompt_sha"))


@register("chat_messages")
def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Chat message list per document as JSON text."""
    docs = _asked(spark, sf, fx.table(spark, sf, "documents").select("doc_id", "text"))
    p = prompts.build_prompt(F.col("fields_block"), F.col("text"), _no_tables())
    return docs.select("doc_id", F.to_json(prompts.chat_messages(p)).alias("messages"))


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    """``response`` fixture: orders as JSON, wrapped by key % 5 (bare, fenced with/without
    tag, prose around, truncated); fenced bodies with key % 3 = 0 carry junk inside."""
    o = fx.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(k.alias("order"), F.col("o_orderstatus").alias("status"),
                              F.col("o_orderpriority").alias("priority")))
    m = F.pmod(k, F.lit(5))
    junk = F.when(F.pmod(k, F.lit(3)) == 0, F.lit(" x")).otherwise(F.lit(""))
    text = (F.when(m == 0, body)
            .when(m == 1, F.concat(F.lit("```json\n"), body, junk, F.lit("\n```")))
            .when(m == 2, F.concat(F.lit("```\n"), body, F.lit("\n```")))
            .when(m == 3, F.concat(F.lit("Here is the result: "), body, F.lit(" Hope this helps.")))
            .otherwise(F.substring(body, F.lit(1), F.length(body) - 5)))
    return o.select("o_orderkey", text.alias("raw_text"))


@register("response_parse")
def response_parse(spark: SparkSession, sf: str) -> DataFrame:
    """P24 + P25 + T6: JSON extracted from raw responses; failures become ``{}``."""
    r = prompts.parse_responses(_responses(spark, sf))
    m = parse_object(F.col("parsed"))
    return r.select("o_orderkey", fx.order_file_name(F.col("o_orderkey")).alias("file_name"), "rule",
                    F.size(m).cast("bigint").alias("n_keys"), m[F.lit("status")].alias("status"),
                    F.sha2("raw_text", 256).alias("raw_sha"))


@register("stub_extraction")
def stub_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """F2 + P24: a deterministic stand-in model run over document prompts, then parsed."""
    docs = _asked(spark, sf, fx.table(spark, sf, "documents").select("doc_id", "text"))
    p = prompts.build_prompt(F.col("fields_block"), F.col("text"), _no_tables())

    def make_model():
        import json

        def model(prompt: str) -> str:
            body = prompt.split("EPD DOCUMENT:\n", 1)[-1]
            words = body.split()
            return "```json\n" + json.dumps({"Order Status": words[0] if words else "N/A", "n_words": str(len(words))},
                                               ensure_ascii=False) + "\n```"
        return model

    raw = prompts.run_extractor(docs.select("doc_id", p.alias("prompt")), "prompt", "doc_id", make_model)
    parsed = prompts.parse_responses(raw)
    return parsed.select(F.col("key").alias("doc_id"), "rule", "parsed")


# ------------------------------------------------------------------- ledger


TIER_THRESHOLDS = {1: 0.9, 2: 0.8, 3: 0.7, 4: 0.5}  # the last tier accepts everything
TIER_ORDERS = {"all": (1, 2, 3, 4, 5), "odd": (1, 3, 5), "large first": (5, 4, 3, 2, 1)}


@register("cascade_routing")
def cascade_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted tier, correctness, cost and latency per document, one threshold per tier."""
    c = ledger.cascade(fx.attempts(spark, sf), TIER_THRESHOLDS)
    return c.select("doc", F.col("accepted_tier").cast("int").alias("accepted_tier"), "correct",
                    F.col("cost").cast("double").alias("cost"), F.col("latency").cast("double").alias("latency"))


def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.threshold_sweep(fx.attempts(spark, sf), ledger.sweep_grid(TIER_ORDERS), budget=0.03)


@register("threshold_sweep")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Cascade outcome per tier order and per-tier thresholds, with the budget test."""
    return _sweep(spark, sf)


@register("pareto_frontier")
def pareto_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Sweep points that strictly improve accuracy over every cheaper point."""
    s = _sweep(spark, sf)
    return ledger.pareto_frontier(s, "cost_per_doc", "accuracy", ["tier_order", "threshold"]).select(
        "tier_order", "threshold", "cost_per_doc", "accuracy")


@register("latency_percentiles")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """p50 / p95 latency per event type."""
    return ledger.latency_percentiles(fx.table(spark, sf, "events"), "event_type", "value")


@register("self_consistency")
def self_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Majority answer and agreement over each user's samples."""
    return ledger.majority_vote(fx.table(spark, sf, "events"), "user_id", "event_type")


@register("semantic_entropy")
def semantic_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy of normalised answer clusters per user."""
    return ledger.semantic_entropy(fx.table(spark, sf, "events"), "user_id", "event_type")


def _calib_input(spark: SparkSession, sf: str) -> DataFrame:
    lab = fx.table(spark, sf, "labels")
    docs = fx.table(spark, sf, "documents").select("doc_id", "n_chars")
    return lab.join(docs, "doc_id").select(
        F.least(F.col("n_chars") / F.lit(5000.0), F.lit(0.999)).alias("conf"), (F.col("quality") == 1).alias("ok"))


@register("calibration_bins")
def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Reliability bins of confidence against labelled quality."""
    return ledger.calibration_bins(_calib_input(spark, sf), "conf", "ok")


@register("calibration_ece")
def calibration_ece(spark: SparkSession, sf: str) -> DataFrame:
    """Expected calibration error."""
    return ledger.expected_calibration_error(ledger.calibration_bins(_calib_input(spark, sf), "conf", "ok"))


@register("doc_costs")
def doc_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Token cost per document in the cloud, locally, and routed by tier."""
    from decimal import Decimal
    prof = corpus.profile(fx.doc_facts(spark, sf), keep=("doc_id", "n_chars"))
    tokens = F.ceil(F.col("n_chars") / F.lit(4)).cast("bigint")
    cloud = tokens * F.lit(Decimal("0.000003"))
    local = tokens * F.lit(Decimal("0.0000002"))
    return prof.select("doc_id", tokens.alias("tokens"), cloud.cast("double").alias("cloud_cost"),
                       local.cast("double").alias("local_cost"),
                       F.when(F.col("complexity_tier") == "Hard", cloud).otherwise(local).cast("double")
                       .alias("routed_cost"))


@register("mean_logprob")
def mean_logprob(spark: SparkSession, sf: str) -> DataFrame:
    """Mean log-probability of each token array (``exp`` of it is the confidence)."""
    e = fx.table(spark, sf, "embeddings")
    m = ledger.mean_logprob(F.col("embedding"))
    return e.select("vec_id", F.size("embedding").cast("bigint").alias("n_tokens"), m.alias("mean_logprob"))


@register("mode_delta")
def mode_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Per document, quality in native mode minus text mode."""
    a = fx.attempts(spark, sf).withColumn("mode", F.when(F.pmod("event_id", F.lit(2)) == 0, "text")
                                           .otherwise("native"))
    q = a.groupBy("user_id").agg(
        F.try_divide(F.count_if((F.col("mode") == "native") & F.col("correct")).cast("double"),
                     F.count_if(F.col("mode") == "native")).alias("native_quality"),
        F.try_divide(F.count_if((F.col("mode") == "text") & F.col("correct")).cast("double"),
                     F.count_if(F.col("mode") == "text")).alias("text_quality"))
    return q.withColumn("delta", F.col("native_quality") - F.col("text_quality"))


@register("energy_totals")
def energy_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Energy per run, the router's share and the net of it."""
    a = fx.attempts(spark, sf)
    return a.groupBy("user_id").agg(
        F.sum("latency").cast("double").alias("total"),
        F.coalesce(F.sum(F.when(F.col("event_type") == "view", F.col("latency"))), F.lit(0)).cast("double")
        .alias("router"),
        (F.sum("latency") - F.coalesce(F.sum(F.when(F.col("event_type") == "view", F.col("latency"))), F.lit(0)))
        .cast("double").alias("net"))


@register("run_ledger")
def run_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """A5 + S9 + P26: one ledger row per model (short name), quality, cost and latency."""
    a = fx.attempts(spark, sf)
    model = prompts.short_model_name(F.concat(F.lit("org/"), F.initcap("event_type"), F.lit("-7B-Instruct")))
    return ledger.ledger_rows(a.withColumn("model", model), "model", "correct", "price", "latency")


# ---------------------------------------------------------- chunks/retrieval


CHUNK_SOURCE_BREAK = "\n\n\n\nPage 1 of 9\n"
INLINE_MARKER = ", see Page 2 of 9 "


def _chunk_source(spark: SparkSession, sf: str) -> DataFrame:
    """``chunk_source``: document text with page markers and newline runs inserted."""
    d = fx.table(spark, sf, "documents")
    broken = F.regexp_replace("text", "\n", CHUNK_SOURCE_BREAK)
    return d.select("doc_id", F.replace(broken, F.lit(", "), F.lit(INLINE_MARKER)).alias("text"))


@register("clean_text")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    """Page markers removed, newline runs collapsed, stripped."""
    c = chunking.clean_text(F.col("text"))
    return _chunk_source(spark, sf).select("doc_id", F.length(c).alias("clean_chars"), F.sha2(c, 256).alias("clean_sha"))


@register("text_chunks")
def text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """1,000-character chunks with 15 % overlap over whole documents."""
    ch = chunking.overlapping_chunks(fx.table(spark, sf, "documents").select("doc_id", "text"), "text")
    return ch.select("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "start",
                     F.length("chunk").alias("chunk_chars"), F.sha2(F.col("chunk"), 256).alias("chunk_sha"))


@register("page_chunks")
def page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """20-page ranges of 1,800-character pages."""
    ch = chunking.page_groups(fx.table(spark, sf, "documents").select("doc_id", "text"), "text")
    return ch.select("doc_id", "group_idx", "first_page", "last_page", F.length("chunk").alias("chunk_chars"))


@register("table_prose_chunks")
def table_prose_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """D3: tables as their own chunks beside prose chunks of converted pages."""
    pages = fx.table(spark, sf, "pages")
    side = convert.convert_documents(pages.select(F.col("page_id").cast("string").alias("name"), "html"),
                                     "name", "html")
    ch = chunking.table_and_prose_chunks(side)
    return ch.select("filename", "chunk_type", "chunk_idx", F.length("chunk").alias("chunk_chars"))


@register("retrieval_topk")
def retrieval_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Per label, the five vectors closest (cosine) to the label centroid."""
    e = fx.table(spark, sf, "embeddings")
    cents = chunking.centroids(e, "label", "embedding")
    sizes = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    cents = materialise(cents.join(sizes, "label"), "label-centroids")
    top = chunking.top_k_by_query(e, cents, "label", "embedding", "centroid", "vec_id", rows="n", k=5)
    return top.select("label", "vec_id", F.col("rank").cast("bigint").alias("rank"))


@register("fuzzy_names")
def fuzzy_names(spark: SparkSession, sf: str) -> DataFrame:
    """Levenshtein similarity and token Jaccard of predicted vs gold names."""
    p = fx.table(spark, sf, "part")
    k = F.col("p_partkey")
    pred = (F.when(F.pmod(k, F.lit(3)) == 0, F.regexp_replace("p_name", "e", "a"))
            .when(F.pmod(k, F.lit(3)) == 1, F.upper("p_name")).otherwise(F.col("p_name")))
    g, q = F.col("p_name"), pred
    lev = F.levenshtein(g, q)
    sim = F.lit(1.0) - F.try_divide(lev.cast("double"), F.greatest(F.length(g), F.length(q)))
    tg = F.array_distinct(F.split(F.lower(g), " "))
    tq = F.array_distinct(F.split(F.lower(q), " "))
    jac = F.try_divide(F.size(F.array_intersect(tg, tq)).cast("double"), F.size(F.array_union(tg, tq)))
    return p.select(k.alias("p_partkey"), lev.cast("bigint").alias("distance"), sim.alias("lev_sim"),
                    jac.alias("jaccard"))


@register("few_shot")
def few_shot(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts with the texts of two example documents, never the document itself."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    good = fx.table(spark, sf, "labels").where(F.col("quality") == 1).select("doc_id").distinct()
    picks = prompts.draw_examples(docs.select("doc_id"), docs.select("doc_id").join(good, "doc_id", "left_semi"), "doc_id", k=2)
    shown = prompts.example_block(docs.select("doc_id"), picks, docs, "doc_id", "text")
    asked = _asked(spark, sf, docs.join(shown, "doc_id"))
    p = F.concat(F.col("examples"), prompts.build_prompt(F.col("fields_block"), F.col("text"), _no_tables()))
    return asked.select("doc_id", F.array_join(F.transform("example_ids", lambda e: e.cast("string")), ",").alias("example_ids"),
                        F.length(p).cast("bigint").alias("prompt_chars"), F.sha2(p, 256).alias("prompt_sha"))


@register("leaf_count")
def leaf_count(spark: SparkSession, sf: str) -> DataFrame:
    """Scorable leaves per gold record."""
    g = fx.gold_records(spark, sf)
    leaves = scoring.raw_leaves(parse_object(F.col("body")), empty_map(), fx.FIXTURE_SPEC)
    return g.select("orig_index", F.size(leaves).cast("bigint").alias("n_leaves"))


def _leaves(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.field_scores(fx.gold_records(spark, sf), fx.pred_records(spark, sf), fx.FIXTURE_SPEC,
                                names=fx.gold_names(spark, sf))


@register("true_prf")
def true_prf(spark: SparkSession, sf: str) -> DataFrame:
    """Precision over extracted values, recall over populated gold, per category."""
    lv = _leaves(spark, sf)
    extracted = (F.col("pred_value") != "MISSING") & ~is_na(F.col("pred_value")) & (F.col("pred_value") != "[]")
    correct = extracted & ~F.col("gold_is_na") & (F.col("match") == 1.0)
    out = lv.groupBy("category").agg(
        F.count_if(extracted).cast("bigint").alias("n_extracted"),
        F.count_if(correct).cast("bigint").alias("n_correct"),
        F.count_if(~F.col("gold_is_na")).cast("bigint").alias("n_gold"))
    p = F.when(F.col("n_extracted") > 0, F.col("n_correct") / F.col("n_extracted")).otherwise(F.lit(0.0))
    r = F.when(F.col("n_gold") > 0, F.col("n_correct") / F.col("n_gold")).otherwise(F.lit(0.0))
    out = out.select("*", p.alias("precision"), r.alias("recall"))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                       F.lit(2.0) * F.col("precision") * F.col("recall")
                                       / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))


@register("failure_taxonomy")
def failure_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf outcomes rolled up by error type and category."""
    lv = _leaves(spark, sf)
    pred_na = is_na(F.col("pred_value"))
    kind = (F.when(F.col("match") == 1.0, F.lit("ok"))
            .when(F.col("pred_value").isin("MISSING", "[]"), F.lit("missing"))
            .when(F.col("gold_is_na") & ~pred_na, F.lit("hallucinated"))
            .when(~F.col("gold_is_na") & pred_na, F.lit("false_na"))
            .otherwise(F.lit("wrong_value")))
    return lv.groupBy("category", kind.alias("error_type")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("unit_outliers")
def unit_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Per (indicator, unit) median and MAD; values beyond 5 MAD are outliers."""
    g = _gold_units(spark, sf).select(parse_object(F.col("body")).alias("gold"), empty_map().alias("pred"))
    lv = scoring.leaf_rows(g, "gold", "pred", fx.FIXTURE_SPEC).where(F.col("category") == "lca_numeric")
    nums = lv.select(F.split_part("field", F.lit("."), F.lit(1)).alias("indicator"), F.col("gold_unit").alias("unit"),
                     parse_numeric(F.col("gold_value")).alias("x")).where(F.col("x").isNotNull())
    # equal values of an indicator and unit deviate equally: one row each, with its number of leaves
    by, spread = ["indicator", "unit"], [F.col("x")]
    nums = materialise(nums.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("leaves")), "unit-values")
    med = exact_quantiles(nums, by, "x", [0.5], "leaves").select(*by, "n", F.col("q0").alias("median"))
    med = materialise(med, "unit-medians")  # one row per indicator and unit, each with its number of leaves
    total = med.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dev = materialise(salted_join(nums, med, by, spread, "n", total).withColumn("d", F.abs(F.col("x") - F.col("median"))), "unit-deviations")
    mad = materialise(exact_quantiles(dev, by, "d", [0.5], "leaves").select(*by, F.col("n").alias("_n"), F.col("q0").alias("mad")), "unit-mads")
    flagged = salted_join(dev, mad, by, spread, "_n", total).groupBy(*by, "median", "mad").agg(
        F.sum(F.when(F.col("d") > F.lit(5.0) * F.col("mad"), F.col("leaves")).otherwise(F.lit(0))).cast("bigint").alias("n_outliers"))
    return flagged.select(*by, "median", "mad", "n_outliers")


def _gold_units(spark: SparkSession, sf: str) -> DataFrame:
    """Gold records; every third order states its quantities in dozens, so one indicator has two units."""
    g = fx.gold_records(spark, sf)
    dozens = F.replace("body", F.lit('"Unit":"pcs"'), F.lit('"Unit":"dozen"'))
    return g.withColumn("body", F.when(F.pmod("orig_index", F.lit(3)) == 0, dozens).otherwise(F.col("body")))


@register("language_detect")
def language_detect(spark: SparkSession, sf: str) -> DataFrame:
    """the language of every document, by trigram profiles of all labelled ones."""
    d = fx.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return fx.language_model(spark, sf).detect(d).drop("text")


@register("train_eval_split")
def train_eval_split(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic 80/20 split by conversation id, one row per message."""
    c = fx.table(spark, sf, "conversations")
    split = F.when(F.pmod("conv_id", F.lit(100)) < 80, F.lit("train")).otherwise(F.lit("eval"))
    return c.select("conv_id", "turn", split.alias("split"), "role", F.length("text").alias("n_chars"))


@register("chat_export")
def chat_export(spark: SparkSession, sf: str) -> DataFrame:
    """Chat-format JSON lines, one per conversation with its messages in order, tagged with the split."""
    c = fx.table(spark, sf, "conversations")
    split = F.when(F.pmod("conv_id", F.lit(100)) < 80, F.lit("train")).otherwise(F.lit("eval"))
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("turns"))
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return turns.select(split.alias("split"), F.to_json(F.struct("conv_id", messages.alias("messages"))).alias("line"))


GROUP_TERMS = {"Order Status": "state of the order", "Order Priority": "priority class", "Return Flags": "list of return flags",
               "QTY": "number of pieces", "PRICE": "price to be paid", "DISC": "what is taken from the price", "TAX": "tax for the sale"}


@register("schema_chunked_prompts")
def schema_chunked_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Fields and indicators in groups of two; one prompt per document and group over its best chunks."""
    fields = prompts.flat_fields(fx.gold_records(spark, sf), indicators=fx.FIXTURE_SPEC.indicators)
    groups = retrieval.field_groups(fields, fx.FIXTURE_SPEC.indicators, 2, GROUP_TERMS)
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    shown = retrieval.group_passages(docs, groups, "doc_id", "text")
    p = prompts.build_group_prompt(F.col("kind"), F.col("names"), F.col("passages"), _no_tables())
    return shown.select("doc_id", "field_group", "n_chunks", F.length(p).alias("prompt_chars"), F.sha2(p, 256).alias("prompt_sha"))


@register("vector_search")
def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest vectors (cosine, over all labels) of every vector whose id is divisible by 50."""
    e = fx.table(spark, sf, "embeddings")
    index = retrieval.build_index(e, "vec_id", "embedding")
    asked = e.where(F.pmod("vec_id", F.lit(50)) == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec"))
    return retrieval.search(asked, index, k=5).select("query", "id", "score", F.col("rank").cast("bigint").alias("rank"))


# ---------------------------------------------------------------- streaming


FILES_PER_BATCH = 64


@register("incremental_profile")
def incremental_profile(spark: SparkSession, sf: str) -> DataFrame:
    """ST1 + ST2: documents profiled as an availableNow stream, resumable by document, then read back.

    Output lands in a fresh folder under the session's shared checkpoint dir.
    """
    base = shared_dir(spark, "incremental-profile")
    schema = fx.table(spark, sf, "documents").schema.simpleString()[len("struct<"):-1].replace(":", " ")

    model = fx.language_model(spark, sf)

    def transform(batch: DataFrame) -> DataFrame:
        return corpus.profile(fx.doc_facts_from(batch, model))

    source, glob = incremental.table_source(spark, sf, "documents.parquet")
    incremental.process_documents(spark, source, schema, f"{base}/checkpoint", f"{base}/out", transform,
                                  fx.doc_file_name(F.col("doc_id")), "filename", max_files_per_trigger=FILES_PER_BATCH, glob=glob)
    return incremental.read_documents(spark, f"{base}/out")


# ------------------------------------------------------------ more D rows

@register("pass_divergence")
def pass_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """Divergence between the two extraction passes of the same document."""
    return scoring.pass_divergence(fx.pred_records(spark, sf), fx.FIXTURE_SPEC)


STRICT_SPEC = scoring.ScoringSpec(indicators=fx.FIXTURE_SPEC.indicators, list_fields=fx.FIXTURE_SPEC.list_fields,
                                  rtol=0.01, atol=0.001, either=True)


@register("score_summary_strict")
def score_summary_strict(spark: SparkSession, sf: str) -> DataFrame:
    """The summary under the alternative tolerance (within 1 % or within 0.001)."""
    rec = scoring.score_records(fx.gold_records(spark, sf), fx.pred_records(spark, sf), STRICT_SPEC,
                                names=fx.gold_names(spark, sf))
    return scoring.summary_row(rec, "fixture-model-strict")


FIELD_DESCRIPTIONS = {"Order Status": "single-letter order state", "Order Priority": "priority class",
                      "Return Flags": "list of return flags"}


@register("described_prompts")
def described_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts whose field lines carry a description from a small field dimension."""
    import json as _json
    desc = F.from_json(F.lit(_json.dumps(FIELD_DESCRIPTIONS)), "map<string,string>")
    docs = _asked(spark, sf, fx.table(spark, sf, "documents").select("doc_id", "text"), desc)
    p = prompts.build_prompt(F.col("fields_block"), F.col("text"), _no_tables())
    return docs.select("doc_id", F.length(p).alias("prompt_chars"), F.sha2(p, 256).alias("prompt_sha"))


@register("incremental_summary")
def incremental_summary(spark: SparkSession, sf: str) -> DataFrame:
    """ST3: one ledger row per event type and micro-batch, appended replay-safely."""
    base = shared_dir(spark, "incremental-summary")
    schema = fx.table(spark, sf, "events").schema.simpleString()[len("struct<"):-1].replace(":", " ")

    def summarise(batch: DataFrame) -> DataFrame:
        return batch.groupBy("event_type").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                               F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
                                               .alias("value_total"))

    source, glob = incremental.table_source(spark, sf, "events.parquet")
    incremental.append_summary(spark, source, schema, f"{base}/checkpoint", f"{base}/ledger", summarise,
                               max_files_per_trigger=FILES_PER_BATCH, glob=glob)
    led = spark.read.parquet(f"{base}/ledger")
    return led.groupBy("event_type").agg(F.sum("n").cast("bigint").alias("n"),
                                         F.sum("value_total").alias("value_total"))


@register("exact_duplicates")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text repeats an earlier one; the first id is kept.

    Texts are hashed once into a written table. It is grouped by hash (combined before the
    shuffle), and only hashes that occur twice or more are joined back, hot ones over salts.
    """
    d = materialise(fx.table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("h")), "text-hashes")
    first = materialise(d.groupBy("h").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("n"))
                        .where("n > 1 and h is not null"), "repeated-hashes")
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    j = salted_join(d, first, ["h"], [F.col("doc_id")], "n", total)
    return j.where(F.col("doc_id") != F.col("first_doc_id")).select("doc_id", "first_doc_id")


@register("provenance_pages")
def provenance_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The pages a provenance note points at, selected from each document."""
    d = fx.table(spark, sf, "documents")
    k = F.col("doc_id")
    prov = F.when(F.pmod(k, F.lit(4)) == 0, F.concat(F.lit("see page "), (F.pmod(k, F.lit(5)) + 1).cast("string"))) \
        .otherwise(F.concat(F.lit("Values taken from pages "), (F.pmod(k, F.lit(3)) + 1).cast("string"), F.lit("–"),
                            (F.pmod(k, F.lit(3)) + 2).cast("string")))
    first, last, chunk = chunking.pages_from_provenance(F.col("text"), prov)
    return d.select("doc_id", first.alias("first_page"), last.alias("last_page"), F.length(chunk).alias("chunk_chars"))

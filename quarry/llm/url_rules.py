"""URL filter: fixed host/path rules, then association rules mined by Spark's FP-growth.

A URL becomes a set of tokens (host suffixes, path parts, file ending, query names). FP-growth
mines frequent token sets over the labelled URLs, each transaction holding its label as one
more token; an association rule "tokens => bad" stays when its support and confidence reach
the thresholds, and when no rule on fewer of its tokens is as good. Rules are matched through
an inverted index: a rule is filed under the least frequent of its tokens, a URL looks up its own
tokens there, and a hit counts when the URL has all of the rule's tokens.

Defined cases: a null URL, or one without "://", has empty host and path and no tokens; null
page ids and repeated rows are judged like any row (one result per input row); no labels, or labels of one
kind, leave no rules and the default verdict "allow"; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.skew import key_bitmap, materialise, maybe_in, salted_join

BAD = "label=bad"

# Fixed values: (verdict, rule); a rule is host then path.
BASE_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host lower-cased in A-Z; both empty without "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    rest = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.translate(F.substring_index(rest, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.when(F.instr(rest, "/") > 0, F.substr(rest, F.instr(rest, "/")))
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def base_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = BASE_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first
        cut = text.index("/")
        fits = (((host == text[:cut]) | host.endswith("." + text[:cut])) & path.startswith(text[cut:]))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens: every host suffix, path parts (numbers as one class), ending, query names."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(labels, lambda _, i: F.concat(
        F.lit("host="), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(
        F.lit("path="), F.regexp_replace(F.lower(x), r"[0-9]+", "0")))
    ending = F.transform(F.filter(F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)), lambda x: x != ""),
                         lambda x: F.concat(F.lit("ending="), F.lower(x)))
    names = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1)),
                        lambda x: F.concat(F.lit("query="), F.lower(x)))
    scheme = F.array(F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1))))
    every = F.array_sort(F.array_distinct(F.concat(suffixes, parts, ending, names, scheme)))
    return F.when(F.instr(url, "://") > 0, every).otherwise(F.array().cast("array<string>"))


def mine_rules(tokens: DataFrame, bad: str = "bad", min_support: float = 0.002, min_confidence: float = 0.6,
               min_rows: int = 20) -> DataFrame:
    """Rules (rule_id, items, support, confidence) over rows (tokens array, ``bad`` boolean).

    A rule needs ``min_support`` of the labelled rows, and ``min_rows`` of them, to be bad rows it fits.
    """
    rows = tokens.select(F.when(F.col(bad), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    rows = materialise(rows, "url-transactions")
    n = max(rows.count(), 1)
    total = F.lit(float(n))
    # just below min_rows / n, so that rounding keeps sets of exactly min_rows
    support = min(1.0, max(min_support, (min_rows - 0.5) / n))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(rows)
    sets = materialise(model.freqItemsets, "url-itemsets")
    plain = sets.where(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("items"), F.col("freq").alias("seen"))
    marked = (sets.where(F.array_contains("items", BAD))
              .select(F.array_sort(F.array_remove("items", BAD)).alias("items"), F.col("freq").alias("hits")))
    rules = (marked.join(plain, "items")
             .select("items", (F.col("hits") / total).alias("support"), (F.col("hits") / F.col("seen")).alias("confidence"))
             .where(F.col("confidence") >= min_confidence))
    return materialise(_most_general(rules).withColumn("rule_id", F.array_join("items", " ")), "url-rules")


def _most_general(rules: DataFrame) -> DataFrame:
    """Drop a rule if leaving out one of its tokens gives a rule of at least its confidence."""
    shorter = (rules.withColumn("_out", F.explode("items"))
               .select(F.col("items").alias("_long"), F.col("confidence").alias("_conf"),
                       F.array_remove("items", F.col("_out")).alias("items")))
    beaten = (shorter.join(rules.select("items", "confidence"), "items").where(F.col("confidence") >= F.col("_conf"))
              .select(F.col("_long").alias("items")).distinct())
    return rules.join(beaten, "items", "left_anti")


def match_rules(pages: DataFrame, rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows of ``pages`` (_row, tokens) that some rule fits, as (_row, rule ids).

    ``tokens`` (token, n) holds how many URLs have each token. A rule stands in the index once,
    under its rarest token. Only tokens with an entry are looked up, and one that very many
    URLs hold meets its entry over salts.
    """
    entries = (rules.select("rule_id", "items", F.explode("items").alias("token")).join(tokens, "token")
               .groupBy("rule_id", "items").agg(F.min(F.struct("n", "token")).alias("at")))
    filed = materialise(entries.groupBy(F.col("at.token").alias("token"), F.col("at.n").alias("n"))
                        .agg(F.collect_list(F.struct("rule_id", "items")).alias("_rules")), "url-rule-index")
    total = filed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bitmap = materialise(key_bitmap(filed, "token"), "url-rule-tokens")
    held = maybe_in(pages.select("_row", "tokens", F.explode("tokens").alias("token")), "token", bitmap)
    met = salted_join(held, filed, ["token"], [F.col("_row")], "n", total).select("_row", "tokens", F.inline("_rules"))
    return met.where(F.size(F.array_except("items", "tokens")) == 0).select("_row", "rule_id")


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url",
               label_id: str = "doc_id", bad: Column | None = None, min_support: float = 0.002,
               min_confidence: float = 0.6, min_rows: int = 20) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, mined_rule (of highest confidence, or null).

    ``bad`` marks a label row as bad (default: toxic, or of low quality); a page with several
    label rows is bad if one of them is.
    """
    bad = bad if bad is not None else (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    host, path = url_parts(F.col("_url"))
    named = (pages.select(pages[id_col].alias("_id"), pages[url_col].alias("_url"))
             .withColumn("host", host).withColumn("path", path))
    known = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.max(bad).alias("bad"))
    cut = named.withColumn("tokens", url_tokens(F.col("_url"), F.col("host"), F.col("path")))
    # Equal URLs share their tokens and their verdict, so rules meet each URL once.
    urls = materialise(cut.groupBy("_url").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "urls")
    counts = urls.select(F.explode("tokens").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))
    rules = mine_rules(cut.join(known, "_id"), "bad", min_support, min_confidence, min_rows)
    hits = (match_rules(urls.withColumnRenamed("_url", "_row"), rules, counts)
            .join(rules.select("rule_id", "confidence"), "rule_id")
            .groupBy(F.col("_row").alias("_url")).agg(F.max(F.struct("confidence", "rule_id")).alias("best"),
                                                       F.lit(1).alias("_one")))
    rule, verdict = base_rule(F.col("host"), F.col("path"))
    # a common URL meets its rule over salts; pages without a URL go round the join
    judged = materialise(urls.where("_url is not null").select("_url", "n").join(hits.select("_url", "best"), "_url", "left"), "url-best")
    found = salted_join(named.where("_url is not null"), judged, ["_url"], [F.col("_id")], "n",
                        judged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).drop("n")
    none = judged.schema["best"].dataType
    found = found.unionByName(named.where("_url is null").withColumn("best", F.lit(None).cast(none)))
    return found.select(
        F.col("_id").alias(id_col), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("best").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("best.rule_id").alias("mined_rule"))

"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features of a text are its words and the first four and five letters of longer words (so that
inflected forms share evidence), each with weight ln(1 + occurrences). Severity grades are
0 (not toxic) and 1 to 3 for labelled toxic texts, by how many marker occurrences they hold
(tertiles of the training sample; markers are the selected features). One weight vector is
shared by all thresholds: P(grade >= k) = sigmoid(w.x - theta_k) with theta_1 <= theta_2 <=
theta_3, and the expected severity is the sum of these probabilities.

The model is fitted on a bounded sample of labelled rows, ``SAMPLE_TOXIC`` toxic and
``SAMPLE_CLEAN`` others, taken by the hash of their ids; thresholds are corrected for the
share of toxic rows among all labels. All such features enter (their number is bounded by the sample). Scoring reads
every document whole and needs no shuffle.

Defined cases: null or blank texts have no features and get the base severity; labels with null
ids or null toxic are ignored; without labels of both kinds every severity is 0; null ids and
repeated rows are scored like any row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.pieces import known_values, objects, split_column
from quarry.llm.skew import materialise, text_batches, worker_cache

SAMPLE_TOXIC, SAMPLE_CLEAN = 4_000, 8_000
GRADES = 3
KNOWN_TOKENS = 100_000
_RUNS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class SeverityModel:
    """Feature hash -> weight, ordered thresholds, decision level for P(grade >= 1)."""
    weights: dict[int, float]
    thresholds: tuple[float, ...]
    level: float = 0.35


def token_features(token: bytes) -> tuple[int, ...]:
    """Hashes of the features of one space-separated token."""
    from xxhash import xxh3_64_intdigest
    out = []
    for word in _RUNS.findall(unicodedata.normalize("NFKC", token.decode("utf-8", "replace")).casefold()):
        out.append("=" + word)
        out += [f"{n}{word[:n]}" for n in (4, 5) if len(word) > n]
    return tuple(xxh3_64_intdigest(f.encode()) - (1 << 63) for f in out)


def _features(keep: frozenset[int] | None) -> Callable[[list[bytes]], dict[bytes, tuple[int, ...]]]:
    """token -> its features, those of ``keep`` if given."""
    if keep is None:
        return lambda new: {t: token_features(t) for t in new}
    return lambda new: {t: tuple(f for f in token_features(t) if f in keep) for t in new}


def _table(keep: frozenset[int] | None) -> dict[bytes, tuple[int, ...]]:
    tables = worker_cache("toxic_tokens", dict)
    if keep not in tables:
        tables.clear()
        tables[keep] = {}
    return tables[keep]


def column_counts(texts: pa.Array, keep: frozenset[int] | None) -> Iterator[Counter]:
    """Occurrences of features (those of ``keep``, or all) in each text of a column."""
    for part in split_column(texts):
        found = known_values(objects(part.distinct.cast(pa.binary())), _table(keep), _features(keep), KNOWN_TOKENS)
        holds = np.array([bool(f) for f in found], bool)
        at = np.flatnonzero(holds[part.codes]) if len(found) else np.empty(0, "i8")
        ends = np.searchsorted(at, part.ends)
        codes = part.codes[at]
        for k in range(part.rows):
            counts: Counter = Counter()
            for code in codes[ends[k]:ends[k + 1]].tolist():
                counts.update(found[code])
            yield counts


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return text_batches(df).select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = SAMPLE_TOXIC,
                    clean_rows: int = SAMPLE_CLEAN) -> tuple[DataFrame, float]:
    """(doc_id, text, toxic) of a bounded sample, and the share of toxic rows among all labels."""
    known = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    known = materialise(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "toxic-labels")
    share = known.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
    order = F.xxhash64(F.col("doc_id"), F.lit(11))
    picked = (known.where("toxic > 0").orderBy(order, "doc_id").limit(toxic_rows)
              .unionByName(known.where("toxic <= 0").orderBy(order, "doc_id").limit(clean_rows)))
    picked = materialise(picked, "toxic-picked")  # at most toxic_rows + clean_rows rows
    return materialise(docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("toxic").alias("toxic")), "toxic-sample"), share  # of a repeated id the least text


def select_features(sample: DataFrame, least: int = 3, z: float = 3.0) -> list[int]:
    """Features more frequent in toxic texts: at least ``least`` of them, two-proportion z above ``z``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, found in zip(batch.column("toxic").to_pylist(), column_counts(batch.column("text"), None)):
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(found), pa.int64()), pa.array([int(toxic > 0)] * len(found), pa.int64())],
                        names=["feature", "toxic"])

    n1 = sample.where("toxic > 0").count()
    n0 = sample.count() - n1
    if not n1 or not n0:
        return []
    counts = (sample.select("toxic", "text").mapInArrow(run, "feature long, toxic long").groupBy("feature")
              .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") >= least))
    p1, p0 = F.col("a") / n1, F.col("b") / n0
    pool = (F.col("a") + F.col("b")) / (n1 + n0)
    score = (p1 - p0) / F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n0) + F.lit(1e-12))
    # a marker is also several times as frequent, not just significantly so
    top = (counts.withColumn("z", score).where((F.col("z") > z) & (p1 > 10 * p0))
           .orderBy(F.desc("z"), "feature"))
    return [r["feature"] for r in top.select("feature").collect()]


def fit_thresholds(rows: list[dict[int, float]], grade: np.ndarray, features: list[int], ridge: float = 2e-5,
                   steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link model (full-batch Adam).

    Thresholds are theta_1 + cumulated exp(gap), so they stay in order. The loss is the sum
    over thresholds of the log-loss of "grade >= k", each on all rows.
    """
    index = {f: k for k, f in enumerate(features)}
    owner = np.array([i for i, r in enumerate(rows) for _ in r], "int64")
    column = np.array([index[f] for r in rows for f in r], "int64")
    value = np.array([v for r in rows for v in r.values()], "float64")
    n, m, levels = len(rows), len(features), np.arange(1, GRADES + 1)
    target = (grade[:, None] >= levels[None, :]).astype(float)
    x = np.concatenate([np.full(m, 0.1), [1.0], np.zeros(GRADES - 1)])  # weights, theta_1, log gaps
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        gaps = np.exp(x[m + 1:])
        theta = x[m] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = np.bincount(owner, value * x[:m][column], minlength=n)
        slope = (1 / (1 + np.exp(-np.clip(eta[:, None] - theta[None, :], -40, 40))) - target) / n
        g = np.empty_like(x)
        g[:m] = np.bincount(column, value * slope.sum(axis=1)[owner], minlength=m) + ridge * x[:m]
        by_level = -slope.sum(axis=0)
        g[m] = by_level.sum()
        for k in range(GRADES - 1):
            g[m + 1 + k] = by_level[k + 1:].sum() * gaps[k]
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        x = x - rate * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.999 ** t)) + 1e-8)
    return x[:m], x[m] + np.concatenate([[0.0], np.cumsum(np.exp(x[m + 1:]))])


def fit_severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 toxic_rows: int = SAMPLE_TOXIC, clean_rows: int = SAMPLE_CLEAN) -> SeverityModel:
    """Fit on a bounded labelled sample (see the module text)."""
    sample, share = labelled_sample(_texts(docs, id_col, text_col), labels, toxic_rows, clean_rows)
    features = select_features(sample)
    if not features:
        return SeverityModel({}, (50.0,) * GRADES)
    keep = frozenset(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(column_counts(batch.column("text"), keep))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array([list(c) for c in found], pa.list_(pa.int64())),
                 pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["doc_id", "toxic", "f", "n"])

    # bounded: the sample's rows, each with its selected features only
    got = (sample.select("doc_id", F.col("toxic").cast("long").alias("toxic"), "text")
           .mapInArrow(run, "doc_id long, toxic long, f array<long>, n array<long>").orderBy("doc_id").collect())
    rows = [{f: float(np.log1p(n)) for f, n in zip(r["f"], r["n"])} for r in got]
    toxic = np.array([r["toxic"] > 0 for r in got])
    marks = np.array([sum(r["n"]) for r in got], float)
    cuts = np.quantile(marks[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + (marks > cuts[0]).astype(int) + (marks > cuts[1]).astype(int), 0)
    weights, theta = fit_thresholds(rows, grade, features)
    here = toxic.mean()
    shift = np.log(here / (1 - here)) - np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    return SeverityModel(dict(zip(features, weights.tolist())), tuple((theta + shift).tolist()))


def linear_score(counts: Counter, model: SeverityModel) -> float:
    """w.x of one text."""
    return sum(model.weights[f] * math.log1p(n) for f, n in counts.items())


def score_severity(docs: DataFrame, model: SeverityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, grade, p_toxic, toxic) of every document.

    ``grade`` counts the thresholds passed at the decision level; ``toxic`` is grade >= 1.
    """
    keep = frozenset(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta = np.array(model.thresholds)
        for batch in batches:
            eta = np.array([linear_score(c, model) for c in column_counts(batch.column("text"), keep)], float)
            p = 1 / (1 + np.exp(-np.clip(eta[:, None] - theta[None, :], -40, 40)))
            grade = (p >= model.level).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(grade, pa.int32()), pa.array(p[:, 0]),
                 pa.array(grade >= 1)], names=[id_col, "severity", "grade", "p_toxic", "toxic"])

    return _texts(docs, id_col, text_col).mapInArrow(
        run, f"`{id_col}` long, severity double, grade int, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, model: SeverityModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows the model grades 1 or more, all columns as they were."""
    keep, columns = frozenset(model.weights), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = model.thresholds[0]
        for batch in batches:
            eta = [linear_score(c, model) for c in column_counts(batch.column(columns.index(text_col)), keep)]
            yield batch.filter(pa.array([1 / (1 + np.exp(-np.clip(e - cut, -40, 40))) < model.level for e in eta], pa.bool_()))

    return text_batches(docs).mapInArrow(run, docs.schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])

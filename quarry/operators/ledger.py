"""Run ledger and model-routing analytics: cascades, sweeps, Pareto, votes.

Per-document work groups by document (a handful of attempts each); grid
sweeps evaluate every grid point inside one row per document, and the only
global orderings run over already-aggregated, grid-sized tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.skew import exact_quantiles
from quarry.functions.text import exact_sum, normalise_string


Thresholds = float | Mapping[int, float]


def tier_threshold(tier: Column, thresholds: Thresholds) -> Column:
    """The threshold of a tier: one number for all, or one per tier (0 where none is given)."""
    if isinstance(thresholds, (int, float)):
        return F.lit(float(thresholds))
    out = F.lit(0.0)
    for t, x in thresholds.items():
        out = F.when(tier == t, F.lit(float(x))).otherwise(out)
    return out


def cascade(attempts: DataFrame, thresholds: Thresholds, doc: str = "doc", tier: str = "tier",
            conf: str = "confidence") -> DataFrame:
    """Accept the first tier whose confidence is above its threshold; the last tier always accepts.

    Cost and latency accumulate over every tier tried up to the accepted one.
    Expects ``doc, tier, confidence, correct, price (decimal), latency (decimal)``.
    """
    w = Window.partitionBy(doc)
    passes = F.col(conf) > tier_threshold(F.col(tier), thresholds)
    acc = F.coalesce(F.min(F.when(passes, F.col(tier))).over(w), F.max(tier).over(w))
    a = attempts.withColumn("accepted_tier", acc)
    tried = F.col(tier) <= F.col("accepted_tier")
    return a.groupBy(doc).agg(
        F.first("accepted_tier").alias("accepted_tier"),
        F.max(F.when(F.col(tier) == F.col("accepted_tier"), F.col("correct"))).alias("correct"),
        F.sum(F.when(tried, F.col("price"))).alias("cost"),
        F.sum(F.when(tried, F.col("latency"))).alias("latency"))


@dataclass(frozen=True)
class CascadeConfig:
    """One point of the sweep: tiers in the order they are tried, a threshold for each."""
    name: str
    step: float
    order: tuple[int, ...]
    thresholds: tuple[float, ...]


def sweep_grid(orders: Mapping[str, Sequence[int]], steps: int = 10, decay: float = 0.05) -> list[CascadeConfig]:
    """Every order at start thresholds 0, 1/steps, ..., 1; each later tier asks ``decay`` less."""
    return [CascadeConfig(name, k / steps, tuple(order), tuple(max(k / steps - decay * i, 0.0) for i in range(len(order))))
            for name, order in orders.items() for k in range(steps + 1)]


def _chains(grid: Sequence[CascadeConfig]) -> list[list[CascadeConfig]]:
    """The grid cut into runs of one tier order in which no threshold falls from point to point."""
    out: list[list[CascadeConfig]] = []
    for c in sorted(grid, key=lambda c: (c.order, c.name, c.thresholds)):
        last = out[-1][-1] if out else None
        if last and (last.order, last.name) == (c.order, c.name) and all(x <= y for x, y in zip(last.thresholds, c.thresholds)):
            out[-1].append(c)
        else:
            out.append([c])
    return out


def _accepted_spans(per_doc: DataFrame, chains: Sequence[Sequence[CascadeConfig]]) -> DataFrame:
    """(chain, at, docs, hits, cost): what each document adds to and takes from the running sums along a chain.

    A tier accepts at the points below the number of its thresholds that its confidence
    exceeds, so the tier that a document ends in changes only at the running maxima of these
    numbers: a few points per document, whatever the length of the chain. ``c<t>``, ``ok<t>``,
    ``p<t>`` and ``in<t>`` are a tier's confidence, correctness, price, and whether it was tried.
    """
    money, zero = "decimal(20,4)", F.lit(0).cast("decimal(20,4)")
    # one SQL text per tier and chain: numbers and column names only
    below = [F.expr(f"if(in{t}, " + " + ".join(f"int(c{t} > {float(c.thresholds[k])!r}D)" for c in chain) + f", 0) as b{i}_{k}")
             for i, chain in enumerate(chains) for k, t in enumerate(chain[0].order)]
    staged = per_doc.select("*", *below)
    events = []
    for i, chain in enumerate(chains):
        order, n = chain[0].order, len(chain)
        for k, t in enumerate(order):
            first = F.greatest(F.lit(0), F.lit(0), *[F.col(f"b{i}_{j}") for j in range(k)])
            last = F.lit(True)
            for later in order[k + 1:]:
                last = last & ~F.col(f"in{later}")
            end = F.when(last, F.lit(n)).otherwise(F.col(f"b{i}_{k}"))
            cost = zero
            for earlier in order[:k + 1]:
                cost = (cost + F.coalesce(F.col(f"p{earlier}"), zero)).cast(money)
            hit = F.col(f"ok{t}").cast("int")
            here = F.col(f"in{t}") & F.col(f"ok{t}").isNotNull() & (first < end)
            for at, sign in ((first, 1), (end, -1)):
                events.append(F.when(here, F.struct(
                    F.lit(i).alias("chain"), at.alias("at"), F.lit(sign).alias("docs"), (F.lit(sign) * hit).alias("hits"),
                    (F.lit(sign) * cost).cast(money).alias("cost"))))
    return staged.select(F.inline(F.filter(F.array(*events), lambda e: e.isNotNull())))


def threshold_sweep(attempts: DataFrame, grid: Sequence[CascadeConfig], budget: float | None = None) -> DataFrame:
    """Cascade outcome per tier order and threshold set.

    Each document is reduced once to one row with its attempt per tier. Along the points of
    one order it contributes only where its accepted tier changes; these differences are
    summed map-side, and a running sum over the grid gives the outcome at every point.
    Documents lacking a tier skip it; the last tier tried accepts.
    """
    tiers = sorted({t for c in grid for t in c.order})
    best = attempts.groupBy("doc").agg(*[
        F.max(F.when(F.col("tier") == t, F.struct("confidence", "correct", "price"))).alias(f"t{t}") for t in tiers])
    per_doc = best.select(*[F.col(f"t{t}.{c}").alias(f"{short}{t}") for t in tiers
                            for c, short in (("confidence", "c"), ("correct", "ok"), ("price", "p"))],
                          *[F.col(f"t{t}").isNotNull().alias(f"in{t}") for t in tiers])
    chains = _chains(grid)
    steps = _accepted_spans(per_doc, chains).groupBy("chain", "at").agg(
        F.sum("docs").alias("docs"), F.sum("hits").alias("hits"), F.sum("cost").alias("cost"))
    points = F.array(*[F.struct(F.lit(k).alias("chain"), F.lit(at).alias("at"), F.lit(c.name).alias("tier_order"),
                                F.lit(float(c.step)).alias("threshold")) for k, chain in enumerate(chains) for at, c in enumerate(chain)])
    grid_rows = attempts.sparkSession.range(1).select(F.inline(points))
    along = Window.partitionBy("chain").orderBy("at")  # grid-sized
    out = (grid_rows.join(steps, ["chain", "at"], "left")
           .select("tier_order", "threshold", *[F.coalesce(F.sum(c).over(along), F.lit(0)).alias(c) for c in ("docs", "hits", "cost")])
           .where("docs > 0")
           .select("tier_order", "threshold", F.col("docs").cast("bigint").alias("n_docs"),
                   (F.col("hits") / F.col("docs")).alias("accuracy"), F.col("cost").cast("double").alias("total_cost")))
    out = out.withColumn("cost_per_doc", F.col("total_cost") / F.col("n_docs"))
    if budget is not None:
        out = out.withColumn("within_budget", F.col("cost_per_doc") <= F.lit(budget))
    return out


def pareto_frontier(points: DataFrame, cost: str, quality: str, tiebreak: str | Sequence[str]) -> DataFrame:
    """Keep points that strictly improve quality over every cheaper point.

    ``points`` is an aggregated, grid-sized table (one row per configuration).
    """
    ties = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    w = Window.orderBy(F.col(cost), F.col(quality).desc(), *ties).rowsBetween(
        Window.unboundedPreceding, -1)
    best_before = F.max(quality).over(w)
    return points.withColumn("_best", best_before).where(
        F.col("_best").isNull() | (F.col(quality) > F.col("_best"))).drop("_best")


def latency_percentiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """p50 / p95 per group (discrete percentiles), exact at any size."""
    q = exact_quantiles(df, [group], value, [0.5, 0.95])
    return q.select(group, F.col("n").cast("bigint").alias("n"), F.col("q0").alias("p50"), F.col("q1").alias("p95"))


def majority_vote(samples: DataFrame, key: str, answer: str) -> DataFrame:
    """Majority answer per key (ties -> smallest answer) and agreement share."""
    counts = samples.groupBy(key, answer).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(key).agg(
        F.min_by(answer, F.struct((-F.col("c")).alias("neg"), F.col(answer).alias("a"))).alias("answer"),
        F.sum("c").cast("bigint").alias("n_samples"),
        (F.max("c") / F.sum("c")).alias("agreement"))


def semantic_entropy(samples: DataFrame, key: str, answer: str) -> DataFrame:
    """Entropy over clusters of normalised answers, ``-sum(p ln p)``."""
    counts = samples.groupBy(key, normalise_string(F.col(answer)).alias("cluster")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(key)
    p = F.col("c") / F.sum("c").over(w)
    return counts.withColumn("p", p).groupBy(key).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_clusters"),
        exact_sum(-F.col("p") * F.log(F.col("p")), 12).alias("entropy"))


def calibration_bins(df: DataFrame, conf: str, correct: str, bins: int = 10) -> DataFrame:
    """Reliability bins — count, mean confidence, accuracy and their gap."""
    b = F.least(F.floor(F.col(conf) * bins), F.lit(bins - 1)).cast("int")
    out = df.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.avg(conf).alias("avg_conf"),
        F.avg(F.col(correct).cast("double")).alias("accuracy"))
    return out.withColumn("gap", F.abs(F.col("accuracy") - F.col("avg_conf")))


def expected_calibration_error(bins_df: DataFrame) -> DataFrame:
    """ECE = sum(n_b * gap_b) / N over bins (decimal sum, order-independent)."""
    return bins_df.agg((exact_sum(F.col("n") * F.col("gap"), 9) / F.sum("n")).alias("ece"),
                       F.sum("n").cast("bigint").alias("n"))


def mean_logprob(logprobs: Column) -> Column:
    """Mean token log-probability of an array."""
    return F.aggregate(logprobs, F.lit(0.0), lambda acc, x: acc + x.cast("double")) / F.size(logprobs)


def ledger_rows(runs: DataFrame, model: str, quality: str, cost: str, latency: str) -> DataFrame:
    """A5 + S9: one summary row per model with totals and guarded per-record means."""
    n = F.count(F.lit(1))
    out = runs.groupBy(model).agg(
        n.cast("bigint").alias("n_records"), F.avg(F.col(quality).cast("double")).alias("quality"),
        F.sum(cost).cast("double").alias("cost_usd_total"), F.sum(latency).cast("double").alias("latency_s_total"))
    return out.select(
        model, "n_records", "quality", "cost_usd_total",
        F.coalesce(F.try_divide("cost_usd_total", "n_records"), F.lit(0.0)).alias("cost_usd_per_record"),
        "latency_s_total",
        F.coalesce(F.try_divide("latency_s_total", "n_records"), F.lit(0.0)).alias("latency_s_per_record"))

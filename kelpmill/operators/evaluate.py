"""Retrieval evaluation: metrics, tuning, gates and advice."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dcg(hits: Column) -> Column:
    """Sum of binary gains over log2(place + 2) of an array of booleans."""
    return F.aggregate(F.transform(hits, lambda h, i: F.when(h, F.lit(1.0) / F.log2(i + 2)).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)


def ndcg(results: Column, relevant: Column, k: int) -> Column:
    """the ideal list is as long as the shorter of relevant and returned ones."""
    top = F.slice(results, 1, k)
    best = F.least(F.size(relevant), F.size(top))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(best, F.lit(1))), lambda i: F.lit(1.0) / F.log2(i + 1)), F.lit(0.0), lambda a, b: a + b)
    got = dcg(F.transform(top, lambda r: F.array_contains(relevant, r)))
    return F.when(best > 0, got / ideal).otherwise(0.0)


def mrr(results: Column, relevant: Column, k: int) -> Column:
    """F44."""
    place = F.array_position(F.transform(F.slice(results, 1, k), lambda r: F.array_contains(relevant, r)), True)
    return F.when(place > 0, F.lit(1.0) / place).otherwise(0.0)


def fp_penalty(results: Column, irrelevant: Column, k: int) -> Column:
    """irrelevant ones among the first k, over k."""
    return F.size(F.array_intersect(F.slice(results, 1, k), irrelevant)) / F.lit(float(k))


def objective(ndcg10: Column, fp10: Column) -> Column:
    """F46."""
    return ndcg10 - 0.5 * fp10


def metrics(runs: DataFrame) -> DataFrame:
    """Macro averages; the penalty only over queries with irrelevant documents. runs: query, results, relevant, irrelevant."""
    r, p, n = F.col("results"), F.col("relevant"), F.col("irrelevant")
    each = runs.select(ndcg(r, p, 5).alias("n5"), ndcg(r, p, 10).alias("n10"), mrr(r, p, 10).alias("mrr"), F.when(F.size(n) > 0, fp_penalty(r, n, 10)).alias("fp"))
    row = each.agg(F.avg("n5").alias("ndcg5"), F.avg("n10").alias("ndcg10"), F.avg("mrr").alias("mrr10"), F.coalesce(F.avg("fp"), F.lit(0.0)).alias("fp10"), F.count(F.lit(1)).alias("queries"))
    return row.select(*[F.round(c, 6).alias(c) for c in ("ndcg5", "ndcg10", "mrr10", "fp10")], "queries")


def relative_drop(before: Column, after: Column, threshold: float = 0.05) -> Column:
    """no base, no drop."""
    return F.coalesce((before != 0) & ((before - after) / before >= threshold), F.lit(False))


def too_many_deleted(deleted: Column, total: Column, ratio: float = 0.5) -> Column:
    """strictly more than the ratio."""
    return F.coalesce((total > 0) & (deleted / total > ratio), F.lit(False))


def gate(queries: Column, gain: Column, fp_delta: Column) -> Column:
    """E06."""
    return F.when(queries < 30, "too few queries").when(gain < 0.01 - 1e-9, "no gain").when(fp_delta > 0.02 + 1e-9, "more false positives").otherwise("promote")


def coordinate_search(score: Callable[[dict], float], grid: dict[str, list[float]], start: dict[str, float], sweeps: int = 3, least: float = 1e-4) -> tuple[dict, float]:
    """One weight after the other over its grid, strict improvements only."""
    best = {k: min(v, key=lambda x: abs(x - start[k])) for k, v in grid.items()}
    top = score(best)
    for _ in range(sweeps):
        before = top
        for name, values in grid.items():
            for v in values:
                if v != best[name] and (s := score(best | {name: v})) > top + 1e-12:
                    best, top = best | {name: v}, s
        if top - before < least:
            break
    return best, top


def reweighted(lane_rows: DataFrame, weights: DataFrame) -> DataFrame:
    """All candidates of a tuning sweep at once. lane_rows: query, id, lane, rank; weights: candidate, lane, weight, k."""
    return lane_rows.join(weights, "lane").groupBy("candidate", "query", "id").agg(F.round(F.sum(F.col("weight") / (F.col("k") + F.col("rank"))), 9).alias("score"))


STALE_DAYS, GROWN_BY, WORSE_BY = 7, 1000, 0.05  # fixed values


def reindex_reasons(last: Column, now: Column, docs_then: Column, docs_now: Column, before: list[Column], after: list[Column]) -> Column:
    """Reasons for a new index: none made yet, age, growth, any metric worse; an empty array for none."""
    worse = F.lit(False)
    for b, a in zip(before, after):
        worse = worse | relative_drop(b, a, WORSE_BY)
    old = F.unix_micros(now) - F.unix_micros(last) >= F.lit(STALE_DAYS * 86_400_000_000)
    found = F.array_compact(F.array(F.when(old, "stale"), F.when(docs_now - docs_then >= GROWN_BY, "grown"), F.when(worse, "worse")))
    return F.when(last.isNull(), F.array(F.lit("never indexed"))).otherwise(found)


def freshness_alerts(status: DataFrame, stale_seconds: int = 86_400, failures: int = 3) -> DataFrame:
    """Reasons for an alert of each source."""
    reasons = F.array_compact(F.array(F.when(F.col("last_success").isNull(), "never succeeded"), F.when(F.col("stale_seconds") > stale_seconds, "stale"), F.when(F.col("failures") >= failures, "failing")))
    return status.select("source_type", F.array_join(reasons, ",").alias("reasons")).filter("reasons <> ''")


def nearest_rank(values: list[float], p: float) -> float:
    return sorted(values)[max(0, math.ceil(p * len(values)) - 1)] if values else 0.0

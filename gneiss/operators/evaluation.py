"""Retrieval metrics over hits (query, rank, item) and relevance (query, item)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged(hits: DataFrame, truth: DataFrame, query: str, item: str) -> DataFrame:
    """hits with `relevant`. Truth is grouped by query before the join, so each hit stays one row."""
    marked = truth.select(query, item).distinct().withColumn("relevant", F.lit(1))
    return hits.join(marked, [query, item], "left").fillna(0, "relevant")


def per_query(hits: DataFrame, truth: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """query, n_relevant, found, recall, precision (over k, not over what came back), first_rank, reciprocal, ndcg."""
    expected = truth.select(query, item).distinct().groupBy(query).agg(F.count("*").alias("n_relevant"))
    gain = F.col("relevant") / F.log2(F.col("rank") + 1)
    seen = judged(hits.where(F.col("rank") <= k), truth, query, item).groupBy(query).agg(F.sum("relevant").alias("found"), F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first_rank"), F.sum(gain).alias("dcg"))
    all_ = expected.join(seen, query, "left").fillna(0, ["found"]).fillna(0.0, ["dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return all_.select(query, "n_relevant", "found", (F.col("found") / F.col("n_relevant")).alias("recall"), (F.col("found") / k).alias("precision"), "first_rank", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal"), (F.col("dcg") / ideal).alias("ndcg"))


def passed(metrics: DataFrame) -> DataFrame:
    """Adds passed and missing: nothing expected is missing."""
    return metrics.withColumns({"missing": F.col("n_relevant") - F.col("found"), "passed": F.col("found") == F.col("n_relevant")})


def rollup(metrics: DataFrame, by: str) -> DataFrame:
    """Means of recall, precision, reciprocal rank and nDCG, and the share of queries that pass, by a column."""
    return passed(metrics).groupBy(by).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("recall", "precision", "reciprocal", "ndcg")], F.round(F.avg(F.col("passed").cast("int")), 4).alias("pass_rate"))


def pair_modes(a: DataFrame, b: DataFrame, query: str) -> DataFrame:
    """One row for each query: whether b finds more, fewer or as many as a."""
    x, y = a.select(query, F.col("found").alias("base")), b.select(query, F.col("found").alias("other"))
    verdict = F.when(F.col("other") > F.col("base"), "improved").when(F.col("other") < F.col("base"), "worse").otherwise("same")
    return x.join(y, query).select(query, "base", "other", verdict.alias("verdict"))

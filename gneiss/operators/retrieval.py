"""Hits, records and contexts: lookups, merges, boosts, forced hits, parents, siblings, budgets. All run over many queries at
once; every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_hits(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge of two hit lists (keys, score): the larger score, and where the hit came from."""
    x, y = a.select(*keys, F.col("score").alias("sa")), b.select(*keys, F.col("score").alias("sb"))
    source = F.when(F.col("sa").isNotNull() & F.col("sb").isNotNull(), "hybrid").when(F.col("sa").isNotNull(), "vector").otherwise("graph")
    return x.join(y, keys, "full").select(*keys, F.greatest("sa", "sb").alias("score"), source.alias("source"))


def rank_by(rows: DataFrame, query: str, *order: Column | str, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(query).orderBy(*order)))


def boosted(hits: DataFrame, rules: list[tuple[Column, float]]) -> DataFrame:
    """adjusted: the score and the boost of every rule whose condition holds."""
    total = F.col("score")
    for condition, boost in rules:
        total = total + F.when(condition, boost).otherwise(0.0)
    return hits.withColumn("adjusted", total)


def pin(hits: DataFrame, forced: DataFrame, query: str, item: str) -> DataFrame:
    """Forced hits (query, item, place) first, at the query's best score + 10 - 1e-4 x place; each item once."""
    best = hits.groupBy(query).agg(F.max("score").alias("best"))
    pinned = forced.join(best, query).select(query, item, (F.col("best") + 10 - 1e-4 * F.col("place")).alias("score"), F.lit(True).alias("forced"))
    rest = hits.join(forced.select(query, item), [query, item], "left_anti").select(query, item, "score", F.lit(False).alias("forced"))
    return rank_by(pinned.union(rest), query, F.desc("forced"), F.desc("score"), item)


def to_parents(hits: DataFrame, query: str, parent: str, item: str) -> DataFrame:
    """query, parent, score (best), first_rank, matched (items in rank order), rank."""
    grouped = hits.groupBy(query, parent).agg(F.max("score").alias("score"), F.min("rank").alias("first_rank"), F.transform(F.sort_array(F.collect_list(F.struct("rank", item))), lambda x: x[item]).alias("matched"))
    return rank_by(grouped, query, F.desc("score"), "first_rank", parent)


def siblings(contexts: DataFrame, records: DataFrame, parent: str, item: str, order: str, limit: int = 8) -> DataFrame:
    """Other records of each context's parent, the first `limit` by `order`, with the context's score - 1e-3 x place."""
    near = contexts.select("query", parent, F.col(item).alias("own"), "score").join(records.select(parent, item, order), parent).where(F.col("own") != F.col(item))
    placed = near.withColumn("place", F.row_number().over(Window.partitionBy("query", "own").orderBy(order, item)))
    return placed.where(F.col("place") <= limit).select("query", "own", item, "place", (F.col("score") - 1e-3 * F.col("place")).alias("score"))


def diversified(contexts: DataFrame, query: str, group: str) -> DataFrame:
    """The first context of each group first, then the rest, each part in the old order."""
    repeat = (F.row_number().over(Window.partitionBy(query, group).orderBy("rank")) > 1).cast("int")
    return rank_by(contexts.withColumn("repeat", repeat), query, "repeat", "rank", name="place")


def budget(contexts: DataFrame, query: str, size: str, limit: int) -> DataFrame:
    """The contexts before the first that overflows the budget; the first one always stays."""
    w = Window.partitionBy(query).orderBy("rank")
    used = contexts.withColumn("used", F.sum(size).over(w))
    over = F.max((F.col("used") > limit).cast("int")).over(w)
    return used.withColumn("over", over).where((F.col("over") == 0) | (F.col("rank") == 1)).drop("over")


def overlap_free(parts: Column) -> Column:
    """Texts in order without those that an earlier one contains."""
    return F.aggregate(parts, F.array().cast("array<string>"), lambda kept, p: F.when(F.exists(kept, lambda k: F.contains(k, p)), kept).otherwise(F.array_append(kept, p)))

"""Registered evaluation queries. Queries are the benchmark's items; an item is answered by the documents that hold its whole
passage; the modes that are compared are BM25 and token overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation, sparse
from ..operators.containment import contained
from ..sources.tables import settle, table
from .text_queries import _BM25, _OVERLAP, bm25_of, searched

K = 10


def truth(spark: SparkSession, d: str) -> DataFrame:
    """item_id, doc_id: the document holds the item's whole passage."""
    return contained(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return sparse.top_k(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", K)


def _metrics(spark: SparkSession, d: str, *lists: DataFrame) -> list[DataFrame]:
    """Of each list of hits, against one truth."""
    known = settle(truth(spark, d), "truth")
    return [evaluation.per_query(hits, known, "item_id", "doc_id", K) for hits in lists]


def _bm25_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d, _bm25(spark, d))[0]


def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    return truth(spark, d)


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _bm25_metrics(spark, d).select("item_id", "n_relevant", "found", F.round("recall", 4).alias("recall"))


def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _bm25_metrics(spark, d).select("item_id", F.round("precision", 4).alias("precision"))


def mrr(spark: SparkSession, d: str) -> DataFrame:
    """The mean reciprocal rank, with misses as 0 and without them."""
    m = _bm25_metrics(spark, d)
    return m.agg(F.count("*").alias("n"), F.round(F.avg("reciprocal"), 4).alias("mrr"), F.round(F.avg(1 / F.col("first_rank")), 4).alias("mrr_of_found"))


def ndcg(spark: SparkSession, d: str) -> DataFrame:
    return _bm25_metrics(spark, d).select("item_id", "first_rank", F.round("ndcg", 4).alias("ndcg"))


def forbidden_rate(spark: SparkSession, d: str) -> DataFrame:
    """Of each item's first five hits, those in a source that it may not use (src0)."""
    return _forbidden(spark, d, _bm25(spark, d))


def _forbidden(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    hits = found.where("rank <= 5").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return hits.groupBy("item_id").agg(F.sum((F.col("source") == "src0").cast("int")).alias("violations"), F.min(F.when(F.col("source") == "src0", F.col("rank"))).alias("first_violation"))


def _modes(spark: SparkSession, d: str) -> list[DataFrame]:
    """Metrics of BM25 and of token overlap."""
    held = searched(spark, d)
    return _metrics(spark, d, bm25_of(held, K), sparse.overlaps(held, 24))


def mode_rollup(spark: SparkSession, d: str) -> DataFrame:
    a, b = _modes(spark, d)
    return evaluation.rollup(a.withColumn("mode", F.lit("bm25")).unionByName(b.withColumn("mode", F.lit("overlap"))), "mode")


def category_rollup(spark: SparkSession, d: str) -> DataFrame:
    """By the items' length class."""
    size = table(spark, d, "benchmark").select("item_id", F.when(F.length("text") < 150, "short").when(F.length("text") < 300, "medium").otherwise("long").alias("category"))
    return evaluation.rollup(_bm25_metrics(spark, d).join(size, "item_id"), "category")


def failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How many items fail for which reason, in this order: no answer in the corpus, not retrieved, ranked too low (beyond 3)."""
    items = table(spark, d, "benchmark").select("item_id").join(_bm25_metrics(spark, d), "item_id", "left")
    reason = F.when(F.col("n_relevant").isNull(), "out_of_corpus").when(F.col("first_rank").isNull(), "missing_required").when(F.col("first_rank") > 3, "ranked_low").otherwise("none")
    return items.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def mode_pairing(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.pair_modes(*_modes(spark, d), "item_id")


def citation_order(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of hits of one item in which a document of a later source stands above one of an earlier source with the same score class."""
    hits = _bm25(spark, d).join(table(spark, d, "documents").select("doc_id", F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("level")), "doc_id")
    w = Window.partitionBy("item_id").orderBy("rank").rowsBetween(1, Window.unboundedFollowing)
    return hits.select("item_id", "rank", "level", F.min("level").over(w).alias("below")).where("below < level").groupBy("item_id").agg(F.count("*").alias("violations"))


def quality_score(spark: SparkSession, d: str) -> DataFrame:
    """100 x (.45 x (.75 x coverage + .25 x clean) + .55 x mean of four checks), two decimals."""
    found = _bm25(spark, d)
    m = evaluation.passed(*_metrics(spark, d, found)).join(_forbidden(spark, d, found), "item_id")
    clean = 1 - F.least(F.col("violations") / 5, F.lit(1.0))
    checks = ((F.col("found") > 0).cast("int") + (F.coalesce("first_rank", F.lit(99)) == 1).cast("int") + F.col("passed").cast("int") + (F.col("violations") == 0).cast("int")) / 4
    return m.select("item_id", F.round(100 * (0.45 * (0.75 * F.col("recall") + 0.25 * clean) + 0.55 * checks), 2).alias("quality"))


QUERIES = {"ground_truth": ground_truth, "recall_at_k": recall_at_k, "precision_at_k": precision_at_k, "mrr": mrr, "ndcg": ndcg, "forbidden_rate": forbidden_rate, "mode_rollup": mode_rollup, "category_rollup": category_rollup, "failure_reasons": failure_reasons, "mode_pairing": mode_pairing, "citation_order": citation_order, "quality_score": quality_score}

_TRUTH = "truth AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _m(hits: str, name: str) -> str:
    return f"{name} AS (SELECT item_id, n_relevant, coalesce(found, 0) AS found, coalesce(found, 0) / n_relevant AS recall, coalesce(found, 0) / 10 AS precision, first_rank, coalesce(1 / first_rank, 0) AS reciprocal, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM (SELECT item_id, count(*) AS n_relevant FROM truth GROUP BY 1) LEFT JOIN (SELECT item_id, count(*) AS found, min(rank) AS first_rank, sum(1 / log2(rank + 1)) AS dcg FROM {hits} JOIN truth USING (item_id, doc_id) WHERE rank <= 10 GROUP BY 1) USING (item_id))"


_BASE = f"WITH {_BM25}, {_TRUTH}, {_m('bm', 'm')}"
_ROLL = "count(*) AS n, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, round(avg(reciprocal), 4) AS reciprocal, round(avg(ndcg), 4) AS ndcg, round(avg(CASE WHEN found = n_relevant THEN 1 ELSE 0 END), 4) AS pass_rate"
_FORBID = "fb AS (SELECT item_id, sum(CASE WHEN source = 'src0' THEN 1 ELSE 0 END) AS violations, min(rank) FILTER (WHERE source = 'src0') AS first_violation FROM bm JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY 1)"
ORACLES = {
    "ground_truth": f"WITH {_TRUTH} SELECT * FROM truth",
    "recall_at_k": f"{_BASE} SELECT item_id, n_relevant, found, round(recall, 4) AS recall FROM m",
    "precision_at_k": f"{_BASE} SELECT item_id, round(precision, 4) AS precision FROM m",
    "mrr": f"{_BASE} SELECT count(*) AS n, round(avg(reciprocal), 4) AS mrr, round(avg(1 / first_rank), 4) AS mrr_of_found FROM m",
    "ndcg": f"{_BASE} SELECT item_id, first_rank, round(ndcg, 4) AS ndcg FROM m",
    "forbidden_rate": f"WITH {_BM25}, {_FORBID} SELECT * FROM fb",
    "mode_rollup": f"{_BASE}, {_OVERLAP}, {_m('ov', 'o')} SELECT mode, {_ROLL} FROM (SELECT 'bm25' AS mode, * FROM m UNION ALL SELECT 'overlap', * FROM o) GROUP BY mode",
    "category_rollup": f"{_BASE} SELECT category, {_ROLL} FROM (SELECT m.*, CASE WHEN length(text) < 150 THEN 'short' WHEN length(text) < 300 THEN 'medium' ELSE 'long' END AS category FROM m JOIN benchmark USING (item_id)) GROUP BY category",
    "failure_reasons": f"{_BASE} SELECT CASE WHEN n_relevant IS NULL THEN 'out_of_corpus' WHEN first_rank IS NULL THEN 'missing_required' WHEN first_rank > 3 THEN 'ranked_low' ELSE 'none' END AS reason, count(*) AS n FROM benchmark LEFT JOIN m USING (item_id) GROUP BY 1",
    "mode_pairing": f"{_BASE}, {_OVERLAP}, {_m('ov', 'o')} SELECT item_id, m.found AS base, o.found AS other, CASE WHEN o.found > m.found THEN 'improved' WHEN o.found < m.found THEN 'worse' ELSE 'same' END AS verdict FROM m JOIN o USING (item_id)",
    "citation_order": f"WITH {_BM25} SELECT item_id, count(*) AS violations FROM (SELECT item_id, level, min(level) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below FROM (SELECT item_id, rank, CAST(regexp_extract(source, '(\\d+)', 1) AS INT) AS level FROM bm JOIN documents USING (doc_id) WHERE rank <= 10)) WHERE below < level GROUP BY 1",
    "quality_score": f"{_BASE}, {_FORBID} SELECT item_id, round(100 * (0.45 * (0.75 * recall + 0.25 * (1 - least(violations / 5, 1))) + 0.55 * ((CASE WHEN found > 0 THEN 1 ELSE 0 END) + (CASE WHEN coalesce(first_rank, 99) = 1 THEN 1 ELSE 0 END) + (CASE WHEN found = n_relevant THEN 1 ELSE 0 END) + (CASE WHEN violations = 0 THEN 1 ELSE 0 END)) / 4), 2) AS quality FROM m JOIN fb USING (item_id)",
}

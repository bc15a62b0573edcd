"""Registered retrieval queries. Orders are parents and their line items are records; customers ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..sources.tables import table


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """query (the customer), item (order and line as one number), parent (the order), score, rank: larger prices score higher."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("parent"), F.col("o_custkey").alias("query"), "o_orderpriority")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.round(F.col("l_extendedprice") / 100000, 7).alias("score"), "l_returnflag", "l_quantity", "l_linenumber")
    return R.rank_by(li.join(o, "parent"), "query", F.desc("score"), "item")


def record_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The record of each supplier's smallest line: lookup by id list."""
    li = table(spark, d, "lineitem")
    wanted = li.groupBy("l_suppkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("k")).select("l_suppkey", "k.*")
    return li.join(wanted, ["l_suppkey", "l_orderkey", "l_linenumber"]).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").distinct()


def reference_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Records by reference with wildcards: flag R, or flag A in lines 1 and 2, without ship year 1995, in record order, at most 3 a parent."""
    li = table(spark, d, "lineitem").where("(l_returnflag = 'R' or (l_returnflag = 'A' and l_linenumber in (1, 2))) and year(l_shipdate) != 1995")
    return R.rank_by(li.distinct(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").where("rank <= 3").select("l_orderkey", "rank", "l_linenumber", "l_partkey")


def merge_hits(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d).select("query", "parent", "score", "l_returnflag")
    a = h.where("l_returnflag = 'R'").groupBy("query", "parent").agg(F.max("score").alias("score"))
    b = h.where("l_returnflag = 'A'").groupBy("query", "parent").agg(F.max("score").alias("score"))
    return R.merge_hits(a, b, ["query", "parent"])


def _rules() -> list:
    return [(F.col("l_returnflag") == "R", 0.12), (F.col("o_orderpriority").startswith("1"), 0.30), ((F.col("l_linenumber") == 1) & (F.col("l_quantity") > 25), 0.045)]


def rule_boost(spark: SparkSession, d: str) -> DataFrame:
    return R.boosted(_hits(spark, d), _rules()).select("query", "item", F.round("adjusted", 7).alias("adjusted"))


def rerank(spark: SparkSession, d: str) -> DataFrame:
    """The best five of each query by adjusted score, then score, then item."""
    b = R.boosted(_hits(spark, d), _rules()).withColumn("adjusted", F.round("adjusted", 7))
    return R.rank_by(b.drop("rank"), "query", F.desc("adjusted"), F.desc("score"), "item").where("rank <= 5").select("query", "rank", "item", F.round("adjusted", 7).alias("adjusted"))


def pin_forced(spark: SparkSession, d: str) -> DataFrame:
    """The two smallest items of each query are forced."""
    h = _hits(spark, d).select("query", "item", "score").groupBy("query", "item").agg(F.max("score").alias("score"))
    forced = R.rank_by(h, "query", "item", name="place").where("place <= 2").select("query", "item", "place")
    return R.pin(h, forced, "query", "item").where("rank <= 6").select("query", "rank", "item", F.round("score", 7).alias("score"), "forced")


def parent_contexts(spark: SparkSession, d: str) -> DataFrame:
    p = R.to_parents(_hits(spark, d), "query", "parent", "item")
    return p.select("query", "parent", "rank", F.round("score", 7).alias("score"), "first_rank", F.array_join(F.transform("matched", lambda x: x.cast("string")), ",").alias("matched"))


def sibling_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The best hit of each query with the other lines of its order."""
    h = _hits(spark, d)
    s = R.siblings(h.where("rank = 1"), h.select("parent", "item", "l_linenumber"), "parent", "item", "l_linenumber")
    return s.select("query", "own", "item", "place", F.round("score", 7).alias("score"))


def diversify(spark: SparkSession, d: str) -> DataFrame:
    return R.diversified(_hits(spark, d).where("rank <= 12"), "query", "parent").select("query", "place", "item", "rank")


def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The hits of each query until quantities exceed 100."""
    h = _hits(spark, d).withColumn("size", F.col("l_quantity").cast("long"))
    return R.budget(h, "query", "size", 100).select("query", "rank", "item", "used")


QUERIES = {"record_lookup": record_lookup, "reference_lookup": reference_lookup, "merge_hits": merge_hits, "rule_boost": rule_boost, "rerank": rerank, "pin_forced": pin_forced, "parent_contexts": parent_contexts, "sibling_contexts": sibling_contexts, "diversify": diversify, "budget_prefix": budget_prefix}

_H = "h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM (SELECT o_custkey AS query, l_orderkey AS parent, l_orderkey * 10 + l_linenumber AS item, round(l_extendedprice / 100000, 7) AS score, l_returnflag, l_quantity, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey))"
_B = "b AS (SELECT *, score + CASE WHEN l_returnflag = 'R' THEN 0.12 ELSE 0 END + CASE WHEN o_orderpriority LIKE '1%' THEN 0.30 ELSE 0 END + CASE WHEN l_linenumber = 1 AND l_quantity > 25 THEN 0.045 ELSE 0 END AS adjusted FROM h)"
ORACLES = {
    "record_lookup": "SELECT DISTINCT l.l_suppkey, l.l_orderkey, l.l_linenumber, l_partkey, l_quantity FROM lineitem l JOIN (SELECT l_suppkey, min((l_orderkey, l_linenumber)) AS k FROM lineitem GROUP BY 1) w ON l.l_suppkey = w.l_suppkey AND (l.l_orderkey, l.l_linenumber) = w.k",
    "reference_lookup": "SELECT l_orderkey, rank, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank FROM (SELECT DISTINCT * FROM lineitem) WHERE (l_returnflag = 'R' OR (l_returnflag = 'A' AND l_linenumber IN (1, 2))) AND year(l_shipdate) <> 1995) WHERE rank <= 3",
    "merge_hits": f"WITH {_H}, a AS (SELECT query, parent, max(score) AS sa FROM h WHERE l_returnflag = 'R' GROUP BY ALL), b AS (SELECT query, parent, max(score) AS sb FROM h WHERE l_returnflag = 'A' GROUP BY ALL) SELECT query, parent, greatest(sa, sb) AS score, CASE WHEN sa IS NOT NULL AND sb IS NOT NULL THEN 'hybrid' WHEN sa IS NOT NULL THEN 'vector' ELSE 'graph' END AS source FROM a FULL JOIN b USING (query, parent)",
    "rule_boost": f"WITH {_H}, {_B} SELECT query, item, round(adjusted, 7) AS adjusted FROM b",
    "rerank": f"WITH {_H}, {_B} SELECT query, rank, item, round(adjusted, 7) AS adjusted FROM (SELECT query, item, adjusted, row_number() OVER (PARTITION BY query ORDER BY round(adjusted, 7) DESC, score DESC, item) AS rank FROM b) WHERE rank <= 5",
    "pin_forced": f"WITH {_H}, g AS (SELECT query, item, max(score) AS score FROM h GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY item) AS place, max(score) OVER (PARTITION BY query) AS best FROM g) SELECT query, rank, item, round(score, 7) AS score, forced FROM (SELECT query, item, CASE WHEN place <= 2 THEN best + 10 - 1e-4 * place ELSE score END AS score, place <= 2 AS forced, row_number() OVER (PARTITION BY query ORDER BY place <= 2 DESC, CASE WHEN place <= 2 THEN best + 10 - 1e-4 * place ELSE score END DESC, item) AS rank FROM f) WHERE rank <= 6",
    "parent_contexts": f"WITH {_H} SELECT query, parent, row_number() OVER (PARTITION BY query ORDER BY max(score) DESC, min(rank), parent) AS rank, round(max(score), 7) AS score, min(rank) AS first_rank, string_agg(item::VARCHAR, ',' ORDER BY rank) AS matched FROM h GROUP BY query, parent",
    "sibling_contexts": f"WITH {_H} SELECT query, own, item, place, round(score - 1e-3 * place, 7) AS score FROM (SELECT a.query, a.item AS own, b.item, a.score, row_number() OVER (PARTITION BY a.query, a.item ORDER BY b.l_linenumber, b.item) AS place FROM h a JOIN h b ON a.parent = b.parent AND a.item <> b.item WHERE a.rank = 1) WHERE place <= 8",
    "diversify": f"WITH {_H} SELECT query, row_number() OVER (PARTITION BY query ORDER BY again, rank) AS place, item, rank FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query, parent ORDER BY rank) > 1 THEN 1 ELSE 0 END AS again FROM h WHERE rank <= 12)",
    "budget_prefix": f"WITH {_H} SELECT query, rank, item, used FROM (SELECT *, max(CASE WHEN used > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY rank) AS over FROM (SELECT *, sum(l_quantity::BIGINT) OVER (PARTITION BY query ORDER BY rank) AS used FROM h)) WHERE over = 0 OR rank = 1",
}

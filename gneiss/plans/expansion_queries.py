"""Registered queries over pruned expansion. Orders are chunks: each is the source of its customer, and has a priority and a state;
customers refer to each other and have a nation. Priorities, states and nations are few, so most paths lead through frequent nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.expansion import PATTERNS, expand_from_chunks, suffixes
from ..sources.tables import settle, table

LIMIT, SEEDS, LEAST = 8, 3, 0.6

#: The graph, in SQL that Spark and others read: src, dst, kind, confidence.
_SQL = """
 SELECT DISTINCT 'chunk:' || CAST(o_orderkey AS {s}) AS src, 'customer:' || CAST(o_custkey AS {s}) AS dst, 'SOURCE_OF' AS kind, CAST(NULL AS DOUBLE) AS confidence FROM {orders}
 UNION ALL SELECT DISTINCT 'customer:' || CAST(o_custkey AS {s}), 'chunk:' || CAST(o_orderkey AS {s}), 'HAS_SOURCE_CHUNK', CAST(55 + o_orderkey % 45 AS DOUBLE) / 100 FROM {orders}
 UNION ALL SELECT DISTINCT 'chunk:' || CAST(o_orderkey AS {s}), 'priority:' || o_orderpriority, 'HAS_ISSUE_TYPE', CAST(50 + (o_orderkey * 7 + o_custkey) % 50 AS DOUBLE) / 100 FROM {orders}
 UNION ALL SELECT DISTINCT 'chunk:' || CAST(o_orderkey AS {s}), 'state:' || o_orderstatus, 'APPLIES_TO_ACTOR', CAST(50 + (o_orderkey * 11 + o_custkey) % 50 AS DOUBLE) / 100 FROM {orders}
 UNION ALL SELECT DISTINCT 'customer:' || CAST(c_custkey AS {s}), 'nation:' || CAST(c_nationkey AS {s}), 'MENTIONS_TOPIC', CAST(60 + c_custkey % 40 AS DOUBLE) / 100 FROM {customer}
 UNION ALL SELECT DISTINCT 'customer:' || CAST(c_custkey AS {s}), 'customer:' || CAST((c_custkey * 7 + 3) % 100 AS {s}), 'REFERENCES', CAST(70 + c_custkey % 30 AS DOUBLE) / 100 FROM {customer} WHERE c_custkey <> (c_custkey * 7 + 3) % 100
 UNION ALL SELECT DISTINCT 'customer:' || CAST(c_custkey AS {s}), 'customer:' || CAST(c_custkey + 1 AS {s}), 'DETAILS', CAST(NULL AS DOUBLE) FROM {customer} WHERE c_custkey % 3 = 0
"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_SQL.format(s="STRING", orders="{orders}", customer="{customer}"), orders=table(spark, d, "orders"), customer=table(spark, d, "customer"))


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """Every order whose number is divisible by 100 is a seed; three of them make a query."""
    orders = table(spark, d, "orders").where("o_orderkey % 100 = 0")
    return orders.select(F.expr("cast(o_orderkey div 300 as int)").alias("query"), F.col("o_orderkey").alias("place"), F.concat(F.lit("chunk:"), F.col("o_orderkey").cast("string")).alias("seed"))


def chunk_expansion(spark: SparkSession, d: str) -> DataFrame:
    """The strongest chunks of each query over all four patterns."""
    found = expand_from_chunks(_seeds(spark, d), _edges(spark, d), limit=LIMIT, confidence=LEAST, max_seeds=SEEDS)
    return found.select("query", "rank", "chunk", F.array_join("kinds", ">").alias("kinds"), F.array_join("nodes", ">").alias("nodes"), F.round("confidence", 6).alias("confidence"), "depth", F.round("strength", 6).alias("strength"))


def shallow_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Paths of two relations only, of higher confidence."""
    found = expand_from_chunks(_seeds(spark, d), _edges(spark, d), limit=20, confidence=0.8, depth=2, max_seeds=SEEDS)
    return found.select("query", "rank", "chunk", F.array_join("nodes", ">").alias("nodes"), F.round("confidence", 6).alias("confidence"))


def path_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many of its best paths each seed keeps for each pattern, and the confidence of the best and the last."""
    seeds, edges, known, out = _seeds(spark, d), settle(_edges(spark, d), "edges"), {}, None
    for i, hops in enumerate(PATTERNS):
        kept = suffixes(seeds, edges, hops, confidence=LEAST, paths_kept=1, ends_kept=5, is_end=F.col("end").startswith("chunk:"), known=known)
        rows = kept.groupBy(F.col("v").alias("seed"), F.lit(i).alias("pattern")).agg(F.count_distinct("end").alias("n_ends"), F.round(F.max("conf"), 6).alias("best"))
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES = {f.__name__: f for f in (chunk_expansion, shallow_expansion, path_counts)}


def _paths(least: float) -> str:
    refs, taxa = "('REFERENCES', 'DETAILS')", "('MENTIONS_TOPIC', 'APPLIES_TO_ACTOR', 'HAS_ISSUE_TYPE')"
    return f"""WITH edges AS MATERIALIZED ({_SQL.format(s='VARCHAR', orders='orders', customer='customer')}),
  e AS MATERIALIZED (SELECT src, dst, kind, coalesce(confidence, 1.0) AS c FROM edges WHERE coalesce(confidence, 1.0) >= {least}),
  seeds AS (SELECT DISTINCT CAST(o_orderkey // 300 AS INT) AS query, 'chunk:' || o_orderkey AS seed FROM orders WHERE o_orderkey % 100 = 0),
  loose AS (SELECT src AS v, dst AS u, kind, c, src || dst || kind AS k FROM e WHERE kind IN {refs} UNION ALL SELECT dst, src, kind, c, src || dst || kind FROM e WHERE kind IN {refs}),
  paths AS MATERIALIZED (
    SELECT query, seed, b.dst AS chunk, a.kind || '>' || b.kind AS kinds, seed || '>' || a.dst || '>' || b.dst AS nodes, a.c * b.c AS confidence, 2 AS depth, 0 AS pattern, 0.06 AS w FROM seeds JOIN e a ON seed = a.src AND a.kind = 'SOURCE_OF' JOIN e b ON b.src = a.dst AND b.kind = 'HAS_SOURCE_CHUNK'
    UNION ALL SELECT query, seed, b.src, a.kind || '>' || b.kind, seed || '>' || a.dst || '>' || b.src, a.c * b.c, 2, 1, CASE WHEN 'MENTIONS_TOPIC' IN (a.kind, b.kind) THEN 0.11 ELSE 0.09 END FROM seeds JOIN e a ON seed = a.src AND a.kind IN {taxa} JOIN e b ON b.dst = a.dst AND b.kind IN {taxa} AND (b.src <> a.src OR b.kind <> a.kind)
    UNION ALL SELECT query, seed, b.dst, a.kind || '>' || m.kind || '>' || b.kind, seed || '>' || a.dst || '>' || m.u || '>' || b.dst, a.c * m.c * b.c, 3, 2, CASE m.kind WHEN 'DETAILS' THEN 0.24 ELSE 0.20 END FROM seeds JOIN e a ON seed = a.src AND a.kind = 'SOURCE_OF' JOIN loose m ON m.v = a.dst JOIN e b ON b.src = m.u AND b.kind = 'HAS_SOURCE_CHUNK'
    UNION ALL SELECT query, seed, b.dst, a.kind || '>' || m.kind || '>' || t.kind || '>' || b.kind, seed || '>' || a.dst || '>' || m.dst || '>' || t.src || '>' || b.dst, a.c * m.c * t.c * b.c, 4, 3, 0.11 FROM seeds JOIN e a ON seed = a.src AND a.kind = 'SOURCE_OF' JOIN e m ON m.src = a.dst AND m.kind = 'MENTIONS_TOPIC'
      JOIN e t ON t.dst = m.dst AND t.kind = 'MENTIONS_TOPIC' AND t.src <> m.src JOIN e b ON b.src = t.src AND b.kind = 'HAS_SOURCE_CHUNK')"""


def _expanded(limit: int, least: float, depth: int) -> str:
    return f"""{_paths(least)},
  limited AS (SELECT *, row_number() OVER (PARTITION BY query, pattern ORDER BY round(confidence, 9) DESC, chunk, nodes) AS n FROM paths p WHERE depth <= {depth} AND NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query = p.query AND s.seed = p.chunk)),
  scored AS (SELECT *, round(w + 0.05 * confidence - 0.005 * depth, 6) AS strength FROM limited WHERE n <= {max(4 * limit, 20)}),
  best AS (SELECT *, row_number() OVER (PARTITION BY query, chunk ORDER BY strength DESC, depth, pattern, n) AS pick FROM scored),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY strength DESC, depth, round(confidence, 9) DESC, chunk) AS rank FROM best WHERE pick = 1)"""


ORACLES = {
    "chunk_expansion": f"{_expanded(LIMIT, LEAST, 4)} SELECT query, CAST(rank AS INTEGER) AS rank, chunk, kinds, nodes, round(confidence, 6) AS confidence, depth, round(strength, 6) AS strength FROM ranked WHERE rank <= {LIMIT}",
    "shallow_expansion": f"{_expanded(20, 0.8, 2)} SELECT query, CAST(rank AS INTEGER) AS rank, chunk, nodes, round(confidence, 6) AS confidence FROM ranked WHERE rank <= 20",
    "path_counts": f"{_paths(LEAST)} SELECT seed, pattern, least(count(DISTINCT chunk), 5) AS n_ends, round(max(confidence), 6) AS best FROM paths GROUP BY seed, pattern",
}

"""Registered queries from questions to ranked hits. Benchmark items ask, documents are chunks of articles of their source, and a
graph leads from a chunk to those of its article and of its topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion as X
from ..operators.rules import TESTS
from ..sources.tables import table
from .text_queries import _POSTED, _tokens

K, PREFETCH, SEEDS, GRAPH, WEIGHT, LEAST, BOOST = 12, 10, 3, 6, 0.2, 0.6, 0.002

#: What a chunk is of, in SQL that Spark and others read.
_CHUNKS = "SELECT 'chunk:' || CAST(doc_id AS {s}) AS chunk, doc_id, text, source AS document, CAST(doc_id % 7 AS {s}) AS article FROM {documents}"
_EDGES = """SELECT DISTINCT chunk AS src, document || '/' || article AS dst, 'SOURCE_OF' AS kind, CAST(NULL AS DOUBLE) AS confidence FROM {chunks}
 UNION ALL SELECT DISTINCT document || '/' || article, chunk, 'HAS_SOURCE_CHUNK', CAST(50 + doc_id % 50 AS DOUBLE) / 100 FROM {chunks}
 UNION ALL SELECT DISTINCT chunk, 'topic:' || CAST(doc_id % 13 AS {s}), 'HAS_ISSUE_TYPE', CAST(50 + (doc_id * 7) % 50 AS DOUBLE) / 100 FROM {chunks}"""
#: Rules: what a question must hold (any of the phrases of each group), and what it brings.
RULES = {"r1": [[" the ", " de "], [" of ", " la ", " with "]], "r2": [[" in ", " en ", " der "]], "r3": [["that", "die "]], "r4": [[" to "], [" it ", " he ", " and "]]}
BRINGS = [("r1", 1, "plan", 0, "sides"), ("r1", 1, "article", 1, "3"), ("r2", 2, "term", 0, "the"), ("r2", 2, "article", 1, "5"), ("r3", 3, "plan", 0, "pay"), ("r3", 3, "term", 1, "de"), ("r4", 4, "article", 0, "3"), ("r4", 4, "article", 1, "1")]
#: Plans and the articles that a comparison needs: plan, turn, place, document, article, lift.
REQUIRED = [("sides", 0, 0, "src1", "2", 0.30), ("sides", 0, 1, "src3", "0", 0.30), *[("sides", 0, 2 + i, f"src{i}", str(i % 7), 0.30) for i in range(4, 12)], *[("pay", 1, i, f"src{i}", str((i + 3) % 7), 0.25) for i in range(20)]]


def _inputs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    chunks = spark.sql(_CHUNKS.format(s="STRING", documents="{documents}"), documents=table(spark, d, "documents"))
    edges = spark.sql(_EDGES.format(s="STRING", chunks="{chunks}"), chunks=chunks)
    tests = [(rule, g, "any", "query", "contains", x) for rule, groups in RULES.items() for g, phrases in enumerate(groups) for x in phrases]
    return {
        "questions": table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query"), "text"), "chunks": chunks.drop("doc_id"), "edges": edges,
        "tests": spark.createDataFrame(tests, TESTS), "results": spark.createDataFrame(BRINGS, "rule string, rank int, kind string, place int, value string"),
        "required": spark.createDataFrame(REQUIRED, "plan string, turn int, place int, document string, article string, lift double"),
    }


def routed_questions(spark: SparkSession, d: str) -> DataFrame:
    """What the rules bring to each question."""
    x = _inputs(spark, d)
    return X.route(x["questions"], x["tests"], x["results"])


def retrieved(spark: SparkSession, d: str) -> DataFrame:
    """From question to hits: rules, both variants' search, articles asked for, expansion, one list with provenance, boosts and coverage."""
    hits = X.retrieve(**_inputs(spark, d), k=K, prefetch=PREFETCH, graph_limit=GRAPH, graph_weight=WEIGHT, max_seeds=SEEDS, confidence=LEAST, depth=2, article_boost=BOOST)
    return hits.select("query", "rank", "chunk", "score", "source", "vector_score", "graph_score", *[F.array_join(c, ">").alias(c) for c in X.ARRAYS], "article", "promoted")


QUERIES = {f.__name__: f for f in (routed_questions, retrieved)}


def _rows(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join(str(r) for r in rows)}) AS v({names})"


_MET = " UNION ALL ".join(f"SELECT query, '{rule}' AS rule FROM q WHERE " + " AND ".join("(" + " OR ".join(f"contains(text, '{x}')" for x in group) + ")" for group in groups) for rule, groups in RULES.items())
_ROUTED = f"""q AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS query, text FROM benchmark), met AS ({_MET}),
  brought AS (SELECT query, kind, value, min(rank * 10 + place) AS nth FROM met JOIN {_rows(BRINGS, 'rule, rank, kind, place, value')} USING (rule) GROUP BY ALL),
  routed AS MATERIALIZED (SELECT query, kind, value, CAST(row_number() OVER (PARTITION BY query, kind ORDER BY nth) - 1 AS INTEGER) AS n FROM brought)"""
_SEARCHED = f"""chunks AS MATERIALIZED ({_CHUNKS.format(s='VARCHAR', documents='documents')}), {_POSTED},
  variants AS (SELECT query, 0 AS variant, text FROM q UNION ALL SELECT query, 1, text || ' ' || (SELECT string_agg(value, ' ' ORDER BY n) FROM routed r WHERE r.query = q.query AND kind = 'term') FROM q WHERE query IN (SELECT query FROM routed WHERE kind = 'term')),
  asked AS (SELECT query, variant, token, count(*) AS qtf FROM (SELECT query, variant, unnest({_tokens('text')}) AS token FROM variants) GROUP BY ALL),
  bm AS (SELECT query, variant, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * idf * (1 + ln(1 + qtf))), 6) AS score FROM asked JOIN terms USING (token) JOIN posted USING (token) JOIN dl USING (doc_id), st GROUP BY ALL),
  lists AS (SELECT query, 'chunk:' || doc_id AS chunk, row_number() OVER (PARTITION BY query, variant ORDER BY score DESC, 'chunk:' || doc_id) AS rank FROM bm),
  fused AS (SELECT query, chunk, round(sum(1.0 / (60 + rank)), 8) AS score FROM lists WHERE rank <= {PREFETCH} GROUP BY ALL),
  found AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS place FROM fused) WHERE place <= {PREFETCH})"""
_ASKED = f"""missing AS (SELECT query, value AS article, row_number() OVER (PARTITION BY query ORDER BY n) AS turn FROM routed r WHERE kind = 'article' AND (SELECT count(*) FROM routed s WHERE s.query = r.query AND s.kind = 'article') <= 4
    AND NOT EXISTS (SELECT 1 FROM found f JOIN chunks c USING (chunk) WHERE f.query = r.query AND c.article = r.value)),
  extra AS (SELECT query, chunk, row_number() OVER (PARTITION BY query ORDER BY turn, k) AS place FROM missing JOIN (SELECT article, chunk, row_number() OVER (PARTITION BY article ORDER BY chunk) AS k FROM chunks) USING (article) WHERE k <= CASE turn WHEN 1 THEN 4 ELSE 2 END),
  hits AS MATERIALIZED (SELECT query, chunk, score, place FROM found UNION ALL SELECT query, chunk, round(greatest(coalesce((SELECT max(score) FROM found f WHERE f.query = e.query), 0) - 0.001, 0) - (place - 1) * 0.0001, 8), 100 + place FROM extra e)"""
_GRAPH = f"""edges AS MATERIALIZED (SELECT src, dst, kind, coalesce(confidence, 1.0) AS c FROM ({_EDGES.format(s='VARCHAR', chunks='chunks')}) WHERE coalesce(confidence, 1.0) >= {LEAST}),
  seeds AS (SELECT query, chunk AS seed FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY place, chunk) AS k FROM hits) WHERE k <= {SEEDS}),
  paths AS (SELECT query, seed, b.dst AS chunk, [a.kind, b.kind] AS kinds, [seed, a.dst, b.dst] AS nodes, a.c * b.c AS c, 0 AS pattern, 0.06 AS w FROM seeds JOIN edges a ON a.src = seed AND a.kind = 'SOURCE_OF' JOIN edges b ON b.src = a.dst AND b.kind = 'HAS_SOURCE_CHUNK'
    UNION ALL SELECT query, seed, b.src, [a.kind, b.kind], [seed, a.dst, b.src], a.c * b.c, 1, 0.09 FROM seeds JOIN edges a ON a.src = seed AND a.kind = 'HAS_ISSUE_TYPE' JOIN edges b ON b.dst = a.dst AND b.kind = 'HAS_ISSUE_TYPE' AND b.src <> seed),
  limited AS (SELECT *, row_number() OVER (PARTITION BY query, pattern ORDER BY round(c, 9) DESC, chunk, array_to_string(nodes, '>')) AS n FROM paths p WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query = p.query AND s.seed = p.chunk)),
  strong AS (SELECT *, round(w + 0.05 * c - 0.01, 6) AS strength FROM limited WHERE n <= {max(4 * GRAPH, 20)}),
  best AS (SELECT * FROM strong QUALIFY row_number() OVER (PARTITION BY query, chunk ORDER BY strength DESC, pattern, n) = 1),
  graph AS MATERIALIZED (SELECT query, chunk, round(strength * {WEIGHT}, 8) AS score, seed, kinds, nodes FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY strength DESC, round(c, 9) DESC, chunk) AS k FROM best) WHERE k <= {GRAPH})"""
# The last step walks through the two plans one after the other.
_RANKED = f"""joint AS (SELECT query, chunk, greatest(coalesce(h.score, 0), coalesce(g.score, 0)) AS base, CASE WHEN g.chunk IS NULL THEN 'vector' WHEN h.chunk IS NULL THEN 'graph' ELSE 'hybrid' END AS source, coalesce(h.score, 0) AS vector_score, coalesce(g.score, 0) AS graph_score,
    coalesce(seed, '') AS seeds, coalesce(array_to_string(nodes, '>'), '') AS nodes, CASE WHEN kinds[1] = kinds[2] THEN kinds[1] ELSE coalesce(array_to_string(kinds, '>'), '') END AS kinds FROM hits h FULL JOIN graph g USING (query, chunk)),
  boosted AS (SELECT b.*, c.document, c.article, round(base + CASE WHEN EXISTS (SELECT 1 FROM routed r WHERE r.query = b.query AND r.kind = 'article' AND r.value = c.article) THEN {BOOST} ELSE 0 END, 8) AS score FROM joint b JOIN chunks c USING (chunk)),
  p0 AS MATERIALIZED (SELECT *, CAST(NULL AS VARCHAR) AS promoted, row_number() OVER (PARTITION BY query ORDER BY score DESC, base DESC, chunk) AS rank FROM boosted),
  required AS (SELECT * FROM {_rows(REQUIRED, 'plan, turn, place, document, article, lift')})"""


def _after(plan: str, old: str, new: str) -> str:
    return f"""{new}_first AS (SELECT h.query, h.chunk, r.place, r.lift FROM {old} h JOIN required r USING (document, article) JOIN routed o ON o.query = h.query AND o.kind = 'plan' AND o.value = r.plan WHERE r.plan = '{plan}' QUALIFY row_number() OVER (PARTITION BY h.query, r.place ORDER BY h.rank) = 1),
  {new}_kept AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY place) - 1 AS k FROM {new}_first QUALIFY count(*) OVER (PARTITION BY query) >= 2),
  {new} AS MATERIALIZED (SELECT h.query, h.chunk, h.source, h.vector_score, h.graph_score, h.seeds, h.nodes, h.kinds, h.document, h.article, CASE WHEN f.k IS NULL THEN h.promoted ELSE '{plan}' END AS promoted,
    CASE WHEN f.k IS NULL THEN h.score ELSE round(max(h.score) OVER (PARTITION BY h.query) + f.lift - 0.001 * f.k, 8) END AS score, row_number() OVER (PARTITION BY h.query ORDER BY coalesce(f.k, 1000000), h.rank) AS rank FROM {old} h LEFT JOIN {new}_kept f USING (query, chunk))"""


ORACLES = {
    "routed_questions": f"WITH {_ROUTED} SELECT query, kind, value, n FROM routed",
    "retrieved": f"WITH {_ROUTED}, {_SEARCHED}, {_ASKED}, {_GRAPH}, {_RANKED}, {_after('sides', 'p0', 'p1')}, {_after('pay', 'p1', 'p2')} SELECT query, CAST(rank AS INTEGER) AS rank, chunk, score, source, vector_score, graph_score, seeds, nodes, kinds, article, promoted FROM p2 WHERE rank <= {K}",
}

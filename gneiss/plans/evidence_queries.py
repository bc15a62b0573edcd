"""Registered queries over questions and their contexts. An order is a question, its lines are contexts: the parts named by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..sources.tables import table

#: Words of questions that say nothing about their subject.
STOP = ["the", "what", "and", "for"]

#: Contexts and questions in SQL that Spark and others read. Parts with equal names make ties; a question asks for two of its parts.
_CONTEXTS = """SELECT l.question_id, l.place, 'Article ' || CAST(l.p % 230 AS {s}) || ' ' || p_name AS citation, 'About ' || p_brand || '. Of ' || p_name || ' and ' || lower(p_type) || ' goods. ' || p_name || '!' AS body,
  CAST(l.p % 9 AS DOUBLE) / 4 - 0.5 AS score, CASE WHEN l.s % 6 = 5 THEN NULL ELSE CAST(l.s % 6 AS INT) END AS rank, CASE l.s % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'decree' END AS document,
  CASE WHEN l.p % 5 > 0 THEN CAST(l.p % 7 AS {s}) END AS article, 'c' || CAST(l.p % 11 AS {s}) AS chunk_id
  FROM (SELECT l_orderkey AS question_id, CAST(l_linenumber AS INT) AS place, min(l_partkey) AS p, min(l_suppkey) AS s FROM {lineitem} GROUP BY l_orderkey, l_linenumber) l JOIN {part} ON p_partkey = l.p"""
_QUESTIONS = """SELECT question_id, 'What of the ' || min(p_name) || ' and ' || max(p_name) || ' for 30 ' || lower(min(p_type)) || ' goods' AS question
  FROM (SELECT DISTINCT l_orderkey AS question_id, p_name, p_type FROM {lineitem} JOIN {part} ON p_partkey = l_partkey) GROUP BY question_id"""


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tables = {name: table(spark, d, name) for name in ("lineitem", "part")}
    return tuple(spark.sql(q.format(s="STRING", lineitem="{lineitem}", part="{part}"), **tables) for q in (_QUESTIONS, _CONTEXTS))


def evidence_relevance(spark: SparkSession, d: str) -> DataFrame:
    return E.relevance(*_parts(spark, d), STOP).select("question_id", "place", "relevance")


def evidence_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The contexts that are cited, at most three a question, of those that are relevant, the most relevant first within its rank."""
    scored = E.by_relevance(E.relevant(E.relevance(*_parts(spark, d), STOP)))
    return E.selected(scored, 3).select("question_id", "cited_at", "citation", "rank", "relevance")


def evidence_sentences(spark: SparkSession, d: str) -> DataFrame:
    questions, contexts = _parts(spark, d)
    asked = questions.select("question_id", E.terms(F.col("question"), STOP).alias("wanted"))
    return contexts.join(asked, "question_id").select("question_id", "place", E.best_sentence(F.col("body"), F.col("wanted"), r"[.!]+").alias("sentence"))


QUERIES = {f.__name__: f for f in (evidence_relevance, evidence_contexts, evidence_sentences)}

_STOPPED = ", ".join(f"'{w}'" for w in STOP)
_BASE = f"""WITH contexts AS MATERIALIZED ({_CONTEXTS.format(s='VARCHAR', lineitem='lineitem', part='part')}), questions AS MATERIALIZED ({_QUESTIONS.format(lineitem='lineitem', part='part')}),
  words AS (SELECT question_id, unnest(string_split(lower(question), ' ')) AS term, generate_subscripts(string_split(lower(question), ' '), 1) AS pos FROM questions),
  once AS (SELECT question_id, term, min(pos) AS pos FROM words WHERE length(term) >= 3 AND try_cast(term AS BIGINT) IS NULL AND term NOT IN ({_STOPPED}) GROUP BY ALL),
  t AS MATERIALIZED (SELECT question_id, term, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS i FROM once),
  runs AS (SELECT question_id, a.term || ' ' || b.term AS phrase FROM t a JOIN t b USING (question_id) WHERE b.i = a.i + 1
    UNION SELECT question_id, a.term || ' ' || b.term || ' ' || c.term FROM t a JOIN t b USING (question_id) JOIN t c USING (question_id) WHERE b.i = a.i + 1 AND c.i = a.i + 2
    UNION SELECT question_id, a.term || ' ' || b.term || ' ' || c.term || ' ' || e.term FROM t a JOIN t b USING (question_id) JOIN t c USING (question_id) JOIN t e USING (question_id) WHERE b.i = a.i + 1 AND c.i = a.i + 2 AND e.i = a.i + 3),
  asked AS (SELECT question_id, term AS x, 2.5 AS high, 1.0 AS low FROM t UNION ALL SELECT question_id, phrase, 8.0, 4.0 FROM runs WHERE length(phrase) >= 8),
  points AS (SELECT c.question_id, place, sum(CASE WHEN contains(lower(citation), x) THEN high WHEN contains(lower(citation || ' ' || body), x) THEN low ELSE 0 END) AS met FROM contexts c JOIN asked a ON a.question_id = c.question_id GROUP BY ALL),
  scored AS MATERIALIZED (SELECT c.*, CAST(round(coalesce(met, 0) + least(greatest(score, 0), 1) + greatest(4 - coalesce(rank, 0), 0) * 0.05, 6) AS DOUBLE) AS relevance FROM contexts c LEFT JOIN points p ON p.question_id = c.question_id AND p.place = c.place)"""
ORACLES = {
    "evidence_relevance": f"{_BASE} SELECT question_id, place, relevance FROM scored",
    # A context is taken if fewer than three are before it; a recursive walk over the contexts in the order in which they are looked at.
    "evidence_contexts": f"""{_BASE.replace('WITH contexts', 'WITH RECURSIVE contexts', 1)}, best AS (SELECT *, max(relevance) OVER w AS best, min(place) OVER w AS opening FROM scored WINDOW w AS (PARTITION BY question_id)),
      ok AS (SELECT *, best <= 0 OR relevance >= greatest(8, best * 0.6) AS fits FROM best), judged AS (SELECT *, bool_or(fits) OVER (PARTITION BY question_id) AS fitting FROM ok),
      placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY relevance DESC, place) AS pos, coalesce(document, '') || '/' || coalesce(article, chunk_id) AS key FROM judged WHERE fits OR (NOT fitting AND place = opening)),
      looked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY phase, pos) AS step FROM (SELECT *, rank AS phase, CASE rank WHEN 1 THEN 3 ELSE 2 END AS quota FROM placed WHERE rank IN (1, 2, 3) UNION ALL SELECT *, 9, 9 FROM placed)),
      walk AS (SELECT question_id, CAST(0 AS BIGINT) AS step, CAST([] AS VARCHAR[]) AS keys, CAST([] AS INTEGER[]) AS phases, CAST([] AS BIGINT[]) AS taken FROM questions
        UNION ALL SELECT w.question_id, l.step, CASE WHEN {{take}} THEN list_append(keys, key) ELSE keys END, CASE WHEN {{take}} THEN list_append(phases, CAST(phase AS INTEGER)) ELSE phases END, CASE WHEN {{take}} THEN list_append(taken, pos) ELSE taken END
        FROM walk w JOIN looked l ON l.question_id = w.question_id AND l.step = w.step + 1),
      ended AS (SELECT question_id, arg_max(taken, step) AS taken FROM walk GROUP BY question_id), cited AS (SELECT question_id, unnest(taken) AS pos, generate_subscripts(taken, 1) - 1 AS cited_at FROM ended)
      SELECT c.question_id, cited_at, citation, rank, relevance FROM cited c JOIN placed p ON p.question_id = c.question_id AND p.pos = c.pos""".replace("{take}", "len(keys) < 3 AND NOT list_contains(keys, key) AND len(list_filter(phases, lambda f: f = phase)) < quota"),
    # What the body's three sentences say is known from the columns.
    "evidence_sentences": f"""{_BASE}, said AS (SELECT question_id, place, 1 AS i, 'About ' || p_brand AS sentence FROM (SELECT c.question_id, place, string_split(body, '. ')[1][7:] AS p_brand FROM contexts c)
        UNION ALL SELECT question_id, place, 2, string_split(body, '. ')[2] FROM contexts UNION ALL SELECT question_id, place, 3, rtrim(string_split(body, '. ')[3], '!') FROM contexts),
      held AS (SELECT s.question_id, place, s.i, sentence, count(*) FILTER (WHERE t.i <= 3 AND contains(lower(sentence), term)) = count(*) FILTER (WHERE t.i <= 3) AS three, bool_or(contains(lower(sentence), term)) AS one FROM said s JOIN t ON t.question_id = s.question_id GROUP BY ALL)
      SELECT question_id, place, arg_min(sentence, CASE WHEN three THEN 0 WHEN one THEN 10 ELSE 20 END + i) AS sentence FROM held GROUP BY question_id, place""",
}

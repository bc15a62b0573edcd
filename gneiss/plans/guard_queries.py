"""Registered queries over answers and the contexts that they were given. An order is an answer, its lines are contexts and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guard as G
from ..operators.citations import HINTS
from ..sources.tables import table
from .citation_queries import _OVERLAP, _hints, _norm, _surface

#: How an answer says, in folded form, that its contexts do not suffice.
INSUFFICIENT = ["khong du can cu trong du lieu hien co", "chua du can cu", "khong du can cu"]

#: Contexts, requests and answers in SQL that Spark and others read.
_CONTEXTS = """SELECT answer, index, p, s, CASE s % 4 WHEN 0 THEN 'Điều ' || CAST(p % 230 AS {s}) || ', khoản ' || CAST(s % 5 + 1 AS {s}) || ' Bộ luật Lao động' WHEN 1 THEN 'Bộ luật Lao động, Điều ' || CAST(p % 230 AS {s})
    WHEN 2 THEN 'Điều ' || CAST(p % 230 AS {s}) || ' (Phạm vi ' || CAST(s AS {s}) || '), khoản ' || CAST(s % 5 + 1 AS {s}) ELSE 'Nghị định 145/2020/NĐ-CP, Điều ' || CAST(p % 230 AS {s}) || ', khoản ' || CAST(s % 5 + 1 AS {s}) || ', điểm b' END AS citation,
  CASE WHEN s % 3 > 0 THEN CAST(p % 230 AS {s}) END AS article, CASE s % 4 WHEN 3 THEN 2 WHEN 2 THEN NULL ELSE 1 END AS rank
  FROM (SELECT l_orderkey AS answer, CAST(l_linenumber AS INT) AS index, min(l_partkey) AS p, min(l_suppkey) AS s FROM {lineitem} GROUP BY l_orderkey, l_linenumber)"""
_REQUESTS = """SELECT answer, index AS place, CASE (p + s) % 6 WHEN 0 THEN citation WHEN 1 THEN upper(citation) WHEN 2 THEN 'Điều ' || CAST(p % 230 AS {s}) WHEN 3 THEN replace(citation, 'Điều ', 'Điều 9') WHEN 4 THEN 'xem ' || citation ELSE replace(citation, ', khoản', ';  khoản') END AS citation
  FROM {contexts} WHERE p % 7 > 0"""
_ANSWERS = """SELECT answer, CASE WHEN answer % 5 = 4 THEN 'Không rõ. ' ELSE 'Theo ' || citation || ', có quyền. ' END || CASE WHEN answer % 3 = 0 THEN 'Xem thêm Điều ' || CAST(answer % 230 AS {s}) || '. ' ELSE '' END || CASE WHEN answer % 22 = 0 THEN 'Chưa đủ căn cứ.' ELSE '' END AS text, answer % 11 = 0 AS insufficient
  FROM (SELECT answer, citation, row_number() OVER (PARTITION BY answer ORDER BY place) AS n FROM {requests}) WHERE n = 1"""


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = table(spark, d, "lineitem").repartition("l_orderkey")  # an answer's rows stay together from here on
    contexts = spark.sql(_CONTEXTS.format(s="STRING", lineitem="{lineitem}"), lineitem=lines)
    requests = spark.sql(_REQUESTS.format(s="STRING", contexts="{contexts}"), contexts=contexts)
    return contexts, requests, spark.sql(_ANSWERS.format(s="STRING", requests="{requests}"), requests=requests)


def canonical_citations(spark: SparkSession, d: str) -> DataFrame:
    contexts, requests, _ = _parts(spark, d)
    return G.canonical_citations(requests, contexts)


def answer_basis(spark: SparkSession, d: str) -> DataFrame:
    contexts, requests, _ = _parts(spark, d)
    return G.legal_basis(G.canonical_citations(requests, contexts)).select("answer", F.array_join("basis", " | ").alias("basis"))


def answer_verdicts(spark: SparkSession, d: str) -> DataFrame:
    contexts, requests, answers = _parts(spark, d)
    return G.validate_answers(answers, requests, contexts, INSUFFICIENT).withColumn("unsupported_articles", F.array_join("unsupported_articles", ","))


QUERIES = {f.__name__: f for f in (canonical_citations, answer_basis, answer_verdicts)}

_BASE = f"""WITH contexts AS MATERIALIZED ({_CONTEXTS.format(s='VARCHAR', lineitem='lineitem')}), requests AS MATERIALIZED ({_REQUESTS.format(s='VARCHAR', contexts='contexts')}), answers AS ({_ANSWERS.format(s='VARCHAR', requests='requests')}),
  cs AS MATERIALIZED (SELECT *, {_norm('citation')} AS a, {_surface('citation')} AS c, {_hints('citation')} AS t FROM contexts), rs AS MATERIALIZED (SELECT *, {_norm('citation')} AS b, {_surface('citation')} AS d, {_hints('citation')} AS u FROM requests),
  met AS (SELECT rs.answer AS answer, place, rs.citation AS citation, index, cs.citation AS meant, a = b AS same, {_OVERLAP} AS near, abs(len(t) - len(u)) AS apart, abs(length(a) - length(b)) AS longer FROM rs JOIN cs ON rs.answer = cs.answer),
  picked AS (SELECT answer, place, meant, row_number() OVER (PARTITION BY answer, place ORDER BY same DESC, CASE WHEN same THEN 0 ELSE apart END, CASE WHEN same THEN 0 ELSE longer END, index, meant) AS n FROM met WHERE same OR near),
  canonical AS MATERIALIZED (SELECT r.answer, r.place, r.citation, p.meant AS canonical FROM requests r LEFT JOIN picked p ON p.answer = r.answer AND p.place = r.place AND n = 1)"""
_NUMBERS = "regexp_extract_all({}, '" + HINTS[0][1] + "', 1)"
ORACLES = {
    "canonical_citations": f"{_BASE} SELECT answer, place, citation, canonical FROM canonical",
    "answer_basis": f"{_BASE}, once AS (SELECT answer, canonical, min(place) AS seen FROM canonical WHERE canonical IS NOT NULL GROUP BY ALL) SELECT answer, string_agg(canonical, ' | ' ORDER BY seen, canonical) AS basis FROM once GROUP BY answer",
    "answer_verdicts": f"""{_BASE}, texts AS (SELECT answer, insufficient, {_norm('text')} AS x, {_surface('text')} AS y FROM answers),
      said AS (SELECT r.answer, bool_or(contains(x, b) OR (d <> '' AND contains(y, d))) AS said FROM rs r JOIN texts t ON t.answer = r.answer GROUP BY r.answer),
      named AS (SELECT answer, unnest({_NUMBERS.format('x')}) AS n FROM texts UNION SELECT answer, unnest({_NUMBERS.format('b')}) FROM rs),
      known AS (SELECT answer, article AS n FROM contexts WHERE article IS NOT NULL UNION SELECT answer, unnest({_NUMBERS.format('a')}) FROM cs),
      extra AS (SELECT answer, string_agg(n, ',' ORDER BY length(n), n) AS articles FROM (SELECT * FROM named EXCEPT SELECT * FROM known) GROUP BY answer),
      ranks AS (SELECT answer, min(rank) AS highest FROM contexts GROUP BY answer), cited AS (SELECT r.answer, min(c.rank) AS cited FROM requests r JOIN contexts c ON c.answer = r.answer AND c.citation = r.citation GROUP BY r.answer),
      missed AS (SELECT answer, count(*) FILTER (WHERE canonical IS NULL) AS n FROM canonical GROUP BY answer),
      v AS (SELECT t.answer, insufficient OR coalesce(said, false) AS has_citation, coalesce(m.n, 0) AS n_unretrieved, coalesce(articles, '') AS unsupported_articles, NOT coalesce(cited > highest, false) AS keeps_rank, NOT insufficient OR contains(x, 'du can cu') AS says_insufficient
        FROM texts t LEFT JOIN said USING (answer) LEFT JOIN missed m USING (answer) LEFT JOIN extra USING (answer) LEFT JOIN ranks USING (answer) LEFT JOIN cited USING (answer))
      SELECT *, n_unretrieved = 0 AS citations_allowed, has_citation AND n_unretrieved = 0 AND unsupported_articles = '' AND keeps_rank AND says_insufficient AS passed FROM v""",
}

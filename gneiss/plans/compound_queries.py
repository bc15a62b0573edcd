"""Registered queries over compound citations. An order is a benchmark case: its lines make the fragments of two citation fields, and
some of them again what was observed. The SQL knows from the numbers what each fragment names and reads no text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compound as P
from ..sources.tables import table

#: Two documents, how they are cited, and what tells them.
FAMILIES = [P.Family("bo_luat_2019", "Bộ luật Lao động 2019", ("bo luat lao dong 2019", "45 2019 qh14")), P.Family("nghi_dinh_145", "Nghị định 145/2020/NĐ-CP", ("nghi dinh 145 2020 nd cp", "145 2020 nd cp"))]
DOCUMENTS = [("bo_luat_2019", r"\b(?:45\s*/\s*2019\s*/\s*qh\s*14|bo luat lao dong 2019)\b"), ("nghi_dinh_145", r"\b(?:145\s*/\s*2020\s*/\s*nd\s*cp|nghi dinh 145)\b")]
SCOPE = ["bo_luat_2019"]

#: What a fragment says of article a, the next article b, clause c and the next clause d.
SHAPES = ("Điều {a}", "Khoản {c} Điều {a}", "các điểm a, b và đ  khoản {c} Điều {a}", "Điều {a} và Điều {b}", "khoản {c} và khoản {d}, Điều {a}", "khoản {c} Điều {a}, Điều {b}", "(điểm c) Điều {a}", "Phụ lục {a}")
_FRAGMENTS = """SELECT case_id, line, CASE WHEN line <= 3 THEN 0 ELSE 1 END AS field, p, s, (p + line) % 8 AS shape, CASE p % 3 WHEN 0 THEN 'bo_luat_2019' WHEN 1 THEN 'nghi_dinh_145' END AS own,
  CAST(p % 230 + 1 AS {s}) || CASE WHEN p % 10 = 0 THEN 'a' ELSE '' END AS a, CAST(p % 230 + 2 AS {s}) AS b, CAST(s % 9 + 1 AS {s}) AS c, CAST(s % 9 + 2 AS {s}) AS d
  FROM (SELECT l_orderkey AS case_id, l_linenumber AS line, min(l_partkey) AS p, min(l_suppkey) AS s FROM {lineitem} GROUP BY l_orderkey, l_linenumber)"""
_LABELLED = "CASE {x} WHEN 'bo_luat_2019' THEN ' Bộ luật Lao động 2019' WHEN 'nghi_dinh_145' THEN ' Nghị định 145/2020/NĐ-CP' ELSE '' END"


def _said() -> str:
    cases = " ".join(f"WHEN {i} THEN '" + shape.replace("{", "' || ").replace("}", " || '") + "'" for i, shape in enumerate(SHAPES))
    return f"CASE shape {cases} END || {_LABELLED.format(x='own')}"


def _fragments(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").repartition("l_orderkey")  # a case's rows stay together from here on
    return spark.sql(_FRAGMENTS.format(s="STRING", lineitem="{lineitem}"), lineitem=lines)


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Every order, so that some cases have no citations."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"))


def _atoms(spark: SparkSession, d: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("line", F.expr(_said()).alias("said"))))
    fields = _fragments(spark, d).groupBy("case_id", "field").agg(F.array_join(F.transform(parts, lambda x: x["said"]), " ; ").alias("text"))
    return P.atoms(fields, FAMILIES)


def compound_atoms(spark: SparkSession, d: str) -> DataFrame:
    """The atomic citations of each case, with the document that each names."""
    return _atoms(spark, d).withColumn("family", P.family(F.col("citation"), FAMILIES))


def citation_scopes(spark: SparkSession, d: str) -> DataFrame:
    return P.scopes(_cases(spark, d), _atoms(spark, d), FAMILIES, SCOPE)


def _scores(spark: SparkSession, d: str, allowed: list[str] | None, mode: str) -> DataFrame:
    seen = F.expr("'Điều ' || a || CASE WHEN s % 4 = 0 THEN ' khoản ' || c ELSE '' END || CASE WHEN s % 6 = 0 THEN '' ELSE " + _LABELLED.format(x="own") + " END")
    observed = _fragments(spark, d).where("s % 2 = 0").select("case_id", F.col("line").alias("rank"), seen.alias("citation"))
    return P.scores(_cases(spark, d), _atoms(spark, d), observed, FAMILIES, DOCUMENTS, allowed=allowed, mode=mode, k=3)


def compound_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, None, "containment")


def scoped_scores(spark: SparkSession, d: str) -> DataFrame:
    """Within the code alone, with all parts named."""
    return _scores(spark, d, SCOPE, "normalized")


QUERIES = {f.__name__: f for f in (compound_atoms, citation_scopes, compound_scores, scoped_scores)}

_ATOMS = f"""WITH f AS (SELECT *, CASE WHEN min(own) OVER w = max(own) OVER w THEN min(own) OVER w END AS sole FROM ({_FRAGMENTS.format(s='VARCHAR', lineitem='lineitem')}) WINDOW w AS (PARTITION BY case_id, field)),
  named AS (SELECT *, CASE WHEN shape IN (5, 7) THEN own ELSE coalesce(own, sole) END AS fam, {_said()} AS said,
    CASE shape WHEN 2 THEN ['a', 'b', 'd'] WHEN 6 THEN ['c'] ELSE [NULL] END AS zs, CASE shape WHEN 4 THEN [c, d] WHEN 1 THEN [c] WHEN 2 THEN [c] WHEN 5 THEN [c] ELSE [NULL] END AS ys, CASE shape WHEN 3 THEN [a, b] WHEN 5 THEN [NULL] WHEN 7 THEN [NULL] ELSE [a] END AS xs FROM f),
  one AS (SELECT case_id, line * 10 + i AS nth, fam AS family, shape = 7 AS other, xs[CASE WHEN len(xs) > 1 THEN i ELSE 1 END] AS x, ys[CASE WHEN len(ys) > 1 THEN i ELSE 1 END] AS y, zs[CASE WHEN len(zs) > 1 THEN i ELSE 1 END] AS z, shape, said
    FROM (SELECT *, unnest(range(1, greatest(len(xs), len(ys), len(zs)) + 1)) AS i FROM named)),
  cited AS (SELECT *, CASE WHEN shape IN (5, 7) THEN said ELSE 'Điều ' || x || coalesce(' khoản ' || y, '') || coalesce(' điểm ' || z, '') || {_LABELLED.format(x='family')} END AS citation FROM one),
  atoms AS MATERIALIZED (SELECT case_id, citation, min(nth) AS nth, any_value(family) AS family, bool_or(other) AS other, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z FROM cited GROUP BY case_id, citation)"""


def _scored(scoped: bool, broad: bool) -> str:
    inside = f"(family IS NULL OR family IN ('{SCOPE[0]}'))" if scoped else "true"
    clause, point = ("(e.y IS NULL OR o.y IS NULL OR e.y = o.y)", "true") if broad else ("(e.y IS NULL OR coalesce(e.y = o.y, false))", "e.z IS NULL")
    met = f"(o.rank IS NOT NULL AND (e.family IS NULL OR o.family IS NULL OR e.family = o.family) AND NOT (e.other AND e.family IS NULL) AND (e.x IS NULL OR e.x = o.x) AND {clause} AND {point})"
    none = "na" if scoped else "no"

    def verdict(n: str, met: str, none: str) -> str:
        return f"CASE WHEN coalesce({n}, 0) = 0 THEN '{none}' WHEN NOT seen THEN 'no' WHEN {met} = {n} THEN 'exact' WHEN {met} > 0 THEN 'partial' ELSE 'no' END"

    return f"""{_ATOMS}, e AS (SELECT * FROM atoms WHERE {inside}), o AS (SELECT case_id, line AS rank, a AS x, CASE WHEN s % 4 = 0 THEN c END AS y, CASE WHEN s % 6 <> 0 THEN own END AS family FROM f WHERE s % 2 = 0),
      pairs AS (SELECT e.case_id, e.citation, any_value(e.family) AS family, count(o.rank) > 0 AS seen, coalesce(bool_or({met}), false) AS covered, coalesce(bool_or({met} AND o.rank <= 3), false) AS early, coalesce(bool_or(e.family = o.family), false) AS same FROM e LEFT JOIN o ON o.case_id = e.case_id GROUP BY e.case_id, e.citation),
      n AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE covered) AS k, bool_or(seen) AS seen, bool_or(early) AS hit, count(DISTINCT family) AS nf, count(DISTINCT CASE WHEN same THEN family END) AS kf FROM pairs GROUP BY case_id)
      SELECT c.case_id, coalesce(n, 0) AS n_expected, coalesce(k, 0) AS n_covered, {verdict('n', 'k', none)} AS citation_score, {verdict('nf', 'kf', 'na')} AS document_score, CASE WHEN n > 0 THEN hit ELSE {'NULL' if scoped else 'false'} END AS hit
      FROM (SELECT DISTINCT o_orderkey AS case_id FROM orders) c LEFT JOIN n USING (case_id)"""


ORACLES = {
    "compound_atoms": f"{_ATOMS} SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY nth) - 1 AS INTEGER) AS place, citation, family FROM atoms",
    "citation_scopes": f"""{_ATOMS}, n AS (SELECT case_id, count(*) FILTER (WHERE coalesce(family, '{SCOPE[0]}') = '{SCOPE[0]}') AS n_in, count(*) FILTER (WHERE family <> '{SCOPE[0]}') AS n_out FROM atoms GROUP BY case_id)
      SELECT case_id, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, CASE WHEN n_in IS NULL THEN 'no_gold_citation' WHEN n_in > 0 AND n_out > 0 THEN 'mixed_scope' WHEN n_in > 0 THEN 'in_scope' ELSE 'out_of_scope' END AS scope
      FROM (SELECT DISTINCT o_orderkey AS case_id FROM orders) LEFT JOIN n USING (case_id)""",
    "compound_scores": _scored(False, True),
    "scoped_scores": _scored(True, False),
}

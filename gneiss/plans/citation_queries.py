"""Registered queries over citations. The citations are made from orders: each names a document, an article, clauses and points in
the ways in which people write them (accents, lists, brackets, loose spacing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..operators import citations as C
from ..sources.tables import table

#: Patterns and signatures that tell the documents.
DOCUMENTS: C.Documents = [("code_2019", r"\b(?:45\s*/\s*2019\s*/\s*qh\s*14|bo luat lao dong 2019)\b"), ("decree_145", r"\b(?:145\s*/\s*2020\s*/\s*nd\s*cp|nghi dinh 145)\b")]
SIGNATURES = [("code", ["bo luat lao dong", "45 2019 qh14"]), ("decree", ["nghi dinh 145"])]

CITES = """
SELECT o_orderkey AS cite_id, o_custkey AS case_id, o_orderkey % 2 = 0 AS expected,
  concat('Điều ', CAST(o_orderkey % 6 + 1 AS STRING), CASE WHEN o_orderkey % 5 = 0 THEN 'a' ELSE '' END,
    CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ', khoản 1' WHEN 2 THEN ',  các khoản 1 , 2 và 3' ELSE '; Khoản 2 [mới]' END,
    CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ', điểm b' ELSE ' các điểm a, đ và b.1' END,
    CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN ' Bộ luật Lao động 2019' WHEN 2 THEN ' (45 / 2019 / QH14)' WHEN 3 THEN ' Nghị định 145' ELSE ' của Luật này' END) AS cite,
  CAST(o_orderkey % 6 + 1 AS STRING) AS article,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_orderkey % 4 AS STRING) END AS clause,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'đ' ELSE 'b.1' END AS point
FROM orders"""


def _cites(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(CITES.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


def citation_forms(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("cite")
    return _cites(spark, d).select("cite_id", C.citation_form(c).alias("form"), C.letters_and_digits(c).alias("signature"), C.surface(c).alias("surface"), C.letters_and_digits(F.concat(c, F.lit(" 5%")), "%").alias("quote"))


def citation_parts(spark: SparkSession, d: str) -> DataFrame:
    p = _cites(spark, d).select("cite_id", C.parse(F.col("cite"), DOCUMENTS).alias("p"))
    return p.select("cite_id", "p.document", "p.article", F.array_join("p.clauses", ",").alias("clauses"), F.array_join("p.points", ",").alias("points"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each citation of a case with the next one."""
    return _cites(spark, d).withColumn("other", F.lead("cite").over(Window.partitionBy("case_id").orderBy("cite_id"))).where("other is not null")


def citation_matches(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).select("cite_id", "cite", "other", C.parse(F.col("cite"), DOCUMENTS).alias("a"), C.parse(F.col("other"), DOCUMENTS).alias("b"))
    return p.select("cite_id", C.contains(F.col("a"), F.col("b")).alias("broad"), C.contains(F.col("a"), F.col("b"), broad=False).alias("strict"), C.literal_match(F.col("cite"), F.col("other")).alias("literal"))


def citation_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("cite_id", C.overlap(F.col("cite"), F.col("other")).alias("overlaps"))


def citation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Per case: its even-numbered citations are the expected ones, the others were observed (a few for each case)."""
    p = _cites(spark, d).select("case_id", "expected", C.parse(F.col("cite"), DOCUMENTS).alias("p"))
    case = p.groupBy("case_id").agg(F.collect_list(F.when(F.col("expected"), F.col("p"))).alias("e"), F.collect_list(F.when(~F.col("expected"), F.col("p"))).alias("o"))
    return case.select("case_id", C.correctness(F.col("e"), F.col("o")).alias("score"), C.correctness(F.col("e"), F.col("o"), scoped=True).alias("scoped"))


def citation_hints(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("cite")
    return _cites(spark, d).select("cite_id", F.array_join(C.hint_tokens(c), " ").alias("hints"), F.array_join(C.article_numbers(F.concat(c, F.lit("; điều 9 và Điều 9, dieu 10b"))), " ").alias("articles"), F.array_join(C.families(c, SIGNATURES), ",").alias("families"))


def citation_ids(spark: SparkSession, d: str) -> DataFrame:
    article, clause, point = (F.col(c) for c in ("article", "clause", "point"))
    points = F.when(point != "", F.array(point, F.lit("đ.2"))).otherwise(F.array().cast("array<string>"))
    doc = F.concat(F.lit("doc-"), (F.col("case_id") % 5).cast("string"))
    return _cites(spark, d).select(
        "cite_id", C.level(clause, point).alias("level"), C.chunk_id(F.lit("LAW_1"), article, clause, points).alias("chunk_id"), C.citation_text(F.lit("Law 1"), article, clause, points).alias("citation"),
        C.node_id(doc, F.concat(F.lit("dieu-"), article), clause, point).alias("node_id"), C.metadata_token("tag", F.col("cite")).alias("tag"), C.reference_token("khoan", clause).alias("ref"), C.id_token(F.col("cite")).alias("token"), C.url_uuid(F.col("cite")).alias("uuid"),
    )


def level_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per case: its parts by level."""
    at = _cites(spark, d).select("case_id", C.level(F.col("clause"), F.col("point")).alias("level"))
    return at.groupBy("case_id").agg(*[F.count_if(F.col("level") == x).alias(f"n_{x}") for x in ("article", "clause", "point")])


def point_order(spark: SparkSession, d: str) -> DataFrame:
    """The distinct points of each case in alphabetical order, with d before stroked d before e, and b.2 before b.10."""
    made = "array('e', 'đ', 'd', 'b.10', 'b.2', 'b', 'z', '')"
    p = _cites(spark, d).select("case_id", F.expr(f"element_at({made}, cast(cite_id % 8 as int) + 1)").alias("point")).distinct()
    return p.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(C.point_key(F.col("point")))), lambda x: x["point"]), " ").alias("points"))


def repeated_lines_removed(spark: SparkSession, d: str) -> DataFrame:
    """Each document without lines that repeat an earlier one in folded form; blank lines stay."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("form", fold(F.col("line")))
    n = F.row_number().over(Window.partitionBy("doc_id", "form").orderBy("pos"))
    kept = lines.withColumn("n", n).where("n = 1 or form = ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("k"))
    return kept.select("doc_id", F.size("k").alias("n_kept"), F.md5(F.array_join(F.transform("k", lambda x: x["line"]), "\n").cast("binary")).alias("kept_md5"))


def placeholders(spark: SparkSession, d: str) -> DataFrame:
    """Which rows are still templates; every ninth item is made one."""
    made = F.concat("text", F.when(F.col("item_id") % 9 == 0, " see [Article] at Example.com").otherwise(""))
    return table(spark, d, "benchmark").select("item_id", C.placeholder(made).alias("is_placeholder"))


def word_safe_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Each text in pieces of at most 400 characters that end at white space."""
    p = table(spark, d, "documents").where("text is not null").select("doc_id", C.cut_at_spaces(F.col("text"), 400).alias("p"))
    return p.select("doc_id", F.size("p").alias("n_pieces"), F.coalesce(F.array_max(F.transform("p", F.length)), F.lit(0)).alias("longest"), F.md5(F.array_join("p", "|").cast("binary")).alias("pieces_md5"))


QUERIES = {f.__name__: f for f in (citation_forms, citation_parts, citation_matches, citation_overlaps, citation_scores, citation_hints, citation_ids, level_counts, point_order, repeated_lines_removed, placeholders, word_safe_pieces)}


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(replace(replace({x}, 'đ', 'd'), 'Đ', 'D'))), '\\s+', ' ', 'g'))"


def _form(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_norm(x)}, '[;:()\\[\\]{{}}]', ' ', 'g'), '\\s*/\\s*', '/', 'g'), '\\s*,\\s*', ', ', 'g'), '\\s+', ' ', 'g'))"


def _bare(x: str, more: str = "") -> str:
    return f"trim(regexp_replace({_norm(x)}, '[^a-z0-9{more}]+', ' ', 'g'))"


def _surface(x: str) -> str:
    return _bare(f"regexp_replace({x}, '\\([^)]*\\)', ' ', 'g')")


def _values(form: str, pattern: str) -> str:
    split = f"flatten(list_transform(regexp_extract_all({form}, '{pattern}', 1), lambda v: regexp_split_to_array(v, '{C.LIST}')))"
    return f"list_sort(list_distinct(list_filter(list_transform({split}, lambda x: regexp_replace(x, '\\s+', '', 'g')), lambda x: x <> '')))"


def _once(x: str) -> str:
    """A list's members once each, in order."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def _hints(x: str) -> str:
    return "list_concat(" + ", ".join(f"list_transform(regexp_extract_all({_norm(x)}, '{p}', 1), lambda v: '{n}_' || v)" for n, p in C.HINTS) + ")"


def _parsed(x: str) -> str:
    form = _form(x)
    documents = " ".join(f"WHEN regexp_matches({form}, '{p}') THEN '{n}'" for n, p in DOCUMENTS)
    articles = f"list_distinct(regexp_extract_all({form}, '{C.ARTICLE}', 1))"
    return f"struct_pack(document := CASE {documents} END, article := CASE WHEN len({articles}) = 1 THEN {articles}[1] END, clauses := {_values(form, C.CLAUSES)}, points := {_values(form, C.POINTS)})"


def _contains(a: str, b: str, broad: str) -> str:
    part = " AND ".join(f"(len({b}.{n}) = 0 OR CASE WHEN len({a}.{n}) > 0 THEN list_has_all({a}.{n}, {b}.{n}) ELSE {broad} END)" for n in ("clauses", "points"))
    says = f"({b}.document IS NOT NULL OR {b}.article IS NOT NULL OR len({b}.clauses) > 0 OR len({b}.points) > 0)"
    return f"({says} AND coalesce({b}.document = {a}.document, true) AND ({b}.article IS NULL OR coalesce({b}.article = {a}.article, false)) AND {part})"


def _trimmed(x: str, signs: str, more: str = "") -> str:
    return f"regexp_replace(regexp_replace({x}, '[^{signs}]+', '_', 'g'), '^_+|_+$', '', 'g')"


_CITES = f"WITH cites AS ({CITES.replace('AS STRING', 'AS VARCHAR')})"
_PAIRS = f"{_CITES}, pairs AS (SELECT * FROM (SELECT *, lead(cite) OVER (PARTITION BY case_id ORDER BY cite_id) AS other FROM cites) WHERE other IS NOT NULL)"
_PLAIN = "strip_accents(replace(replace({}, 'đ', '{}'), 'Đ', '{}'))"
_LEVEL = "CASE WHEN point <> '' THEN 'point' WHEN clause <> '' THEN 'clause' ELSE 'article' END"
_FAMILIES = ", ".join("CASE WHEN " + " OR ".join(f"contains({_bare('cite')}, '{s}')" for s in own) + f" THEN '{name}' END" for name, own in SIGNATURES)
_OVERLAP = """(a <> '' AND b <> '' AND (a = b OR (c <> '' AND c = d) OR ((len(t) = 0 OR len(u) = 0 OR list_has_all(u, t) OR list_has_all(t, u))
  AND (contains(a, b) OR contains(b, a) OR (c <> '' AND contains(d, c)) OR (d <> '' AND contains(c, d))))))"""
_POINT_AT = "list_position(['" + "', '".join(C.LETTERS) + "'], split_part(point, '.', 1))"

ORACLES = {
    "citation_forms": f"{_CITES} SELECT cite_id, {_form('cite')} AS form, {_bare('cite')} AS signature, {_surface('cite')} AS surface, {_bare(chr(40) + 'cite || ' + chr(39) + ' 5%' + chr(39) + chr(41), '%')} AS quote FROM cites",
    "citation_parts": f"{_CITES} SELECT cite_id, p.document AS document, p.article AS article, array_to_string(p.clauses, ',') AS clauses, array_to_string(p.points, ',') AS points FROM (SELECT cite_id, {_parsed('cite')} AS p FROM cites)",
    "citation_matches": f"{_PAIRS} SELECT cite_id, {_contains('a', 'b', 'true')} AS broad, {_contains('a', 'b', 'false')} AS strict, f <> '' AND g <> '' AND (contains(f, g) OR contains(g, f)) AS literal FROM (SELECT cite_id, {_parsed('cite')} AS a, {_parsed('other')} AS b, {_form('cite')} AS f, {_form('other')} AS g FROM pairs)",
    "citation_overlaps": f"{_PAIRS} SELECT cite_id, {_OVERLAP} AS overlaps FROM (SELECT cite_id, {_norm('cite')} AS a, {_norm('other')} AS b, {_surface('cite')} AS c, {_surface('other')} AS d, {_hints('cite')} AS t, {_hints('other')} AS u FROM pairs)",
    "citation_scores": f"""{_CITES}, parsed AS (SELECT case_id, expected, cite_id, {_parsed('cite')} AS p FROM cites),
      hit AS (SELECT e.case_id, e.cite_id, coalesce(bool_or({_contains('o.p', 'e.p', 'true')}), false) AS covered FROM parsed e LEFT JOIN parsed o ON o.case_id = e.case_id AND NOT o.expected WHERE e.expected GROUP BY ALL),
      n AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE covered) AS k FROM hit GROUP BY case_id)
      SELECT c.case_id, CASE WHEN n IS NULL THEN 'no' WHEN n = k THEN 'exact' WHEN k > 0 THEN 'partial' ELSE 'no' END AS score, CASE WHEN n IS NULL THEN 'na' WHEN n = k THEN 'exact' WHEN k > 0 THEN 'partial' ELSE 'no' END AS scoped
      FROM (SELECT DISTINCT case_id FROM cites) c LEFT JOIN n USING (case_id)""",
    "citation_hints": f"{_CITES} SELECT cite_id, array_to_string({_hints('cite')}, ' ') AS hints, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), ' ') AS articles, array_to_string(list_filter([{_FAMILIES}], lambda v: v IS NOT NULL), ',') AS families FROM (SELECT *, regexp_extract_all({_norm(chr(40) + 'cite || ' + chr(39) + '; điều 9 và Điều 9, dieu 10b' + chr(39) + chr(41))}, '{C.HINTS[0][1]}', 1) AS x FROM cites)",
    "citation_ids": f"""{_CITES} SELECT cite_id, {_LEVEL} AS level,
      'LAW_1_Dieu_' || article || CASE WHEN clause <> '' THEN '_Khoan_' || clause ELSE '' END || CASE point WHEN '' THEN '' WHEN 'đ' THEN '_Diem_dd_dd2' ELSE '_Diem_b1_dd2' END AS chunk_id,
      'Law 1, Điều ' || article || CASE WHEN clause <> '' THEN ', khoản ' || clause ELSE '' END || CASE WHEN point <> '' THEN ', các điểm ' || point || ', đ.2' ELSE '' END AS citation,
      CASE WHEN clause <> '' AND point <> '' THEN 'point:' || doc || ':dieu-' || article || ':khoan-' || clause || ':diem-' || point WHEN clause <> '' THEN 'clause:' || doc || ':dieu-' || article || ':khoan-' || clause ELSE 'article:' || doc || ':dieu-' || article END AS node_id,
      'tag_' || {_trimmed(f"replace({_norm('cite')}, ' ', '_')", 'a-z0-9_.')} AS tag, CASE WHEN clause <> '' THEN 'khoan_' || clause END AS ref,
      {_trimmed(_PLAIN.format('trim(cite)', 'd', 'D'), 'A-Za-z0-9')} AS token,
      substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][(position(substr(h, 17, 1) IN '0123456789abcdef') - 1) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
      FROM (SELECT *, 'doc-' || (case_id % 5)::VARCHAR AS doc, sha1(unhex('{C.URL_SPACE}') || encode(cite)) AS h FROM cites)""",
    "level_counts": f"{_CITES} SELECT case_id, " + ", ".join(f"count(*) FILTER (WHERE {_LEVEL} = '{x}') AS n_{x}" for x in ("article", "clause", "point")) + " FROM cites GROUP BY case_id",
    "point_order": f"""{_CITES} SELECT case_id, string_agg(point, ' ' ORDER BY place, tail, point) AS points FROM (
      SELECT *, CASE WHEN point = '' THEN 10000 ELSE coalesce({_POINT_AT} - 1, 1000 + ascii(point)) END AS place, CASE WHEN contains(point, '.') THEN split_part(point, '.', 2)::INT ELSE -1 END AS tail
      FROM (SELECT DISTINCT case_id, ['e', 'đ', 'd', 'b.10', 'b.2', 'b', 'z', ''][cite_id % 8 + 1] AS point FROM cites)) GROUP BY case_id""",
    "repeated_lines_removed": f"""SELECT doc_id, count(*) AS n_kept, md5(string_agg(line, chr(10) ORDER BY pos)) AS kept_md5 FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, form ORDER BY pos) AS n FROM (
        SELECT doc_id, pos, line, {_norm('line')} AS form FROM (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))))
      WHERE n = 1 OR form = '' GROUP BY doc_id""",
    "placeholders": "SELECT item_id, " + " OR ".join(f"contains(x, '{p}')" for p in C.PLACEHOLDERS) + " AS is_placeholder FROM (SELECT item_id, lower(trim(coalesce(text || CASE WHEN item_id % 9 = 0 THEN ' see [Article] at Example.com' ELSE '' END, ''))) AS x FROM benchmark)",
    "word_safe_pieces": r"""SELECT doc_id, len(p) AS n_pieces, coalesce(list_max(list_transform(p, lambda x: length(x))), 0) AS longest, md5(array_to_string(p, '|')) AS pieces_md5
      FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '(?s)\S.{0,398}\S(?:\s|\z)|\S(?:\s|\z)|\S+', 0), lambda x: regexp_replace(x, '\s+\z', '')) AS p FROM documents WHERE text IS NOT NULL)""",
}

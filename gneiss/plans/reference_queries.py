"""Registered queries over references in running text: spans with raw places, targets, edges, reports.

The texts are the lines of all documents, each followed by a sentence that refers to other texts in one of ten ways, with numbers
that come from the line. The SQL never searches a text: it knows from the numbers what each sentence says and where.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold
from ..operators import references as X
from ..operators.citations import level
from ..operators.spans import Pattern, drop_hidden, find_spans
from ..sources.tables import table

#: Patterns of references and names of documents, over folded text.
LEAD = r"(?:(?:theo|tai|can cu|quy dinh tai|duoc quy dinh tai|theo quy dinh tai)\s+)*"
OF = r"(?:\s+(?:cua|tai|thuoc|boi)?\s*(?P<document>bo luat lao dong(?: nam 2019)?|luat lao dong 2019|bo luat to tung dan su|blttds|bo luat to tung hinh su|bo luat dan su|luat bao hiem xa hoi|nghi dinh nay|thong tu nay|luat nay))?"
PATTERNS = [
    Pattern("multi_clause_reference", LEAD + r"khoan\s+(?P<clauses>\d+(?:\s*,\s*\d+)*(?:\s+va\s+\d+)?)\s+dieu\s+(?P<article>\d+[a-z]?)" + OF, ("article_reference",), r"diem\s+[a-z](?:\.\d+)?\s+"),
    Pattern("article_reference", LEAD + r"(?:diem\s+(?P<point>[a-z](?:\.\d+)?)\s+)?(?:khoan\s+(?P<clause>\d+)\s+)?dieu\s+(?P<article>\d+[a-z]?)" + OF),
    Pattern("document_reference", r"(?P<kind>nghi dinh|thong tu)\s+(?P<number>0?\d{1,3})\s*/\s*(?P<year>\d{4})(?:\s*/\s*(?P<suffix>nd\s*-?\s*cp|tt\s*-\s*bldtbxh))?"),
]
#: The patterns of the rule for whole texts.
CROSS = [
    Pattern("article", r"(?P<prefix>theo quy dinh tai|tru truong hop quy dinh tai|quy dinh tai)?\s*(?:(?:diem)\s+(?P<point>[a-z](?:\.\d+)?)\s+)?(?:(?:khoan)\s+(?P<clause>\d+)\s+)?(?:dieu)\s+(?P<article>\d+[a-z]?)"),
    Pattern("decree", r"nghi dinh\s+(?P<number>\d+)\s*/\s*(?P<year>\d{4})\s*/\s*nd\s*-?\s*cp"),
]
DOCUMENTS = {"nghi dinh": "nghi-dinh-%d-%s-nd-cp", "thong tu": "thong-tu-%02d-%s-tt-bldtbxh"}
NAMES = X.Names(
    aliases=(
        ("bo luat lao dong", "45-2019-qh14"), ("bo luat lao dong nam 2019", "45-2019-qh14"), ("luat lao dong 2019", "45-2019-qh14"),
        ("nghi dinh 145", "nghi-dinh-145-2020-nd-cp"), ("nghi dinh 145/2020", "nghi-dinh-145-2020-nd-cp"), ("nghi dinh 135", "nghi-dinh-135-2020-nd-cp"), ("nghi dinh 135/2020", "nghi-dinh-135-2020-nd-cp"),
        ("thong tu 09", "thong-tu-09-2020-tt-bldtbxh"), ("thong tu 09/2020", "thong-tu-09-2020-tt-bldtbxh"), ("thong tu 10", "thong-tu-10-2020-tt-bldtbxh"), ("thong tu 10/2020", "thong-tu-10-2020-tt-bldtbxh"),
        ("bo luat to tung dan su", "92-2015-qh13-labor-only"), ("blttds", "92-2015-qh13-labor-only"),
        ("bo luat to tung hinh su", "external-bo-luat-to-tung-hinh-su"), ("bo luat dan su", "external-bo-luat-dan-su"), ("luat bao hiem xa hoi", "external-luat-bao-hiem-xa-hoi"),
    ),
    relative=(("nghi dinh nay", "nghi-dinh", {}), ("thong tu nay", "thong-tu", {}), ("luat nay", "", {"219": "external-quoted-amended-law"})),
    scopes=("nghi-dinh-145-2020-nd-cp", "nghi-dinh-135-2020-nd-cp", "thong-tu-09-2020-tt-bldtbxh", "thong-tu-10-2020-tt-bldtbxh"),
    scope_target="45-2019-qh14",
)
CODES = ("45-2019-qh14", "92-2015-qh13-labor-only")
MARK = "quy dinh:"

#: The documents that the texts stand for, and what stands before a third of them once more.
OWN = ("45-2019-qh14", "nghi-dinh-145-2020-nd-cp", "nghi-dinh-135-2020-nd-cp", "thong-tu-09-2020-tt-bldtbxh", "thong-tu-10-2020-tt-bldtbxh", "van-ban-1")
CITED = "Trích dẫn Điều 5 quy định: "
GAP = " || "
#: What stands before each kind of reference, the reference, and what stands behind it.
_PLAIN = [
    ("Không có gì", "", "."), ("Việc này làm ", "theo quy định tại  Điều {a}", " nêu trên."), ("Xem ", "khoản {c}\tĐiều {a} của Bộ luật Lao động", " để biết."), ("Áp dụng ", "điểm {p} khoản {c} Điều {a} Nghị định này", " thôi."),
    ("Các ", "khoản {c}, {e} và {f} Điều {a} của Thông tư này", " cũng vậy."), ("Xem ", "Nghị định {a}/{y}/NĐ-CP", " của Chính phủ."), ("Nêu ", "tại Điều {a}", " ghi ở Thông tư 09/2020 ban hành."), ("Cả ", "Điều {a}", " và Điều {a} đều đúng."),
    ("Xem ", "khoản {c} Điều {a} luật này", " nữa."), ("Làm ", "Theo Điều {a}a của Bộ luật Dân sự", ", nay Nghị định 135 cũng ghi."),
]
SENTENCES = [tuple(unicodedata.normalize("NFD", x) for x in s) if k == 8 else s for k, s in enumerate(_PLAIN)]

_NUMBERS = """SELECT doc_id, pos, line, (doc_id * 7 + pos) % 10 AS k, (length(line) * 13 + doc_id) % 240 + 1 AS a, pos % 9 + 1 AS c, pos % 9 + 2 AS e, pos % 9 + 4 AS f, 2010 + pos % 15 AS y,
  substring('abce', CAST(doc_id % 4 AS INT) + 1, 1) AS p, CAST(doc_id % 230 + 1 AS {s}) AS article_number, CASE WHEN pos % 4 > 0 THEN CAST(pos % 4 AS {s}) END AS clause_ref, CASE WHEN pos % 4 > 0 AND pos % 3 = 0 THEN 'b' END AS point_ref FROM lines"""


def _filled(text: str, kind: str) -> str:
    """SQL for a template with its numbers, in Spark and elsewhere."""
    out = "'" + text.replace("'", "''") + "'"
    for name in "acefyp":
        if f"{{{name}}}" in text:
            out = f"replace({out}, '{{{name}}}', CAST({name} AS {kind}))"
    return out


def _case(values: list[str]) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = spark.sql(_NUMBERS.format(s="STRING").replace("FROM lines", "FROM {lines}"), lines=lines)
    sentence = F.expr(_case([_filled("".join(s), "STRING") for s in SENTENCES]))
    own = F.element_at(F.array(*map(F.lit, OWN)), (F.col("doc_id") % len(OWN)).cast("int") + 1)
    text = F.concat("line", F.lit(GAP), sentence)
    return rows.select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("chunk_id"), own.alias("document_id"), "article_number", "clause_ref", "point_ref", level(F.col("clause_ref"), F.col("point_ref")).alias("level"),
        text.alias("text"), F.when(F.col("pos") % 3 == 0, F.concat(F.lit(CITED), text)).alias("retrieval_text"), rank(own).alias("document_type_rank"),
    )


def rank(document: Column) -> Column:
    return F.when(document.isin(*CODES), 1).when(document.startswith("nghi-dinh"), 2).when(document.startswith("thong-tu"), 3)


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = _chunks(spark, d)
    return chunks, X.parse_references(chunks, [("text", None), ("retrieval_text", MARK)], PATTERNS, NAMES, DOCUMENTS)


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks, found = _references(spark, d)
    return chunks, X.reference_edges(chunks, found, rank)


def reference_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every match that no other hides, with its place in the raw text and the raw text there."""
    spans = find_spans(_chunks(spark, d), ["chunk_id"], "text", PATTERNS)
    return drop_hidden(spans, ["chunk_id"], PATTERNS).select("chunk_id", "pattern", "raw_start", "raw_end", "raw", "matched")


def reference_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The distinct articles, clauses and points that each text names."""
    named = _chunks(spark, d).select("chunk_id", X.legal_references(fold(F.col("text"))).alias("x"))
    return named.select("chunk_id", *[F.array_join(F.col(f"x.{c}"), " ").alias(c) for c in ("articles", "clauses", "points")])


def reference_targets(spark: SparkSession, d: str) -> DataFrame:
    """What each reference refers to, from the text and from the text that repeats it behind its citation."""
    return _references(spark, d)[1].select("chunk_id", "part", "pattern", "item", "raw_start", "normalized", "target_document", "target_id", "level", "confidence")


def cross_references(spark: SparkSession, d: str) -> DataFrame:
    """References by one rule for the whole text, with the raw text behind each."""
    return X.cross_references(_chunks(spark, d), "text", CROSS, "nghi-dinh-%s-%s-nd-cp", main=("bo luat lao dong", CODES[0]), prefix="nghi-dinh")


def reference_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)[1].select("edge_id", "source_id", "target_id", "edge_type", "chunk_id", "source_document", "target_document", "normalized", "method", "confidence", "level", "target_article", "target_clause", "target_point", "resolved", "duplicates")


def reference_summary(spark: SparkSession, d: str) -> DataFrame:
    return X.summarize_edges(_edges(spark, d)[1])


def reference_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Why edges do not resolve, by source document."""
    chunks, edges = _edges(spark, d)
    reasons = X.unresolved_reasons(edges, X.known_nodes(chunks))
    return reasons.join(edges.select("edge_id", "source_document"), "edge_id").groupBy("source_document", "reason").agg(F.count("*").alias("n"))


def reference_double_targets(spark: SparkSession, d: str) -> DataFrame:
    """Matches of one source that lead to several targets."""
    groups = _edges(spark, d)[1].groupBy("source_id", "normalized").agg(F.count_distinct("target_id").alias("n_targets"), F.array_join(F.array_sort(F.collect_set("target_id")), " ").alias("targets"))
    return groups.where("n_targets > 1")


QUERIES = {f.__name__: f for f in (reference_spans, reference_numbers, reference_targets, cross_references, reference_edges, reference_summary, reference_gaps, reference_double_targets)}


def _fold(x: str) -> str:
    plain = unicodedata.normalize("NFKD", x.replace("đ", "d").replace("Đ", "D"))
    return " ".join("".join(c for c in plain if not unicodedata.combining(c)).lower().split())


def _said() -> str:
    """A row for each thing that a sentence says: kind, place, pattern, item, what stands before it, it, and parts of its target."""
    scope = "CASE WHEN own IN (" + ", ".join(f"'{x}'" for x in NAMES.scopes) + f") AND article_number = '1' THEN '{NAMES.scope_target}' ELSE own END"
    code, s = "'45-2019-qh14'", SENTENCES
    a, c = "CAST(a AS VARCHAR)", "CAST(c AS VARCHAR)"
    multi, article, document = (p.name for p in PATTERNS)
    rows = [
        (1, 1, article, 0, s[1][0], s[1][1], scope, a, "NULL", "NULL"), (2, 0, multi, 0, s[2][0], s[2][1], code, a, c, "NULL"),
        (3, 1, article, 0, s[3][0], s[3][1], f"CASE WHEN own LIKE 'nghi-dinh%' THEN own ELSE {scope} END", a, c, "p"),
        *[(4, 0, multi, i, s[4][0], s[4][1], f"CASE WHEN own LIKE 'thong-tu%' THEN own ELSE {scope} END", a, f"CAST({v} AS VARCHAR)", "NULL") for i, v in enumerate("cef")],
        (5, 2, document, 0, s[5][0], s[5][1], "'nghi-dinh-' || a || '-' || y || '-nd-cp'", "NULL", "NULL", "NULL"),
        (6, 1, article, 0, s[6][0], s[6][1], "'thong-tu-09-2020-tt-bldtbxh'", a, "NULL", "NULL"), (6, 2, document, 0, s[6][0] + s[6][1] + " ghi ở ", "Thông tư 09/2020", "'thong-tu-09-2020-tt-bldtbxh'", "NULL", "NULL", "NULL"),
        (7, 1, article, 0, s[7][0], s[7][1], scope, a, "NULL", "NULL"), (7, 1, article, 0, s[7][0] + s[7][1] + " và ", "Điều {a}", scope, a, "NULL", "NULL"),
        (8, 0, multi, 0, s[8][0], s[8][1], "CASE WHEN article_number = '219' THEN 'external-quoted-amended-law' ELSE own END", a, c, "NULL"),
        (9, 1, article, 0, s[9][0], s[9][1], "'external-bo-luat-dan-su'", f"{a} || 'a'", "NULL", "NULL"),
    ]
    return " UNION ALL ".join(
        f"SELECT *, {place} AS place, '{pattern}' AS pattern, {item} AS item, length({_filled(before, 'VARCHAR')}) AS before, {_filled(it, 'VARCHAR')} AS raw, {_filled(_fold(it), 'VARCHAR')} AS matched, {target} AS target_document, {x} AS article, {y} AS clause, {z} AS point FROM texts WHERE k = {k}"
        for k, place, pattern, item, before, it, target, x, y, z in rows
    )


def _crossed() -> str:
    """A row for each reference by the rule for whole texts: kind, what is met, its level and parts."""
    a, c, s = "CAST(a AS VARCHAR)", "CAST(c AS VARCHAR)", SENTENCES
    rows = [
        (1, s[1][1], "article", "NULL", a, "NULL", "NULL"), (2, s[2][1].removesuffix(" của Bộ luật Lao động"), "clause", "NULL", a, c, "NULL"), (3, s[3][1].removesuffix(" Nghị định này"), "point", "NULL", a, c, "p"), (4, "Điều {a}", "article", "NULL", a, "NULL", "NULL"),
        (5, s[5][1], "document", "'nghi-dinh-' || a || '-' || y || '-nd-cp'", "NULL", "NULL", "NULL"), (6, "Điều {a}", "article", "NULL", a, "NULL", "NULL"), *[(7, "Điều {a}", "article", "NULL", a, "NULL", "NULL")] * 2,
        (8, s[8][1].removesuffix(unicodedata.normalize("NFD", " luật này")), "clause", "NULL", a, c, "NULL"), (9, "Điều {a}a", "article", "NULL", f"{a} || 'a'", "NULL", "NULL"),
    ]
    return " UNION ALL ".join(
        f"SELECT *, {_filled(it, 'VARCHAR')} AS raw, {_filled(_fold(it), 'VARCHAR')} AS matched, '{level}' AS level, {document} AS document, {x} AS article, {y} AS clause, {z} AS point FROM texts WHERE k = {k}" for k, it, level, document, x, y, z in rows
    )


def _node(document: str, article: str, clause: str, point: str) -> str:
    return f"""CASE WHEN {article} IS NULL THEN 'document:' || {document} WHEN {clause} IS NULL THEN 'article:' || {document} || ':dieu-' || {article} WHEN {point} IS NULL THEN 'clause:' || {document} || ':dieu-' || {article} || ':khoan-' || {clause}
      ELSE 'point:' || {document} || ':dieu-' || {article} || ':khoan-' || {clause} || ':diem-' || {point} END"""


def _rank(x: str) -> str:
    return f"CASE WHEN {x} IN {CODES} THEN 1 WHEN {x} LIKE 'nghi-dinh%' THEN 2 WHEN {x} LIKE 'thong-tu%' THEN 3 END"


_SAID = f"""WITH lines AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
  texts AS (SELECT *, doc_id || '-' || pos AS chunk_id, {list(OWN)}[doc_id % {len(OWN)} + 1] AS own FROM ({_NUMBERS.format(s='VARCHAR')})),
  said AS (SELECT *, length(line) + {len(GAP)} + before AS raw_start FROM ({_said()}))"""
_REFS = f"""{_SAID}, refs AS (SELECT chunk_id, 0 AS part, place, pattern, item, raw_start, matched, target_document, article, clause, point, own, article_number, clause_ref, point_ref FROM said
    UNION ALL SELECT chunk_id, 1, place, pattern, item, raw_start + {len(CITED)}, matched, target_document, article, clause, point, own, article_number, clause_ref, point_ref FROM said WHERE pos % 3 = 0),
  targets AS (SELECT *, CASE place WHEN 0 THEN matched || '#khoan-' || clause ELSE matched END AS normalized, {_node('target_document', 'article', 'clause', 'point')} AS target_id,
    CASE WHEN article IS NULL THEN 'document' WHEN clause IS NULL THEN 'article' WHEN point IS NULL THEN 'clause' ELSE 'point' END AS level, CASE WHEN place = 2 THEN 0.95 WHEN target_document <> own THEN 0.92 ELSE 0.82 END::DOUBLE AS confidence FROM refs)"""
_EDGES = f"""{_REFS}, nodes AS (SELECT DISTINCT unnest(['document:' || own, 'chunk:' || chunk_id, 'article:' || own || ':dieu-' || article_number, {_node('own', 'article_number', 'clause_ref', 'NULL')}, {_node('own', 'article_number', 'clause_ref', 'point_ref')}]) AS node FROM texts),
  aimed AS (SELECT *, {_node('own', 'article_number', 'clause_ref', 'point_ref')} AS source_id, {_rank('own')} AS r, {_rank('target_document')} AS t FROM targets),
  typed AS (SELECT *, CASE WHEN r > t THEN 'DETAILS' WHEN r < t THEN 'GUIDED_BY' ELSE 'REFERENCES' END AS edge_type, target_id IN (SELECT node FROM nodes) AS resolved FROM aimed WHERE source_id <> target_id),
  both_ways AS (
    SELECT 0 AS back, chunk_id, part, place, raw_start, item, source_id, target_id, edge_type, own AS source_document, target_document, normalized, 'regex:' || pattern AS method, confidence, level, article AS target_article, clause AS target_clause, point AS target_point, resolved FROM typed
    UNION ALL SELECT 1, chunk_id, part, place, raw_start, item, target_id, source_id, 'GUIDED_BY', own, own, normalized, 'inverse:guided_by', confidence, CASE WHEN point_ref IS NOT NULL THEN 'point' WHEN clause_ref IS NOT NULL THEN 'clause' ELSE 'article' END, article_number, clause_ref, point_ref, resolved
      FROM typed WHERE edge_type = 'DETAILS' AND own <> target_document),
  edges AS (SELECT *, 'ref_edge:' || substring(sha1(source_id || '|' || edge_type || '|' || target_id || '|' || chunk_id || '|' || normalized), 1, 16) AS edge_id FROM (
    SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY source_id, target_id, edge_type, normalized) - 1 AS duplicates FROM both_ways WINDOW w AS (PARTITION BY source_id, target_id, edge_type, normalized ORDER BY chunk_id, part, place, raw_start, item, back)) WHERE n = 1)"""
ORACLES = {
    "reference_spans": f"{_SAID} SELECT chunk_id, pattern, raw_start, raw_start + length(raw) AS raw_end, raw, matched FROM said WHERE item = 0",
    "reference_numbers": f"""{_SAID} SELECT chunk_id, CASE WHEN k IN (0, 5) THEN '' ELSE a || CASE WHEN k = 9 THEN 'a' ELSE '' END END AS articles, CASE WHEN k IN (2, 3, 4, 8) THEN CAST(c AS VARCHAR) ELSE '' END AS clauses, CASE WHEN k = 3 THEN p ELSE '' END AS points FROM texts""",
    "reference_targets": f"{_REFS} SELECT chunk_id, part, pattern, item, raw_start, normalized, target_document, target_id, level, confidence FROM targets",
    "cross_references": f"""{_SAID}, crossed AS ({_crossed()}),
      aimed AS (SELECT *, CASE WHEN level = 'document' THEN document WHEN k = 2 OR own LIKE 'nghi-dinh%' THEN '45-2019-qh14' ELSE own END AS target FROM crossed),
      ends AS (SELECT *, {_node('target', 'article', 'clause', 'point')} AS target_id, {_node('own', 'article_number', 'clause_ref', 'point_ref')} AS source_id FROM aimed)
      SELECT chunk_id, target_id, CASE level WHEN 'document' THEN 'GUIDED_BY' ELSE 'REFERENCES' END AS edge_type, level, matched, raw FROM ends WHERE target_id <> source_id AND NOT (level = 'document' AND target = own)""",
    "reference_edges": f"{_EDGES} SELECT edge_id, source_id, target_id, edge_type, chunk_id, source_document, target_document, normalized, method, confidence, level, target_article, target_clause, target_point, resolved, duplicates FROM edges",
    "reference_summary": f"""{_EDGES} SELECT what, value, count(*) AS n FROM (SELECT unnest(['type', 'level', 'source_document', 'target_document', 'resolved', 'article']) AS what,
      unnest([edge_type, level, source_document, target_document, CAST(resolved AS VARCHAR), CASE WHEN target_id NOT LIKE 'document:%' THEN split_part(target_id, ':', 2) || ':' || split_part(target_id, ':', 3) END]) AS value FROM edges) WHERE value IS NOT NULL GROUP BY ALL""",
    "reference_gaps": f"""{_EDGES} SELECT source_document, CASE WHEN 'document:' || target_document NOT IN (SELECT node FROM nodes) THEN 'missing_document' WHEN 'article:' || target_document || ':dieu-' || coalesce(target_article, '') NOT IN (SELECT node FROM nodes) THEN 'missing_article'
      WHEN target_clause IS NOT NULL AND 'clause:' || target_document || ':dieu-' || target_article || ':khoan-' || target_clause NOT IN (SELECT node FROM nodes) THEN 'missing_clause' ELSE 'missing_point' END AS reason, count(*) AS n FROM edges WHERE NOT resolved GROUP BY ALL""",
    "reference_double_targets": f"{_EDGES} SELECT source_id, normalized, count(DISTINCT target_id) AS n_targets, string_agg(DISTINCT target_id, ' ' ORDER BY target_id) AS targets FROM edges GROUP BY ALL HAVING count(DISTINCT target_id) > 1",
}

"""Registered queries over appendices. The lines of all documents stand behind an article, a footer, and headings of appendices, forms
and tables that follow from a line's place; the SQL knows from the places what every line is and looks for no heading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import appendix as A
from ..sources.tables import settle, table

LIMIT = 500
#: Twelve lines go round: the sixth is a heading (of a form in every fifth text that is no table's, at every other turn), then a title
#: and in every fourth text two groups' tables. The first line is an article but in every eleventh text, the fourth a footer in two of three.
_IS_FORM, _TABULAR = "(doc_id % 5 = 0 AND doc_id % 4 <> 0 AND pos % 24 = 5)", "(doc_id % 4 = 0)"
_ROMAN = "CASE pos // 12 % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'II' ELSE 'III' END"
_MADE = f"""CASE WHEN pos = 0 AND doc_id % 11 > 0 THEN 'Điều 1. ' || line WHEN pos = 3 AND doc_id % 3 = 0 THEN 'Nơi nhận: ' || line WHEN pos = 3 AND doc_id % 3 = 1 THEN 'BỘ TRƯỞNG'
  WHEN {_IS_FORM} THEN 'Mẫu số ' || CAST(pos AS {{s}}) || '/PL' || {_ROMAN} WHEN pos % 12 = 5 THEN 'PHỤ LỤC ' || {_ROMAN} WHEN pos % 12 = 6 THEN 'Bảng ' || CAST(pos AS {{s}})
  WHEN pos % 12 = 7 AND {_TABULAR} THEN 'Lao động nam' WHEN pos % 12 = 10 AND {_TABULAR} THEN 'Lao động nữ' ELSE 'x ' || line END"""


def _spark_sql(sql: str) -> str:
    return sql.format(s="STRING").replace(" // ", " div ")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    made = F.array_sort(F.collect_list(F.struct("pos", F.expr(_spark_sql(_MADE)).alias("made"))))
    texts = rows.groupBy("doc_id").agg(F.array_join(F.transform(made, lambda x: x["made"]), "\n").alias("text"))
    return A.split_lines(texts)


def appendix_parts(spark: SparkSession, d: str) -> DataFrame:
    """Main text and appendix of each text."""
    parts = A.split_texts(_lines(spark, d))
    return parts.select("doc_id", *[x for c in ("main", "appendix") for x in (F.length(c).alias(f"n_{c}"), F.md5(F.col(c).cast("binary")).alias(f"{c}_md5"))])


def appendix_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Appendices of all texts in blocks of at most 500 characters, each behind its heading."""
    made = A.blocks(_lines(spark, d), F.concat(F.lit("D"), F.col("doc_id").cast("string")), LIMIT, tabular=F.col("doc_id") % 4 == 0)
    return made.select("doc_id", "index", "chunk_id", "appendix_id", "heading", "chunk_type", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def appendix_counts(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of each kind of each text, and its longest."""
    made = settle(A.blocks(_lines(spark, d), F.lit("D"), 2 * LIMIT), "blocks")
    return made.groupBy("doc_id", "chunk_type").agg(F.count("*").alias("n_blocks"), F.count_distinct("appendix_id").alias("n_ids"), F.max(F.length("text")).alias("longest"))


QUERIES = {f.__name__: f for f in (appendix_parts, appendix_blocks, appendix_counts)}

_LINES = f"""WITH RECURSIVE raw AS (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
  made AS MATERIALIZED (SELECT doc_id, pos, {_MADE.format(s='VARCHAR')} AS line, max(pos) OVER (PARTITION BY doc_id) AS top FROM raw),
  ends AS MATERIALIZED (SELECT *, CASE WHEN doc_id % 11 = 0 THEN top + 1 WHEN doc_id % 3 < 2 AND top >= 3 THEN 3 ELSE least(5, top + 1) END AS main_end, CASE WHEN doc_id % 11 = 0 THEN top + 1 ELSE 5 END AS opening FROM made)"""


def _blocks(limit: int, tabular: str, prefix: str) -> str:
    """Numbered lines of each block (those of titles and of what stands before tables belong to none), and a walk over them."""
    form = _IS_FORM.replace("pos", "h")
    roman = _ROMAN.replace("pos", "h")
    label = f"'Phu_Luc_' || {roman}"
    return f"""{_LINES}, tail AS (SELECT doc_id, pos, trim(line) AS line, pos - (pos + 7) % 12 AS h, (pos + 7) % 12 AS turn, {tabular} AS tabular, top FROM ends WHERE pos >= opening),
  split AS (SELECT *, {tabular} AND h + 5 <= top AS two FROM tail),
  heads AS (SELECT doc_id, h, top, tabular, two, unnest(CASE WHEN two THEN [1, 2] ELSE [0] END) AS t FROM split WHERE turn = 0),
  named AS MATERIALIZED (SELECT doc_id, h, t, {prefix} || '_' || CASE WHEN {form} THEN 'Phu_Luc_' || {roman} || '_Mau_' || h || '_PL' || {roman} ELSE {label} || CASE t WHEN 1 THEN '_Bang_Nam' WHEN 2 THEN '_Bang_Nu' ELSE '' END END AS id,
    CASE WHEN {form} THEN 'Mẫu số ' || h || '/PL' || {roman} ELSE 'PHỤ LỤC ' || {roman} || CASE WHEN tabular AND h < top THEN '. Bảng ' || (h + 1) ELSE '' END || CASE t WHEN 1 THEN '. Lao động nam' WHEN 2 THEN '. Lao động nữ' ELSE '' END END AS heading,
    CASE WHEN t > 0 THEN 'appendix_table' WHEN tabular THEN 'appendix_list' WHEN {form} THEN 'appendix_form' ELSE 'appendix' END AS kind, CASE WHEN {form} THEN '_Phan_' ELSE '_Nhom_' END AS suffix FROM heads),
  body AS MATERIALIZED (SELECT doc_id, h, t, line, row_number() OVER (PARTITION BY doc_id, h, t ORDER BY pos) AS i FROM (
    SELECT doc_id, h, pos, line, CASE WHEN NOT two THEN CASE WHEN turn >= CASE WHEN tabular THEN 2 ELSE 1 END THEN 0 END WHEN turn IN (3, 4) THEN 1 WHEN turn > 5 THEN 2 END AS t FROM split) WHERE t IS NOT NULL AND line <> ''),
  walk AS (SELECT doc_id, h, t, heading, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS g, CAST(0 AS BIGINT) AS used FROM named
    UNION ALL SELECT w.doc_id, w.h, w.t, w.heading, b.i, CASE WHEN w.i = 0 OR used + 1 + length(line) > {limit} THEN g + 1 ELSE g END, CASE WHEN w.i = 0 OR used + 1 + length(line) > {limit} THEN length(w.heading) ELSE used END + 1 + length(line)
    FROM walk w JOIN body b ON b.doc_id = w.doc_id AND b.h = w.h AND b.t = w.t AND b.i = w.i + 1),
  lots AS (SELECT w.doc_id, w.h, w.t, g, string_agg(b.line, chr(10) ORDER BY w.i) AS body FROM walk w JOIN body b USING (doc_id, h, t, i) GROUP BY ALL),
  texts AS (SELECT n.*, g, count(*) OVER (PARTITION BY n.doc_id, n.h, n.t) AS n_lots, heading || coalesce(chr(10) || body, '') AS text FROM named n LEFT JOIN lots l ON l.doc_id = n.doc_id AND l.h = n.h AND l.t = n.t),
  kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY h, t, g) AS nth, id || CASE WHEN n_lots > 1 THEN suffix || lpad(CAST(g AS VARCHAR), CAST(greatest(2, length(CAST(g AS VARCHAR))) AS INTEGER), '0') ELSE '' END AS chunk_id FROM texts WHERE length(text) >= 20)"""


_JOINED = "trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE {}), ''), chr(32) || chr(9) || chr(10))"
ORACLES = {
    "appendix_parts": f"{_LINES}, p AS (SELECT doc_id, {_JOINED.format('pos < main_end')} AS main, {_JOINED.format('pos >= opening')} AS appendix FROM ends GROUP BY doc_id) SELECT doc_id, length(main) AS n_main, md5(main) AS main_md5, length(appendix) AS n_appendix, md5(appendix) AS appendix_md5 FROM p",
    "appendix_blocks": f"{_blocks(LIMIT, _TABULAR, chr(39) + 'D' + chr(39) + ' || doc_id')} SELECT doc_id, CAST(nth AS INTEGER) AS index, chunk_id, id AS appendix_id, heading, kind AS chunk_type, length(text) AS n_chars, md5(text) AS text_md5 FROM kept",
    "appendix_counts": f"{_blocks(2 * LIMIT, 'false', chr(39) + 'D' + chr(39))} SELECT doc_id, kind AS chunk_type, count(*) AS n_blocks, count(DISTINCT id) AS n_ids, max(length(text)) AS longest FROM kept GROUP BY doc_id, kind",
}

"""Registered queries over articles, clauses and points, and over the chunks that they are cut into.

The texts are the lines of all documents, behind headings, article numbers and markers that follow from a line's place. The SQL never
looks for a marker: it knows from the places what every line is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import units as U
from ..sources.tables import table

#: What stands before the twelve lines of an article, the clause and the point (and the place where they start) that each is in.
BEFORE = ["Điều {n}. x", "~ ", "1. x", "a) x", "b) x", "đ) x", "2. x", "- a.1) x", "~ ", '"3. x', "~ ", "C) x"]
CLAUSES = {2: ("1", 2), 3: ("1", 2), 4: ("1", 2), 5: ("1", 2), 6: ("2", 6), 7: ("2", 6), 8: ("2", 6), 9: ("3", 9), 10: ("3", 9), 11: ("3", 9)}
POINTS = {3: ("a", 3), 4: ("b", 4), 5: ("đ", 5), 7: ("a.1", 7), 8: ("a.1", 7), 11: ("C", 11)}
#: Headings come before the line at `at` of every `of` lines; the second of a chapter's lines is its title.
HEADS = ((72, 0, "PHẦN {m}"), (36, 0, "CHƯƠNG {m}."), (36, 0, "quy định chung"), (36, 12, "Mục {m}. Riêng"))
LIMIT, PIECE = 600, 800

_N = "CAST(CASE WHEN doc_id % 3 = 0 THEN pos // 24 ELSE pos // 12 END + 1 AS {s})"


def _made(kind: str, line: str, before: list[str] = BEFORE) -> str:
    """SQL for the lines that one line of a document becomes, as an array with nulls."""
    n = _N.format(s=kind)
    cases = " ".join(f"WHEN {r} THEN " + ("'" + b.replace("{n}", "' || " + n + " || '") + "'") + f" || {line}" for r, b in enumerate(before))
    heads = [f"CASE WHEN pos % {of} = {at} THEN '" + h.replace("{m}", f"' || CAST(pos // {of} + 1 AS {kind}) || '") + "' END" for of, at, h in HEADS]
    return ", ".join([*heads, f"CASE pos % 12 {cases} END"])


def _spark_sql(sql: str) -> str:
    return sql.replace(" // ", " div ")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _joined(lines: DataFrame) -> DataFrame:
    """doc_id, text of doc_id, pos, made (the lines that stand for each)."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "made")))
    return lines.groupBy("doc_id").agg(F.array_join(F.flatten(F.transform(parts, lambda x: F.array_compact(x["made"]))), "\n").alias("text"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return _joined(_lines(spark, d).select("doc_id", "pos", F.expr(f"array({_spark_sql(_made('STRING', 'line'))})").alias("made")))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return U.with_places(U.read_lines(_texts(spark, d)))


def unit_headings(spark: SparkSession, d: str) -> DataFrame:
    return U.headings(_placed(spark, d))


def legal_units(spark: SparkSession, d: str) -> DataFrame:
    """Articles, clauses and points with their lines, numbers, context and parents."""
    return U.parse_units(_placed(spark, d)).withColumn("text_md5", F.md5(F.col("text").cast("binary"))).drop("text")


def unit_summary(spark: SparkSession, d: str) -> DataFrame:
    return U.summarize_units(U.parse_units(_placed(spark, d)))


def text_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Each text with its markers in pieces of at most 800 characters, by the ladder of boundaries."""
    pieces = _texts(spark, d).select("doc_id", F.posexplode(U.split_text(F.col("text"), F.lit(PIECE))).alias("place", "piece"))
    return pieces.select("doc_id", "place", F.length("piece").alias("n_chars"), F.md5(F.col("piece").cast("binary")).alias("piece_md5"))


#: A line's hash, up to four times, stands for the line where only the packing is looked at.
_HASHED = "repeat(md5(line), CAST(length(line) % 4 AS INT) + 1)"
_PLAIN = [b.removeprefix("- ").removeprefix('"') for b in BEFORE]


def article_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of every article: intro, clauses, and points packed behind what introduces them."""
    texts = _joined(_lines(spark, d).select("doc_id", "pos", F.expr(f"array({_spark_sql(_made('STRING', _HASHED, _PLAIN))})").alias("made")))
    articles = U.parse_units(U.with_places(U.read_lines(texts))).where("level = 'article'")
    cut = F.instr("text", "\n")
    heading = F.when(cut > 0, F.substring("text", F.lit(1), cut - 1)).otherwise(F.col("text"))
    body = F.when(cut > 0, F.substring("text", cut + 1, F.length("text"))).otherwise("")
    chunks = U.chunk_articles(articles.select("doc_id", "start", "article", F.concat(F.substring(heading, 1, 12)).alias("heading"), body.alias("body")), key=["doc_id", "start"], limit=LIMIT)
    return chunks.select("doc_id", "start", "index", "clause_ref", F.array_join("point_refs", ",").alias("points"), "chunk_type", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


QUERIES = {f.__name__: f for f in (unit_headings, legal_units, unit_summary, text_pieces, article_chunks)}

_BLANK = "chr(32) || chr(9) || chr(10) || chr(13)"


def _of(places: dict[int, tuple[str, int]], what: int) -> str:
    return "CASE r " + " ".join(f"WHEN {r} THEN '{v[what]}'" if what == 0 else f"WHEN {r} THEN r - {v[what]}" for r, v in places.items()) + " END"


def _laid(line: str = "line", before: list[str] = BEFORE) -> str:
    return f"""WITH lines AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
  many AS (SELECT doc_id, pos, line, unnest(range(5)) AS sub, unnest([{_made('VARCHAR', line, before)}]) AS made FROM lines),
  laid AS (SELECT *, pos % 12 AS r, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) - 1 AS INTEGER) AS p FROM many WHERE made IS NOT NULL),
  main AS (SELECT * FROM laid WHERE sub = 4)"""


_UNITS = f"""{_laid()},
  own AS (SELECT *, {_of(CLAUSES, 0)} AS clause, {_of(CLAUSES, 1)} AS clause_back, {_of(POINTS, 0)} AS point, {_of(POINTS, 1)} AS point_back FROM main),
  each AS (SELECT *, unnest(['article', 'clause', 'point']) AS level, unnest([r, clause_back, point_back]) AS back FROM own),
  heads AS (SELECT doc_id, pos, sub, p FROM laid WHERE sub IN (0, 1, 3)),
  grouped AS (SELECT doc_id, level, min(p) AS start, max(p) + 1 AS "end", pos - back AS at, min(pos) AS first, any_value(clause) AS c, any_value(point) AS k, trim(string_agg(made, chr(10) ORDER BY p), {_BLANK}) AS text FROM each WHERE back IS NOT NULL GROUP BY doc_id, level, pos - back),
  titled AS (SELECT g.*, g.first - g.first % 12 AS a FROM grouped g),
  units AS (SELECT t.doc_id, level, start, "end", trim(regexp_replace('x' || l.line, '\\s+', ' ', 'g')) AS title, CAST(CASE WHEN t.doc_id % 3 = 0 THEN a // 24 ELSE a // 12 END + 1 AS VARCHAR) AS article,
    CASE WHEN level <> 'article' THEN c END AS clause, CASE WHEN level = 'point' THEN k END AS point, CAST(a // 72 + 1 AS VARCHAR) AS part, CAST(a // 36 + 1 AS VARCHAR) AS chapter, CASE WHEN a % 36 >= 12 THEN CAST(a // 36 + 1 AS VARCHAR) END AS section,
    CASE level WHEN 'article' THEN (SELECT max(h.p) FROM heads h WHERE h.doc_id = t.doc_id AND h.pos <= a) WHEN 'clause' THEN l.p
      ELSE l.p + (CASE (t.first % 12) WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 2 WHEN 7 THEN 6 WHEN 11 THEN 9 END) END AS parent_start, text
    FROM titled t JOIN main l ON l.doc_id = t.doc_id AND l.pos = a)"""


def _pack(units: str, limit: str) -> str:
    return f"string_split(list_reduce({units}, lambda acc, u: acc || CASE WHEN length(list_last(string_split(acc, chr(6)))) + 1 + length(u) <= {limit} THEN chr(10) ELSE chr(6) END || u), chr(6))"


def _split(x: str, marks: tuple[int, ...], limit: int, depth: int = 0) -> str:
    """SQL for the pieces of x, whose boundaries are the signs chr(1) to chr(3) and, in the end, blanks after a full stop or semicolon."""
    bare = f"trim(translate({x}, chr(1) || chr(2) || chr(3), ''), {_BLANK})"
    if marks:
        sign = marks[0]
        parts = f"string_split({x}, chr({sign}))" if sign < 4 else f"string_split(regexp_replace({bare}, '([.;])\\s+', '\\1' || chr(4), 'g'), chr(4))"
        parts = f"list_filter({parts}, lambda y{depth}: trim(translate(y{depth}, chr(1) || chr(2) || chr(3), ''), {_BLANK}) <> '')"
        below = f"flatten(list_transform({parts}, lambda z{depth}: {_split(f'z{depth}', marks[1:], limit, depth + 1)}))"
        longer = f"CASE WHEN len({parts}) > 1 THEN {_pack(below, str(limit))} ELSE {below} END"
    else:
        words = f"regexp_extract_all({bare}, '\\S+\\s*')"
        grown = f"list_reduce({words}, lambda acc, u: acc || CASE WHEN length(list_last(string_split(acc, chr(5)))) + length(rtrim(u, {_BLANK})) <= {limit} THEN '' ELSE chr(5) END || u)"
        longer = f"list_transform(string_split({grown}, chr(5)), lambda w{depth}: rtrim(w{depth}, {_BLANK}))"
    return f"CASE WHEN {bare} = '' THEN [] WHEN length({bare}) <= {limit} THEN [{bare}] ELSE {longer} END"


_SIGN = "CASE WHEN sub < 4 THEN '' WHEN r IN (2, 6) THEN chr(1) WHEN r IN (3, 4, 5) THEN chr(3) ELSE '' END"
ORACLES = {
    "unit_headings": f"""{_laid()}, h AS (SELECT doc_id, pos, sub, p, made FROM laid WHERE sub < 4)
      SELECT doc_id, p AS start, CASE sub WHEN 0 THEN 'part' WHEN 1 THEN 'chapter' ELSE 'section' END AS level, CAST(pos // CASE sub WHEN 0 THEN 72 ELSE 36 END + 1 AS VARCHAR) AS number, made || CASE sub WHEN 1 THEN ' quy định chung' ELSE '' END AS heading FROM h WHERE sub <> 2""",
    "legal_units": f"{_UNITS} SELECT doc_id, level, start, \"end\", title, article, clause, point, part, chapter, section, parent_start, md5(text) AS text_md5 FROM units",
    "unit_summary": f"""{_UNITS} SELECT doc_id, count(*) FILTER (WHERE level = 'article') AS n_article, count(*) FILTER (WHERE level = 'clause') AS n_clause, count(*) FILTER (WHERE level = 'point') AS n_point, count(*) FILTER (WHERE length(text) < {U.SHORT}) AS n_short,
      count(*) FILTER (WHERE level = 'article' AND title = '') AS n_untitled, count(*) FILTER (WHERE level = 'article') - count(DISTINCT article) FILTER (WHERE level = 'article') AS n_repeated FROM units GROUP BY doc_id""",
    "text_pieces": f"""{_laid()}, t AS (SELECT doc_id, string_agg({_SIGN} || made, chr(10) ORDER BY p) AS x FROM laid GROUP BY doc_id), s AS (SELECT doc_id, {_split('x', (1, 2, 3, 4), PIECE)} AS pieces FROM t)
      SELECT doc_id, CAST(place AS INTEGER) AS place, length(piece) AS n_chars, md5(piece) AS piece_md5 FROM (SELECT doc_id, unnest(range(len(pieces))) AS place, unnest(pieces) AS piece FROM s)""",
    "article_chunks": f"""{_laid(_HASHED, _PLAIN).replace('WITH lines', 'WITH RECURSIVE lines')},
      own AS (SELECT doc_id, pos - r AS a, r, made, substring(first_value(made) OVER w, 1, 12) AS heading, first_value(p) OVER w AS start, {_of(CLAUSES, 0)} AS clause, {_of(POINTS, 0)} AS point FROM main WINDOW w AS (PARTITION BY doc_id, pos - r ORDER BY pos)),
      intro AS (SELECT doc_id, a, made AS intro FROM own WHERE r = 1),
      heads AS (SELECT DISTINCT doc_id, a, heading, start, heading || coalesce(chr(10) || chr(10) || intro, '') AS top FROM own LEFT JOIN intro USING (doc_id, a)),
      pre AS (SELECT doc_id, a, clause, top || chr(10) || chr(10) || string_agg(made, chr(10) || chr(10) ORDER BY r) AS prefix FROM own JOIN heads USING (doc_id, a) WHERE clause IS NOT NULL AND point IS NULL AND r <> 10 GROUP BY doc_id, a, clause, top),
      plus AS (SELECT doc_id, a, clause, prefix || coalesce(chr(10) || made, '') AS prefix FROM pre LEFT JOIN (SELECT doc_id, a, '3' AS clause, made FROM own WHERE r = 10) USING (doc_id, a, clause)),
      pts AS (SELECT doc_id, a, clause, point, row_number() OVER (PARTITION BY doc_id, a, clause ORDER BY min(r)) AS i, chr(10) || chr(10) || string_agg(made, chr(10) ORDER BY r) AS body FROM own WHERE point IS NOT NULL GROUP BY doc_id, a, clause, point),
      total AS (SELECT p.doc_id AS doc_id, p.a AS a, p.clause AS clause, prefix, coalesce(sum(length(body)), 0) + length(prefix) <= {LIMIT} AS fits, count(body) AS n FROM plus p LEFT JOIN pts USING (doc_id, a, clause) GROUP BY p.doc_id, p.a, p.clause, prefix),
      packed AS (
        SELECT doc_id, a, clause, i, 1 AS g, length(prefix) + length(body) AS w FROM pts JOIN total USING (doc_id, a, clause) WHERE i = 1
        UNION ALL SELECT q.doc_id, q.a, q.clause, q.i, CASE WHEN NOT fits AND w + length(body) > {LIMIT} THEN g + 1 ELSE g END, CASE WHEN NOT fits AND w + length(body) > {LIMIT} THEN length(prefix) ELSE w END + length(body)
          FROM packed k JOIN pts q ON q.doc_id = k.doc_id AND q.a = k.a AND q.clause = k.clause AND q.i = k.i + 1 JOIN total t ON t.doc_id = q.doc_id AND t.a = q.a AND t.clause = q.clause),
      chunks AS (
        SELECT doc_id, a, 0 AS c, 0 AS g, NULL AS clause_ref, '' AS points, CASE WHEN EXISTS (SELECT 1 FROM own o WHERE o.doc_id = h.doc_id AND o.a = h.a AND o.r = 2) THEN 'article_intro' ELSE 'article_full' END AS chunk_type, top AS text
          FROM heads h WHERE top <> heading OR NOT EXISTS (SELECT 1 FROM own o WHERE o.doc_id = h.doc_id AND o.a = h.a AND o.r = 2)
        UNION ALL SELECT doc_id, a, CAST(clause AS INT), 0, clause, '', 'clause', prefix FROM total WHERE n = 0
        UNION ALL SELECT doc_id, a, CAST(clause AS INT), g, clause, string_agg(point, ',' ORDER BY i), CASE WHEN fits THEN 'clause' ELSE 'clause_part' END, prefix || string_agg(body, '' ORDER BY i) FROM packed JOIN pts USING (doc_id, a, clause, i) JOIN total USING (doc_id, a, clause) GROUP BY doc_id, a, clause, g, fits, prefix)
      SELECT doc_id, start, CAST(row_number() OVER (PARTITION BY doc_id, start ORDER BY c, g) AS INTEGER) AS index, clause_ref, points, chunk_type, length(text) AS n_chars, md5(text) AS text_md5 FROM chunks JOIN heads USING (doc_id, a)""",
}

"""Registered queries over structure, labels, references, routes and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold
from ..operators import labels as L
from ..operators import references as X
from ..operators import structure as S
from ..sources.tables import table
from .text_queries import _fold

#: Label rules over folded text.
TOPICS: L.Rules = [("license", ["license", "licensed"]), ("contact", ["mail", "phone", "@"]), ("secret", ["token", "password", "key ="]), ("english", [" the ", " and "]), ("german", [" der ", " und "]), ("spanish", [" el ", " los "]), ("french", [" les ", " des "])]
SIGNALS = ["the", "how", "what", "was", "ist", "que", "les", "und"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a heading flag: a document's lines of under 30 characters open a section."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.withColumn("heading", F.length("line") < 30)


def section_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    filled = _lines(spark, d).withColumn("section", F.max(F.when(F.col("heading"), F.col("pos"))).over(w))
    return filled.groupBy("doc_id", F.coalesce("section", F.lit(-1)).alias("section")).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def article_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans from heading to heading."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("pos")
    lines = _lines(spark, d).withColumn("last", F.max("pos").over(Window.partitionBy("doc_id")))
    return lines.where("heading").withColumn("next", F.lead("pos").over(w)).select("doc_id", F.row_number().over(w).alias("n"), F.col("pos").alias("start"), F.coalesce("next", F.col("last") + 1).alias("end"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", "source", F.posexplode(S.pack_units(lines, 1200, "\n")).alias("n", "chunk"))


def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("doc_id", "n", F.length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


def chunk_ids_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.col("lang"), F.lit("_"), F.substring(F.md5(F.col("text").cast("binary")), 1, 8)).alias("chunk_id"))
    return S.dedupe_ids(docs, "chunk_id", "doc_id")


def parent_assign(spark: SparkSession, d: str) -> DataFrame:
    """Each document's lines in three levels by length; a line's parent is the last line of the level above."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    level = F.when(F.length("line") < 20, 0).when(F.length("line") < 60, 1).otherwise(2)
    chunks = lines.select("doc_id", "pos", level.alias("level"), F.concat_ws("#", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("chunk_id"))
    return S.parents(chunks, "doc_id", "level", "pos").select("chunk_id", "level", "parent")


def chunk_summary(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    n = F.length("line")
    return p.groupBy("source").agg(F.count("*").alias("n"), F.sum((n < 20).cast("int")).alias("short"), F.sum((n > 3000).cast("int")).alias("long"), F.max(n).alias("longest"))


def taxonomy_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(L.labels(fold(F.col("text")), TOPICS), ",").alias("labels"))


def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("source", F.explode(L.labels(fold(F.col("text")), TOPICS)).alias("label"))
    return t.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"))


def missing_lists(spark: SparkSession, d: str) -> DataFrame:
    """Documents without any label, and labelled tables' missing ids."""
    docs = table(spark, d, "documents")
    bare = docs.where(F.size(L.labels(fold(F.col("text")), TOPICS)) == 0).select(F.lit("no_topic").alias("what"), "doc_id")
    return bare.union(docs.join(table(spark, d, "labels"), "doc_id", "left_anti").select(F.lit("no_judgement"), "doc_id"))


def extract_refs(spark: SparkSession, d: str) -> DataFrame:
    return X.link_references(table(spark, d, "pages"), "page_id", "html")


def _refs(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    known = pages.groupBy(F.col("url").alias("target")).agg(F.min("page_id").alias("node"))
    return X.resolve(X.link_references(pages, "page_id", "html"), known, "page_id")


def resolve_edges(spark: SparkSession, d: str) -> DataFrame:
    return _refs(spark, d).select("page_id", "place", "target", "resolved", X.edge_id(F.col("page_id").cast("string"), F.col("target")).alias("edge_id"))


def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    return X.dedupe(_refs(spark, d), ["page_id", "target"], "place")


def inverse_edges(spark: SparkSession, d: str) -> DataFrame:
    named = X.dedupe(_refs(spark, d), ["page_id", "target"], "place").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("s"), "target")
    return X.with_inverse(named, "s", "target", "GUIDES", "GUIDED_BY")


def unresolved_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why a reference resolves to no page, in this order: a fragment, a relative path, an unknown host, an unknown page."""
    hosts = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).distinct().withColumn("known", F.lit(True))
    open_ = _refs(spark, d).where("not resolved").withColumn("host", F.regexp_extract("target", "^https?://([^/]+)", 1))
    reason = F.when(F.col("target").startswith("#"), "fragment").when(F.col("host") == "", "relative").when(F.col("known").isNull(), "unknown_host").otherwise("unknown_page")
    return open_.join(hosts, "host", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def keyword_route(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(L.labels(fold(F.col("text")), TOPICS), ",").alias("route"), F.length("text").alias("n_chars"))


def domain_guard(spark: SparkSession, d: str) -> DataFrame:
    t = fold(F.col("text"))
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.length("text").alias("n_chars"), L.signals(t, SIGNALS).alias("n_signals"), L.guard(t, SIGNALS, r"(?:dieu|article|section)\s+\d+", 2).alias("verdict"))


def scope_guard(spark: SparkSession, d: str) -> DataFrame:
    """Items in scope: at least one document shares half of the item's distinct tokens."""
    from ..functions.text import tokens

    asks = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("t"))
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("t"))
    need = asks.groupBy("item_id").agg(F.count("*").alias("n"))
    support = docs.join(asks, "t").groupBy("item_id", "doc_id").agg(F.count("*").alias("k")).join(need, "item_id")
    return support.groupBy("item_id").agg(F.sum((F.col("k") * 2 >= F.col("n")).cast("int")).alias("supporting"), F.max("k").alias("best"), F.max("n").alias("n_terms"))


def quality_checks(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns: tri-state checks (null: not applicable)."""
    t = F.col("text")
    return table(spark, d, "conversations").where("role = 'assistant'").select(
        "conv_id", "turn", F.md5(t.cast("binary")).alias("text_md5"),
        (F.length(t) >= 20).alias("long_enough"),
        F.when(t.contains('"'), F.size(F.regexp_extract_all(t, F.lit('"([^"]{8,})"'), F.lit(1))) > 0).alias("quotes_substantial"),
        F.when(t.rlike("[0-9]"), t.rlike("[0-9]+%")).alias("percent_given"),
    )


def quote_support(spark: SparkSession, d: str) -> DataFrame:
    """Of each item's sentences, how many of 8 and more characters some document holds whole."""
    from ..operators.containment import contained

    parts = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", r"(?<=[.])\s+")).alias("pos", "quote")).where("length(quote) >= 8").select((F.shiftleft(F.col("item_id").cast("long"), 32) + F.col("pos")).alias("quote_id"), "quote")
    found = contained(table(spark, d, "documents"), parts, "doc_id", "quote_id", passage="quote")
    held = found.groupBy("quote_id").agg(F.count("*").alias("n_docs"))
    return parts.join(held, "quote_id", "left").groupBy(F.shiftright("quote_id", 32).alias("item_id")).agg(F.count("*").alias("n_quotes"), F.count("n_docs").alias("n_supported"))


QUERIES = {f.__name__: f for f in (section_forward_fill, article_spans, chunk_pack, chunk_ids_dedup, parent_assign, chunk_summary, taxonomy_labels, label_distribution, missing_lists, extract_refs, resolve_edges, edge_dedup, inverse_edges, unresolved_reasons, keyword_route, domain_guard, scope_guard, quality_checks, quote_support)}

_LINES = "lines AS (SELECT doc_id, source, unnest(p) AS line, unnest(range(len(p))) AS pos FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents))"


def _labels(t: str) -> str:
    cases = ", ".join("CASE WHEN " + " OR ".join(f"contains({t}, '{p}')" for p in phrases) + f" THEN '{label}' END" for label, phrases in TOPICS)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


_SIG = " + ".join(f"CASE WHEN contains(f, '{p}') THEN 1 ELSE 0 END" for p in SIGNALS)
_REFS = r"""raw AS (SELECT page_id, unnest(p) AS target, unnest(range(len(p))) AS place FROM (SELECT page_id, regexp_extract_all(html, 'href=["'']([^"'']*)["'']', 1) AS p FROM pages)), known AS (SELECT url AS target, min(page_id) AS node FROM pages GROUP BY 1), refs AS (SELECT page_id, place, target, node IS NOT NULL AS resolved FROM raw LEFT JOIN known USING (target) WHERE node IS NULL OR node <> page_id)"""
_TOK = "regexp_extract_all(" + _fold("text") + ", '[a-z0-9_.]+')"
ORACLES = {
    "chunk_pack": """WITH packed AS (SELECT doc_id, string_split(list_reduce(lines, lambda acc, x: acc || CASE WHEN length(list_last(string_split(acc, chr(1)))) + 1 + length(x) <= 1200 THEN chr(10) ELSE chr(1) END || x), chr(1)) AS chunks
      FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM documents) WHERE len(lines) > 0)
      SELECT doc_id, n, length(chunk) AS n_chars, md5(chunk) AS chunk_md5 FROM (SELECT doc_id, unnest(range(len(chunks))) AS n, unnest(chunks) AS chunk FROM packed)""",
    "quote_support": r"""WITH q AS (SELECT item_id, pos, quote FROM (SELECT item_id, unnest(range(len(parts))) AS pos, unnest(parts) AS quote
        FROM (SELECT item_id, string_split(regexp_replace(text, '\.\s+', '.' || chr(1), 'g'), chr(1)) AS parts FROM benchmark)) WHERE length(quote) >= 8),
      held AS (SELECT DISTINCT item_id, pos FROM q JOIN documents d ON contains(d.text, q.quote))
      SELECT item_id, count(*) AS n_quotes, count(h.pos) AS n_supported FROM q LEFT JOIN held h USING (item_id, pos) GROUP BY item_id""",
    "section_forward_fill": f"WITH {_LINES} SELECT doc_id, section, count(*) AS n_lines, sum(length(line)) AS n_chars FROM (SELECT doc_id, line, coalesce(max(CASE WHEN length(line) < 30 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos), -1) AS section FROM lines) GROUP BY ALL",
    "article_spans": f"WITH {_LINES}, h AS (SELECT *, max(pos) OVER (PARTITION BY doc_id) AS last FROM lines) SELECT doc_id, row_number() OVER w AS n, pos AS start, coalesce(lead(pos) OVER w, last + 1) AS \"end\" FROM h WHERE length(line) < 30 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)",
    "chunk_ids_dedup": "SELECT doc_id, id || CASE WHEN n > 1 THEN '_Chunk_' || printf('%02d', n) ELSE '' END AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id) AS n FROM (SELECT doc_id, lang || '_' || substring(md5(text), 1, 8) AS id FROM documents))",
    "parent_assign": f"WITH {_LINES}, c AS (SELECT doc_id, pos, doc_id || '#' || pos AS chunk_id, CASE WHEN length(line) < 20 THEN 0 WHEN length(line) < 60 THEN 1 ELSE 2 END AS level FROM lines), p AS (SELECT *, max(CASE WHEN level = 0 THEN pos END) OVER w AS p0, max(CASE WHEN level = 1 THEN pos END) OVER w AS p1 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT chunk_id, level, CASE level WHEN 1 THEN doc_id || '#' || p0 WHEN 2 THEN doc_id || '#' || p1 END AS parent FROM p",
    "chunk_summary": f"WITH {_LINES} SELECT source, count(*) AS n, sum(CASE WHEN length(line) < 20 THEN 1 ELSE 0 END) AS short, sum(CASE WHEN length(line) > 3000 THEN 1 ELSE 0 END) AS long, max(length(line)) AS longest FROM lines GROUP BY 1",
    "taxonomy_labels": f"SELECT doc_id, array_to_string({_labels('f')}, ',') AS labels FROM (SELECT doc_id, {_fold('text')} AS f FROM documents)",
    "label_distribution": f"SELECT label, count(*) AS n, count(DISTINCT source) AS n_sources FROM (SELECT source, unnest({_labels('f')}) AS label FROM (SELECT source, {_fold('text')} AS f FROM documents)) GROUP BY 1",
    "missing_lists": f"SELECT 'no_topic' AS what, doc_id FROM (SELECT doc_id, {_fold('text')} AS f FROM documents) WHERE len({_labels('f')}) = 0 UNION ALL SELECT 'no_judgement', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "extract_refs": f"WITH {_REFS} SELECT page_id, place, target FROM raw",
    "resolve_edges": f"WITH {_REFS} SELECT page_id, place, target, resolved, 'ref_edge:' || substring(sha1(page_id || '|' || target), 1, 16) AS edge_id FROM refs",
    "edge_dedup": f"WITH {_REFS} SELECT page_id, target, min(place) AS place, count(*) - 1 AS duplicates FROM refs GROUP BY ALL",
    "inverse_edges": f"WITH {_REFS}, e AS (SELECT DISTINCT 'page:' || page_id AS s, target FROM refs) SELECT s AS src, target AS dst, 'GUIDES' AS kind FROM e UNION ALL SELECT target, s, 'GUIDED_BY' FROM e",
    "unresolved_reasons": f"WITH {_REFS}, hosts AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages) SELECT CASE WHEN starts_with(target, '#') THEN 'fragment' WHEN h = '' THEN 'relative' WHEN host IS NULL THEN 'unknown_host' ELSE 'unknown_page' END AS reason, count(*) AS n FROM (SELECT *, regexp_extract(target, '^https?://([^/]+)', 1) AS h FROM refs WHERE NOT resolved) LEFT JOIN hosts ON host = h GROUP BY 1",
    "keyword_route": f"SELECT conv_id, turn, array_to_string({_labels('f')}, ',') AS route, n_chars FROM (SELECT conv_id, turn, length(text) AS n_chars, {_fold('text')} AS f FROM conversations WHERE role = 'user')",
    "domain_guard": rf"SELECT conv_id, turn, n_chars, {_SIG} AS n_signals, CASE WHEN regexp_matches(f, '(?:dieu|article|section)\s+\d+') THEN 'reference' WHEN {_SIG} >= 2 THEN 'signals' ELSE 'refused' END AS verdict FROM (SELECT conv_id, turn, length(text) AS n_chars, {_fold('text')} AS f FROM conversations WHERE role = 'user')",
    "scope_guard": f"WITH a AS (SELECT item_id, unnest(list_distinct({_TOK})) AS t FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct({_TOK})) AS t FROM documents), n AS (SELECT item_id, count(*) AS n FROM a GROUP BY 1), s AS (SELECT item_id, doc_id, count(*) AS k FROM a JOIN d USING (t) GROUP BY ALL) SELECT item_id, sum(CASE WHEN k * 2 >= n THEN 1 ELSE 0 END) AS supporting, max(k) AS best, max(n) AS n_terms FROM s JOIN n USING (item_id) GROUP BY 1",
    "quality_checks": "SELECT conv_id, turn, md5(text) AS text_md5, length(text) >= 20 AS long_enough, CASE WHEN contains(text, '\"') THEN len(regexp_extract_all(text, '\"([^\"]{8,})\"', 1)) > 0 END AS quotes_substantial, CASE WHEN regexp_matches(text, '[0-9]') THEN regexp_matches(text, '[0-9]+%') END AS percent_given FROM conversations WHERE role = 'assistant'",
}

"""Registered queries over text, sparse and dense indexes, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean, fold, paragraphs, preview, slug, token_count, tokens
from ..operators import dense, sparse
from ..sources.tables import table

#: Frequent words, in folded form.
STOP = ["the", "and", "of", "to", "in", "is", "la", "le", "de", "el", "en", "y", "der", "die", "und", "das", "les", "des", "que", "un"]
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
FOLD_SQL = r"trim(regexp_replace(lower(strip_accents(replace(replace({0}, 'đ', 'd'), 'Đ', 'D'))), '\s+', ' ', 'g'))"
TOKENS_SQL = "regexp_extract_all(" + FOLD_SQL + ", '[a-z0-9_.]+')"


def _fold(c: str) -> str:
    return FOLD_SQL.format(c)


def _tokens(c: str) -> str:
    return TOKENS_SQL.format(c)


def norm_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(fold(F.col("text")).cast("binary")).alias("norm_md5"))


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.substring(slug(F.col("text")), 1, 60).alias("slug"))


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(clean(F.col("text")).cast("binary")).alias("clean_md5"))


def text_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", preview(F.col("text"), 80).alias("preview"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("n_words"), F.size(tokens(F.col("text"))).alias("n_tokens"))


def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter(tokens(F.col("text")), lambda t: ~t.isin(STOP))
    return table(spark, d, "documents").select("doc_id", F.size(kept).alias("n_kept"), F.md5(F.array_join(kept, " ").cast("binary")).alias("kept_md5"))


def line_explode(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum((F.trim("line") == "").cast("int")).alias("n_blank"), F.max(F.length("line")).alias("longest"))


def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that a document repeats at least three times and that look like a header or footer: 4 to 120 characters."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("key", fold(F.col("line")))
    grouped = lines.where("length(key) between 4 and 120").groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("pos")).alias("at"))
    return grouped.where("n >= 3").select("doc_id", "key", "n", F.array_join(F.transform(F.slice("at", 1, 10), lambda p: (p + 1).cast("string")), ",").alias("lines"))


def ocr_flags(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        F.contains(t, F.lit("�")).alias("has_replacement"),
        t.rlike("Ã[\\u0080-\\u00bf]").alias("has_mojibake"),
        t.rlike("[a-z][0-9]|[0-9][a-z]").alias("has_letter_digit"),
        t.rlike("[#$%&*]{3}").alias("has_symbol_run"),
        t.rlike("[a-z][A-Z]").alias("has_joined_words"),
    )


def paragraph_lengths(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("pos", "p"))
    return p.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.sum(F.length("p")).alias("n_chars"), F.max(F.length("p")).alias("longest"))


def bm25_fit(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    posted = sparse.postings(docs, "doc_id", "text")
    return sparse.fit(posted, docs.agg(F.count("*").alias("n"))).select("token", "df", F.round("idf", 6).alias("idf"))


def bm25_doc_weights(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    posted = sparse.postings(docs, "doc_id", "text")
    n = docs.agg(F.count("*").alias("n"))
    avgdl = sparse.lengths(posted, "doc_id").agg(F.avg("dl")).first()[0] or 0.0
    w = sparse.weights(posted, sparse.fit(posted, n), "doc_id", avgdl)
    return w.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 4).alias("weight_sum"), F.round(F.max("weight"), 4).alias("weight_max"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    found = sparse.top_k(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", 10)
    return found.select("item_id", "rank", "doc_id", F.round("score", 3).alias("score"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    found = dense.top_k(table(spark, d, "embeddings"), _asked(spark, d), 10)
    return found.select("query_id", "rank", "vec_id", F.round("score", 4).alias("score"))


def dense_exact_filter(spark: SparkSession, d: str) -> DataFrame:
    """Top 5 among the vectors of label 0 and 1 only: the filter comes before the search."""
    found = dense.top_k(table(spark, d, "embeddings").where("label in (0, 1)"), _asked(spark, d), 5)
    return found.select("query_id", "rank", "vec_id", F.round("score", 4).alias("score"))


def searched(spark: SparkSession, d: str) -> sparse.Index:
    """Documents reduced to the tokens of the benchmark's items."""
    return sparse.index(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")


def bm25_of(held: sparse.Index, k: int) -> DataFrame:
    return sparse.top_k(None, None, "doc_id", "item_id", k, held=held)


def overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    """A second ranking of documents for each benchmark item: by shared distinct tokens."""
    return sparse.overlaps(searched(spark, d), 24).select("item_id", "rank", "doc_id", "n")


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    held = searched(spark, d)
    return dense.fuse([bm25_of(held, 24), sparse.overlaps(held, 24)], "item_id", "doc_id").select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by cosine and by shared label, fused."""
    e = table(spark, d, "embeddings")
    near = dense.top_k(e, _asked(spark, d), 24)
    same = dense.top_k(e.where("label = 0"), _asked(spark, d), 24)
    return dense.fuse([near, same], "query_id", "vec_id", k=8).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


QUERIES = {
    "norm_text": norm_text, "slug": slugs, "clean_text": clean_text, "text_preview": text_preview, "token_counts": token_counts, "stopword_filter": stopword_filter,
    "line_explode": line_explode, "repeated_lines": repeated_lines, "ocr_flags": ocr_flags, "paragraph_lengths": paragraph_lengths, "bm25_fit": bm25_fit,
    "bm25_doc_weights": bm25_doc_weights, "bm25_topk": bm25_topk, "dense_topk": dense_topk, "dense_exact_filter": dense_exact_filter, "overlap_topk": overlap_topk,
    "rrf_fusion": rrf_fusion, "hybrid_topk": hybrid_topk,
}

_POSTED = f"posted AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS token FROM documents) GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) AS dl FROM posted GROUP BY 1), st AS (SELECT (SELECT count(*) FROM documents) AS n, avg(dl) AS avgdl FROM dl), terms AS (SELECT token, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posted, st GROUP BY token)"
_BM25 = f"{_POSTED}, asked AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest({_tokens('text')}) AS token FROM benchmark) GROUP BY ALL), scored AS (SELECT item_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * idf * (1 + ln(1 + qtf))), 6) AS score FROM asked JOIN terms USING (token) JOIN posted USING (token) JOIN dl USING (doc_id), st GROUP BY ALL), bm AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored)"
_OVERLAP = f"ov AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct({_tokens('text')})) AS t FROM documents) JOIN (SELECT item_id, unnest(list_distinct({_tokens('text')})) AS t FROM benchmark) USING (t) GROUP BY ALL))"


def _near(where: str, k: int, name: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id AND {where}) WHERE rank <= {k})"


def _fused(a: str, b: str, query: str, key: str, k: int, cut: int) -> str:
    return f"SELECT {query}, rank, {key}, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY {query} ORDER BY score DESC, {key}) AS rank FROM (SELECT {query}, {key}, round(sum(1.0 / (60 + rank)), 8) AS score FROM (SELECT {query}, {key}, rank FROM {a} WHERE rank <= {cut} UNION ALL SELECT {query}, {key}, rank FROM {b} WHERE rank <= {cut}) GROUP BY ALL)) WHERE rank <= {k}"


ORACLES = {
    "norm_text": f"SELECT doc_id, md5({_fold('text')}) AS norm_md5 FROM documents",
    "slug": r"SELECT doc_id, substring(CASE WHEN s = '' THEN 'document' ELSE s END, 1, 60) AS slug FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents)",
    "clean_text": r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(160), ' '), chr(173), ''), ' +([,.;:!?])', '\1', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS clean_md5 FROM documents",
    "text_preview": r"SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(substring(text, 1, 80), '\s+\S*\z', '') || '...' END AS preview FROM documents",
    "token_counts": rf"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n_words, len({_tokens('text')}) AS n_tokens FROM documents",
    "stopword_filter": f"SELECT doc_id, len(k) AS n_kept, md5(array_to_string(k, ' ')) AS kept_md5 FROM (SELECT doc_id, list_filter({_tokens('text')}, lambda t: t NOT IN ({_STOP_SQL})) AS k FROM documents)",
    "line_explode": "SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) AS n_blank, max(length(line)) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id",
    "repeated_lines": f"SELECT doc_id, key, count(*) AS n, array_to_string(list_sort(list(pos))[1:10], ',') AS lines FROM (SELECT doc_id, {_fold('line')} AS key, pos FROM (SELECT doc_id, unnest(p) AS line, unnest(range(1, len(p) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))) WHERE length(key) BETWEEN 4 AND 120 GROUP BY ALL HAVING count(*) >= 3",
    "ocr_flags": r"SELECT doc_id, contains(text, chr(65533)) AS has_replacement, regexp_matches(text, 'Ã[\x{80}-\x{bf}]') AS has_mojibake, regexp_matches(text, '[a-z][0-9]|[0-9][a-z]') AS has_letter_digit, regexp_matches(text, '[#$%&*]{3}') AS has_symbol_run, regexp_matches(text, '[a-z][A-Z]') AS has_joined_words FROM documents",
    "paragraph_lengths": r"SELECT doc_id, count(*) AS n_paragraphs, sum(length(p)) AS n_chars, max(length(p)) AS longest FROM (SELECT doc_id, trim(unnest(string_split_regex(text, '\n\s*\n')), chr(32) || chr(9) || chr(10) || chr(13)) AS p FROM documents) WHERE p <> '' GROUP BY doc_id",
    "bm25_fit": f"WITH {_POSTED} SELECT token, df, round(idf, 6) AS idf FROM terms",
    "bm25_doc_weights": f"WITH {_POSTED} SELECT doc_id, count(*) AS n_terms, round(sum(w), 4) AS weight_sum, round(max(w), 4) AS weight_max FROM (SELECT doc_id, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS w FROM posted JOIN terms USING (token) JOIN dl USING (doc_id), st) GROUP BY doc_id",
    "bm25_topk": f"WITH {_BM25} SELECT item_id, rank, doc_id, round(score, 3) AS score FROM bm WHERE rank <= 10",
    "dense_topk": f"WITH {_near('true', 10, 'n')} SELECT query_id, rank, vec_id, round(score, 4) AS score FROM n",
    "dense_exact_filter": f"WITH {_near('e.label IN (0, 1)', 5, 'n')} SELECT query_id, rank, vec_id, round(score, 4) AS score FROM n",
    "overlap_topk": f"WITH {_OVERLAP} SELECT item_id, rank, doc_id, n FROM ov WHERE rank <= 24",
    "rrf_fusion": f"WITH {_BM25}, {_OVERLAP} " + _fused("bm", "ov", "item_id", "doc_id", 10, 24),
    "hybrid_topk": f"WITH {_near('true', 24, 'a')}, {_near('e.label = 0', 24, 'b')} " + _fused("a", "b", "query_id", "vec_id", 8, 24),
}

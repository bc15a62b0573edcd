"""Cross-references as edges: extraction by pattern, resolution against known targets, dedup, inverses, reasons."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from .citations import node_id
from .spans import Pattern, drop_hidden, find_spans


#: Patterns of references on folded text.
ARTICLE, CLAUSE, POINT = r"dieu\s+(\d+[a-z]?)", r"khoan\s+(\d+)", r"diem\s+([a-z](?:\.\d+)?)"


def legal_references(folded: Column) -> Column:
    """Distinct article, clause and point numbers, in order: struct of three arrays."""
    return F.struct(*[F.array_distinct(F.regexp_extract_all(folded, F.lit(p), F.lit(1))).alias(n) for n, p in (("articles", ARTICLE), ("clauses", CLAUSE), ("points", POINT))])


def link_references(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, place, target of each href."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"href=[\"']([^\"']*)[\"']"), F.lit(1))).alias("place", "target"))


def edge_id(*parts: Column) -> Column:
    """ref_edge: and the first 16 hex digits of the parts' SHA-1."""
    return F.concat(F.lit("ref_edge:"), F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 16))


def resolve(refs: DataFrame, known: DataFrame, source: str) -> DataFrame:
    """refs (source, place, target, .. ) with resolved (is there such a target?) and without self references. known: target, node."""
    joined = refs.join(known.select("target", "node"), "target", "left")
    return joined.withColumn("resolved", F.col("node").isNotNull()).where(F.col("node").isNull() | (F.col("node") != F.col(source)))


def dedupe(edges: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first edge of each key and how many more there were."""
    return edges.groupBy(*keys).agg(F.min(order).alias(order), (F.count("*") - 1).alias("duplicates"))


def with_inverse(edges: DataFrame, source: str, target: str, kind: str, inverse: str) -> DataFrame:
    """Edges of `kind` and, for each, one back of kind `inverse`."""
    forward = edges.select(F.col(source).alias("src"), F.col(target).alias("dst"), F.lit(kind).alias("kind"))
    return forward.union(forward.select(F.col("dst"), F.col("src"), F.lit(inverse)))


@dataclass(frozen=True)
class Names:
    """How texts name documents, over folded text.

    aliases: (name, document), the first that is met counts. relative: (name, prefix, {article: document}): the text's own document
    if its id starts with the prefix, but another one in some articles. scopes: documents whose article `scope_article` speaks of
    `scope_target` unless it names another.
    """

    aliases: tuple[tuple[str, str], ...]
    relative: tuple[tuple[str, str, dict[str, str]], ...] = ()
    scopes: tuple[str, ...] = ()
    scope_article: str = "1"
    scope_target: str | None = None


def _own(document: Column, article: Column, prefix: str, others: dict[str, str]) -> Column:
    target = F.when(document.startswith(prefix) & (document != ""), document)
    for number, other in others.items():
        target = F.when(article == number, F.lit(other)).otherwise(target)
    return target


def named_document(c: Column, names: Names, document: Column, article: Column) -> Column:
    """The document that a name means: one relative to the text's own, or the first alias that it holds; null if none."""
    found = F.lit(None).cast("string")
    for alias, target in reversed(names.aliases):
        found = F.when(F.contains(c, F.lit(alias)), F.lit(target)).otherwise(found)
    for alias, prefix, others in names.relative:
        found = F.when(c == alias, F.coalesce(_own(document, article, prefix, others), found)).otherwise(found)
    return found


def first_named(c: Column, names: Names, document: Column, article: Column) -> Column:
    """The document of the first name in a text, the longest of several at one place; null if there is none."""
    every = [(alias, F.lit(target)) for alias, target in names.aliases] + [(alias, _own(document, article, prefix, others)) for alias, prefix, others in names.relative]
    met = F.array(*[F.when(target.isNotNull() & F.contains(c, F.lit(alias)), F.struct(F.instr(c, alias).alias("at"), F.lit(-len(alias)).alias("less"), target.alias("target"))) for alias, target in every])
    return F.array_min(F.filter(met, lambda x: x.isNotNull()))["target"]


def target_document(names: Names, document: Column, article: Column, name: Column, suffix: Column) -> Column:
    """What a reference to an article refers to: the document it names, the first that the rest of its sentence names, the one its scope
    is about, or its own."""
    default = F.when(document.isin(*names.scopes) & (article == names.scope_article), F.lit(names.scope_target)) if names.scopes else F.lit(None).cast("string")
    own = F.coalesce(document, F.lit(""))
    return F.coalesce(named_document(name, names, own, article), first_named(suffix, names, own, article), default, own)


def parse_references(chunks: DataFrame, parts: list[tuple[str, str | None]], patterns: list[Pattern], names: Names, documents: dict[str, str]) -> DataFrame:
    """chunk_id, document_id, article_number, part, place, pattern, start, item, raw_start, raw_end, raw, matched, normalized, target_document,
    article, clause, point, target_id, level, confidence: the references of chunks (chunk_id, document_id, article_number, ..).

    parts: the text columns in order, each with the mark that matching starts behind, or none. Patterns have groups article, clause,
    point, clauses (a list: one row for each, numbered by item) and document, or kind, number and year; documents: a format for
    the id of each kind. Chunks have ids of their own; a chunk with a null id or text has no references.
    """
    key = ["chunk_id", "document_id", "article_number", "part"]
    found = None
    for i, (column, mark) in enumerate(parts):
        rows = chunks.where(F.col("chunk_id").isNotNull() & F.col(column).isNotNull()).withColumn("part", F.lit(i))
        spans = find_spans(rows, key, column, patterns, after=mark)
        found = spans if found is None else found.unionByName(spans)
    spans = drop_hidden(found, ["chunk_id", "part"], patterns)
    group = lambda name: F.try_element_at("groups", F.lit(name))
    numbers = F.regexp_extract_all(group("clauses"), F.lit(r"(\d+)"), F.lit(1))
    spans = spans.select("*", F.posexplode_outer(numbers).alias("item", "listed"))
    by_kind = F.lit(None).cast("string")
    for kind, form in documents.items():
        by_kind = F.when(group("kind") == kind, F.format_string(form, group("number").cast("int"), group("year"))).otherwise(by_kind)
    named = target_document(names, F.col("document_id"), F.col("article_number"), F.coalesce(group("document"), F.lit("")), F.col("suffix"))
    is_document = group("kind").isNotNull()
    own = F.trim("matched")
    out = spans.select(
        *key, "place", "pattern", "start", F.coalesce("item", F.lit(0)).alias("item"), "raw_start", "raw_end", "raw", own.alias("matched"),
        F.when(F.col("listed").isNotNull(), F.concat(own, F.lit("#khoan-"), "listed")).otherwise(own).alias("normalized"),
        F.when(is_document, by_kind).otherwise(named).alias("target_document"), group("article").alias("article"), F.coalesce("listed", group("clause")).alias("clause"), group("point").alias("point"),
        is_document.alias("is_document"),
    ).where(F.col("target_document").isNotNull())
    level = F.when(F.col("article").isNull(), "document").when(F.col("clause").isNull(), "article").when(F.col("point").isNull(), "clause").otherwise("point")
    confidence = F.when(F.col("is_document"), 0.95).when(F.col("target_document") != F.coalesce("document_id", F.lit("")), 0.92).otherwise(0.82)
    target = node_id(F.col("target_document"), F.col("article"), F.col("clause"), F.col("point"))
    return out.withColumn("target_id", target).withColumn("level", level).withColumn("confidence", confidence).drop("is_document")


def cross_references(chunks: DataFrame, text: str, patterns: list[Pattern], form: str, *, main: tuple[str, str], prefix: str) -> DataFrame:
    """chunk_id, target_id, edge_type, level, matched, raw: references by one rule for the whole text, each with the raw text behind it.

    Articles are those of main (name, document) if the text names it or its own document's id starts with prefix, else of its own document.
    A pattern with a number and a year names another document, whose id has the given form: it is guided by that one. References to the chunk's own node or document
    are none.
    """
    named = F.contains(fold(F.col(text)), F.lit(main[0])) | F.coalesce(F.col("document_id").startswith(prefix), F.lit(False))
    source = source_node(*(F.col(c) for c in ("document_id", "article_number", "clause_ref", "point_ref", "chunk_id")))
    rows = chunks.where(F.col("chunk_id").isNotNull()).select("chunk_id", "document_id", source.alias("source_id"), named.alias("named"), text)
    group = lambda name: F.try_element_at("groups", F.lit(name))
    spans = find_spans(rows, ["chunk_id", "document_id", "source_id", "named"], text, patterns)
    other = F.format_string(form, group("number"), group("year"))
    document = F.when(group("number").isNotNull(), other).when(F.col("named"), main[1]).otherwise(F.col("document_id"))
    level = F.when(group("number").isNotNull(), "document").when(group("clause").isNull(), "article").when(group("point").isNull(), "clause").otherwise("point")
    out = spans.select(
        "chunk_id", "document_id", "source_id", document.alias("target"), node_id(document, group("article"), group("clause"), group("point")).alias("target_id"), F.when(level == "document", "GUIDED_BY").otherwise("REFERENCES").alias("edge_type"),
        level.alias("level"), F.trim("matched").alias("matched"), F.regexp_replace("raw", r"^\s+|\s+$", "").alias("raw"),
    )
    return out.where((F.col("target_id") != F.col("source_id")) & ~((F.col("level") == "document") & F.col("document_id").eqNullSafe(F.col("target")))).drop("document_id", "source_id", "target")


def source_node(document: Column, article: Column, clause: Column, point: Column, chunk: Column) -> Column:
    """The node of the smallest part a chunk is about, or of the chunk where it has no article."""
    named = (F.coalesce(document, F.lit("")) != "") & (F.coalesce(article, F.lit("")) != "")
    return F.when(named, node_id(document, article, clause, point)).otherwise(F.concat(F.lit("chunk:"), chunk))


def known_nodes(chunks: DataFrame) -> DataFrame:
    """node: documents, chunks, and every part that chunks are about, each once."""
    document, article, clause, point = (F.col(c) for c in ("document_id", "article_number", "clause_ref", "point_ref"))
    has = [F.coalesce(c, F.lit("")) != "" for c in (document, article, clause, point)]
    none = F.lit(None).cast("string")
    found = F.array(
        F.when(has[0], node_id(document, none, none, none)), F.concat(F.lit("chunk:"), "chunk_id"), F.when(has[0] & has[1], node_id(document, article, none, none)),
        F.when(has[0] & has[1] & has[2], node_id(document, article, clause, none)), F.when(has[0] & has[1] & has[2] & has[3], node_id(document, article, clause, point)),
    )
    return chunks.select(F.explode(found).alias("node")).where("node is not null").distinct()


def edge_type(source: Column, target: Column) -> Column:
    """By normative rank, 1 the highest: a lower text details a higher one, which it is guided by; others, and unranked ones, refer."""
    return F.when(source > target, "DETAILS").when(source < target, "GUIDED_BY").otherwise("REFERENCES")


def reference_edges(chunks: DataFrame, references: DataFrame, rank: Callable[[Column], Column]) -> DataFrame:
    """edge_id, source_id, target_id, edge_type, chunk_id, source_document, target_document, normalized, method, confidence, level,
    target_article, target_clause, target_point, resolved, duplicates.

    One edge for each source, target, type and normalized match, the first by chunk, part, pattern and place; duplicates counts the
    others. A reference to the chunk's own node is none. An edge that details a text of another document has one back. resolved:
    whether the nodes are known. rank: a document id's normative rank, or null.
    """
    about = chunks.select("chunk_id", "document_type_rank", "clause_ref", "point_ref", F.col("level").alias("chunk_level"))
    rows = references.join(about, "chunk_id")
    source = source_node(F.col("document_id"), F.col("article_number"), F.col("clause_ref"), F.col("point_ref"), F.col("chunk_id"))
    order = F.struct("chunk_id", "part", "place", "start", "item")
    rows = rows.select("*", source.alias("source_id"), order.alias("order")).where("source_id != target_id")
    rows = rows.withColumn("edge_type", edge_type(F.col("document_type_rank"), rank(F.col("target_document"))))
    nodes = known_nodes(chunks)
    rows = rows.join(nodes.select(F.col("node").alias("target_id"), F.lit(True).alias("met")), "target_id", "left").withColumn("resolved", F.coalesce("met", F.lit(False)))
    forward = F.struct(
        F.lit(0).alias("back"), "source_id", "target_id", "edge_type", F.col("document_id").alias("source_document"), "target_document", F.concat(F.lit("regex:"), "pattern").alias("method"), "level",
        F.col("article").alias("target_article"), F.col("clause").alias("target_clause"), F.col("point").alias("target_point"),
    )
    back = F.struct(
        F.lit(1).alias("back"), F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit("GUIDED_BY").alias("edge_type"), F.col("document_id").alias("source_document"), F.col("document_id").alias("target_document"),
        F.lit("inverse:guided_by").alias("method"), F.coalesce("chunk_level", F.lit("chunk")).alias("level"), F.col("article_number").alias("target_article"), F.col("clause_ref").alias("target_clause"), F.col("point_ref").alias("target_point"),
    )
    both = F.when((F.col("edge_type") == "DETAILS") & (F.coalesce("document_id", F.lit("")) != F.col("target_document")), F.array(forward, back)).otherwise(F.array(forward))
    each = rows.select("order", "chunk_id", "normalized", "confidence", "resolved", F.explode(both).alias("e"))
    best = each.groupBy("e.source_id", "e.target_id", "e.edge_type", "normalized").agg(F.min(F.struct("order", "e.back", "chunk_id", "confidence", "resolved", "e")).alias("b"), (F.count("*") - 1).alias("duplicates"))
    out = best.select("source_id", "target_id", "edge_type", "normalized", "b.chunk_id", "b.confidence", "b.resolved", "duplicates", *[f"b.e.{c}" for c in ("source_document", "target_document", "method", "level", "target_article", "target_clause", "target_point")])
    return out.withColumn("edge_id", edge_id(F.col("source_id"), F.col("edge_type"), F.col("target_id"), F.col("chunk_id"), F.col("normalized")))


def summarize_edges(edges: DataFrame) -> DataFrame:
    """what, value, n: edges by type, level, source and target document, whether resolved, and by the article they lead to."""
    article = F.when(F.col("target_id").rlike("^(article|clause|point):"), F.concat(F.split("target_id", ":")[1], F.lit(":"), F.split("target_id", ":")[2]))
    columns = {"type": F.col("edge_type"), "level": F.col("level"), "source_document": F.col("source_document"), "target_document": F.col("target_document"), "resolved": F.col("resolved").cast("string"), "article": article}
    pairs = F.array(*[F.struct(F.lit(what).alias("what"), c.alias("value")) for what, c in columns.items()])
    return edges.select(F.explode(pairs).alias("p")).where("p.value != ''").groupBy("p.what", "p.value").agg(F.count("*").alias("n"))


def unresolved_reasons(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge_id, reason of the edges that are not resolved: the largest part of the target that is not known."""
    none = F.lit(None).cast("string")
    document, article, clause = F.col("target_document"), F.col("target_article"), F.col("target_clause")
    steps = {"document": node_id(document, none, none, none), "article": node_id(document, article, none, none), "clause": node_id(document, article, clause, none)}
    out = edges.where("not resolved")
    for name, node in steps.items():
        out = out.withColumn(f"__{name}", node).join(nodes.select(F.col("node").alias(f"__{name}"), F.lit(True).alias(f"__has_{name}")), f"__{name}", "left")
    reason = F.when(F.col("__has_document").isNull(), "document").when(F.col("__has_article").isNull(), "article").when(F.col("__has_clause").isNull(), "clause").otherwise("point")
    return out.select("edge_id", F.concat(F.lit("missing_"), reason).alias("reason"))

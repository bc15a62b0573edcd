"""Hierarchy of numbered texts: headings, articles, clauses, chunks.

Lines carry their position; a heading opens a level and closes those below it, so each line's context is a forward fill over
the document's lines with resets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold

#: Levels and the folded forms of their headings, outermost first.
LEVELS = (("part", r"^phan\s+(?:thu\s+)?(\w+)"), ("chapter", r"^chuong\s+([ivxlc\d]+)"), ("section", r"^muc\s+(\d+)"), ("article", r"^dieu\s+(\d+[a-z]?)\s*[.:]"))
CLAUSE, POINT = r"^(\d+)\.\s", r"^([a-z](?:\.\d+)?)\)\s"


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("folded", fold(F.col("line")))


def with_context(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds part, chapter, section, article, clause and point: the number of the last heading of each level that no outer one has closed."""
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out, opened = lines, F.lit(-1)
    for name, pattern in (*LEVELS, ("clause", CLAUSE), ("point", POINT)):
        number = F.regexp_extract("folded", pattern, 1)
        last = F.max(F.when(number != "", F.struct("pos", number.alias("number")))).over(order)
        out = out.withColumn(f"_{name}", last)
        out = out.withColumn(name, F.when(F.col(f"_{name}.pos") > opened, F.col(f"_{name}.number")))
        opened = F.greatest(opened, F.coalesce(F.col(f"_{name}.pos"), F.lit(-1)))
    return out.drop(*[f"_{n}" for n, _ in (*LEVELS, ("clause", ""), ("point", ""))])


def article_spans(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, article, occurrence, start, end (exclusive): an article ends at the next one, or at a heading of an outer level."""
    marks = lines.select(key, "pos", *[(F.regexp_extract("folded", p, 1)).alias(n) for n, p in LEVELS]).where(" or ".join(f"{n} != ''" for n, _ in LEVELS))
    size = lines.groupBy(key).agg(F.max("pos").alias("last"))
    order = Window.partitionBy(key).orderBy("pos")
    spans = marks.withColumn("next", F.lead("pos").over(order)).where("article != ''").join(size, key)
    n = F.row_number().over(Window.partitionBy(key, "article").orderBy("pos"))
    return spans.select(key, "article", n.alias("occurrence"), F.col("pos").alias("start"), F.coalesce("next", F.col("last") + 1).alias("end"))


def pack_units(units: Column, limit: int | Column, joiner: str = "\n\n") -> Column:
    """Greedy packing of an array of texts, in order: a unit joins the last chunk if both fit into `limit` characters."""
    def add(state: Column, unit: Column) -> Column:
        # The chunk that is open stands apart, so what is done is copied once a chunk and not once a unit.
        joined = F.concat(state["open"], F.lit(joiner), unit)
        fits = F.coalesce(F.length(joined) <= limit, F.lit(False))
        closed = F.when(fits | state["open"].isNull(), state["done"]).otherwise(F.array_append(state["done"], state["open"]))
        return F.struct(closed.alias("done"), F.when(fits, joined).otherwise(unit).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))
    return F.aggregate(units, start, add, lambda state: F.when(state["open"].isNull(), state["done"]).otherwise(F.array_append(state["done"], state["open"])))


def dedupe_ids(rows: DataFrame, id_col: str, *order: str) -> DataFrame:
    """The second and later rows of one id get `_Chunk_nn` behind it."""
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    return rows.withColumn("place", n).withColumn(id_col, F.when(F.col("place") > 1, F.concat(F.col(id_col), F.lit("_Chunk_"), F.format_string("%02d", "place"))).otherwise(F.col(id_col))).drop("place")


def parents(chunks: DataFrame, key: str, level: str, order: str) -> DataFrame:
    """parent: the id of the last row of the level above (level is 0, 1, 2 ..) before each row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = chunks.withColumn("parent", F.lit(None).cast("string"))
    for n in (1, 2, 3):
        above = F.max(F.when(F.col(level) == n - 1, F.struct(order, "chunk_id"))).over(w)
        out = out.withColumn("parent", F.when(F.col(level) == n, above["chunk_id"]).otherwise(F.col("parent")))
    return out

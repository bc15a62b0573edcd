"""Texts of articles with appendices: where the one ends and the others begin, and appendices in blocks that repeat their heading.

A text's lines are rows; where its footer and its headings are follows from windows over them, with one exchange by text. Blocks are
packed by a fold over their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from .citations import id_token
from .structure import pack_units
from .units import SHORT, read_lines, strip

#: Headings of appendices and forms, what ends the articles, and the headings of tables for two groups.
APPENDIX = r"(?iU)^PHỤ\s+LỤC(?:\s+([IVXLCDM0-9A-Z]+))?\b"
FORM = r"(?iU)^Mẫu\s+số\s+(\d+)\s*/?\s*(PL[IVXLCDM]+)"
FOOTER, FOOTERS = r"(?iU)^(?:Nơi nhận\b|TM\.\s|KT\.\s)", ("BỘ TRƯỞNG", "THỦ TƯỚNG", "CHÍNH PHỦ")
GROUPS = (("lao dong nam", "Bang_Nam", "Lao động nam"), ("lao dong nu", "Bang_Nu", "Lao động nữ"))
UNKNOWN = "Khong_Ro"


def split_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, line, bare, part (main, appendix or null), kind (appendix, form or null): the lines of each text.

    The main text ends before the first footer after an article, the appendix begins at the first heading after that. Without such a footer
    both are at the first heading after the last article; a text without articles is all main. Lines between are of neither part.
    """
    bare = strip("line")
    kind = F.when(bare.rlike(APPENDIX), "appendix").when(bare.rlike(FORM), "form")
    lines = read_lines(docs, key=key, text=text).select(key, "pos", "line", bare.alias("bare"), (F.col("kind") == "article").alias("is_article"), kind.alias("kind"))
    whole, upto = Window.partitionBy(key), Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    article = F.coalesce("is_article", F.lit(False))
    is_footer = F.col("bare").rlike(FOOTER) | F.col("bare").isin(*FOOTERS)
    seen = lines.withColumn("after", F.coalesce(F.bool_or(article).over(upto), F.lit(False)) & ~article & is_footer)
    out = seen.select("*", F.min(F.when(F.col("after"), F.col("pos"))).over(whole).alias("footer"), F.max(F.when(article, F.col("pos"))).over(whole).alias("last"))
    out = out.withColumn("opening", F.min(F.when(F.col("kind").isNotNull() & (F.col("pos") > F.coalesce("footer", "last")), F.col("pos"))).over(whole))
    in_main = F.col("last").isNull() | (F.col("pos") < F.coalesce("footer", "opening", F.col("pos") + 1))
    part = F.when(in_main, "main").when(F.col("pos") >= F.col("opening"), "appendix")
    return out.select(key, "pos", "line", "bare", part.alias("part"), "kind")


def split_texts(lines: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, main, appendix: both parts of each text; a part without lines is empty."""
    def joined(part: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("pos", "line"))))
        return strip(F.array_join(F.transform(rows, lambda x: x["line"]), "\n")).alias(part)

    return lines.groupBy(key).agg(joined("main"), joined("appendix"))


def pack_lines(heading: Column, lines: Column, limit: int) -> Column:
    """The heading with as many lines as fit into `limit` characters, again and again; a line that does not fit stands alone behind it,
    and without lines the heading does."""
    groups = pack_units(lines, F.lit(limit) - F.length(heading) - 1, joiner="\n")
    return F.when(F.size(lines) == 0, F.array(heading)).otherwise(F.transform(groups, lambda g: F.concat(heading, F.lit("\n"), g)))


def _from(lines: Column, place: Column, size: Column | None = None) -> Column:
    return F.slice(lines, place, F.greatest(F.size(lines) if size is None else size, F.lit(0)))


def blocks(lines: DataFrame, prefix: Column, limit: int, *, key: str = "doc_id", tabular: Column | None = None) -> DataFrame:
    """key, index (from 1 in each text), chunk_id, appendix_id, heading, chunk_type, text: the appendices in blocks of at most `limit`
    characters, as far as single lines allow. Blocks of under SHORT characters are left out.

    prefix and tabular are columns over key. In a text that is tabular, appendices only begin blocks, their second line is part of their
    heading, and one with a heading for each of two groups is two tables; one without any appendix's heading is one block. Ids of one
    appendix may repeat, if its label does. Blank lines are dropped.
    """
    tabular = F.lit(False) if tabular is None else F.coalesce(tabular, F.lit(False))
    upto, whole = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key)
    rows = lines.where("part = 'appendix' and bare != ''").withColumn("tabular", tabular)
    opens = F.when(F.col("tabular"), F.coalesce(F.col("kind") == "appendix", F.lit(False))).otherwise(F.col("kind").isNotNull())
    rows = rows.withColumn("opens", opens.cast("int")).select("*", F.sum("opens").over(upto).alias("block"), F.sum("opens").over(whole).alias("n"))
    own = rows.where("block > 0 or (tabular and n = 0)").groupBy(key, "block", "tabular").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "bare"))), lambda x: x["bare"]).alias("all"))
    first, second = F.get("all", F.lit(0)), F.coalesce(F.get("all", F.lit(1)), F.lit(""))
    label = F.upper(F.regexp_extract(first, APPENDIX, 1))
    label = F.when(label == "", UNKNOWN).otherwise(id_token(label))
    is_form = ~F.col("tabular") & ~first.rlike(APPENDIX) & first.rlike(FORM)
    code = F.upper(id_token(F.regexp_extract(first, FORM, 2)))
    form_id = F.concat_ws("_", F.lit("Phu_Luc"), F.substring(code, F.lit(3), F.length(code)), F.lit("Mau"), id_token(F.regexp_extract(first, FORM, 1)), code)
    titled = F.regexp_replace(F.concat(first, F.lit(". "), second), r"^[. ]+|[. ]+$", "")
    own = own.select(
        key, "block", "tabular", "all", F.when(is_form, form_id).otherwise(F.concat(F.lit("Phu_Luc_"), label)).alias("id"), F.when(F.col("tabular"), titled).otherwise(first).alias("heading"),
        F.when(F.col("tabular"), "appendix_list").when(is_form, "appendix_form").otherwise("appendix").alias("type"), F.when(is_form, "Phan").otherwise("Nhom").alias("suffix"),
        _from(F.col("all"), F.when(F.col("tabular"), 3).otherwise(2)).alias("body"),
    )
    own = own.withColumn("folded", F.when(F.col("tabular"), F.transform("body", fold)))
    m, w = (F.coalesce(F.array_position("folded", F.lit(g[0])), F.lit(0)).cast("int") for g in GROUPS)
    spec = [F.col("id"), F.col("heading"), F.col("type"), F.col("body")]
    tables = [(F.concat("id", F.lit(f"_{token}")), F.concat("heading", F.lit(f". {name}")), F.lit("appendix_table"), rows) for (_, token, name), rows in zip(GROUPS, (_from(F.col("body"), m + 1, w - m - 1), _from(F.col("body"), w + 1)), strict=True)]
    named = ("id", "heading", "type", "body")
    as_struct = [F.struct(*[c.alias(n) for c, n in zip(s, named, strict=True)]) for s in (spec, *tables)]
    each = own.select(key, "block", "suffix", F.posexplode(F.when((m > 0) & (m < w), F.array(*as_struct[1:])).otherwise(F.array(as_struct[0]))).alias("table", "s"))
    base = F.concat_ws("_", prefix, F.col("s.id"))
    packed = each.select(key, "block", "table", "suffix", base.alias("appendix_id"), F.col("s.heading").alias("heading"), F.col("s.type").alias("chunk_type"), pack_lines(F.col("s.heading"), F.col("s.body"), limit).alias("texts"))
    out = packed.select("*", F.posexplode("texts").alias("i", "text"))
    chunk_id = F.when(F.size("texts") == 1, F.col("appendix_id")).otherwise(F.concat("appendix_id", F.lit("_"), "suffix", F.lit("_"), F.format_string("%02d", F.col("i") + 1)))
    kept = out.withColumn("chunk_id", chunk_id).where(F.length("text") >= SHORT)
    return kept.withColumn("index", F.row_number().over(Window.partitionBy(key).orderBy("block", "table", "i"))).select(key, "index", "chunk_id", "appendix_id", "heading", "chunk_type", "text")

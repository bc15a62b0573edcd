"""Articles, clauses and points of numbered texts, and how they are cut into chunks.

A text's lines are rows. Headings and articles open blocks; within an article's block, markers open clauses and points. What a line
belongs to follows from the last marker of each kind before it, which windows over the text's lines give; all of them, and the
grouping of lines into units, need the one exchange by text.

Chunks are made of column functions over an article's row: a ladder of boundaries splits what is too long, and folds pack the pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, paragraphs
from .structure import pack_units

#: What headings, articles and markers look like at the start of a line.
HEADINGS = {"part": r"(?iu)^PHẦN\s+(.+)$", "chapter": r"(?iu)^CHƯƠNG\s+([IVXLCDM0-9]+[A-ZĐ]?)\.?\s*(?:.*)$", "section": r"(?iu)^MỤC\s+([IVXLCDM0-9]+)\.?\s*(?:.*)$"}
ARTICLE = r"^Điều\s+(\d+[A-Za-z]?)\.\s*(.*)$"
MARKERS = {"clause": r"^(\d+)\.(?!\d)\s+.*$", "point": r"(?iu)^([a-zđ](?:\.?\d+)?)\)\s+.*$"}
#: Signs that may stand before a marker, boundaries of the ladder, and markers of segments.
BEFORE_MARKER = "[\\s\"'`“”‘’\\-–—•]+"
LADDER = (r"(?md)^(?=\d+\.\s)", r"(?md)^(?=[a-zđ]\.\d+\)\s)", r"(?md)^(?=[a-zđ]\)\s)", r"(?<=[.;])\s+")
SEGMENTS = r"(?imud)^(?=[a-zđ]\.\d+\)\s|[a-zđ]\)\s|\d+\.\s)"
SEGMENT_POINT, SEGMENT_CLAUSE = r"(?iu)^([a-zđ](?:\.\d+)?)\)\s", r"^(\d+)\.\s"

BLANK = " \t\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　"
LINE_ENDS = "[\n\x0b\x0c\x1c-\x1e\x85  ]"
SHORT = 20
RECORDS = "array<struct<text:string,clause_ref:string,point_refs:array<string>,chunk_type:string>>"
POINTS = "array<struct<ref:string,parts:array<string>>>"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def read_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, line, kind (part, chapter, section, article, clause, point or null), number, title: the lines of each text, which
    white space at its ends is no part of. A null text has none, an empty one has one."""
    whole = strip(F.regexp_replace(F.col(text), "\r\n?", "\n"))
    lines = docs.select(key, F.posexplode(F.split(whole, LINE_ENDS)).alias("pos", "line"))
    bare = strip("line")
    body = F.regexp_replace("line", f"^{BEFORE_MARKER}", "")
    shapes = [(kind, bare, pattern) for kind, pattern in {**HEADINGS, "article": ARTICLE}.items()] + [(kind, strip(body), pattern) for kind, pattern in MARKERS.items()]
    kind, number = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, value, pattern in reversed(shapes):
        is_one = value.rlike(pattern)
        kind, number = F.when(is_one, name).otherwise(kind), F.when(is_one, collapse(F.regexp_extract(value, pattern, 1))).otherwise(number)
    return lines.select("*", kind.alias("kind"), number.alias("number"), F.when(F.col("kind") == "article", collapse(F.regexp_extract(bare, ARTICLE, 2))).alias("title"))


def with_places(lines: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Adds what each line belongs to, as structs of pos, kind and number, or null: head (the last heading or article), part, chapter,
    section (outer ones close inner ones), and within an article clause and mark (the last clause or point)."""
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    here = F.struct("pos", "kind", "number", "title")

    def last(*kinds: str) -> Column:
        return F.max(F.when(F.col("kind").isin(*kinds), here)).over(upto)

    out = lines.select("*", last(*HEADINGS, "article").alias("head"), *[last(k).alias(k) for k in HEADINGS])
    out = out.withColumn("chapter", F.when(F.col("chapter.pos") > F.coalesce("part.pos", F.lit(-1)), F.col("chapter")))
    out = out.withColumn("section", F.when(F.col("section.pos") > F.greatest(F.coalesce("part.pos", F.lit(-1)), F.coalesce("chapter.pos", F.lit(-1))), F.col("section")))
    # Markers count in articles only; what an article opens, the next head closes.
    marked = F.when(F.col("head.kind") == "article", F.col("kind"))
    out = out.withColumn("kind", F.when(F.col("kind").isin(*MARKERS), marked).otherwise(F.col("kind")))
    out = out.select("*", last("clause").alias("clause"), last(*MARKERS).alias("mark"))
    return out.withColumn("clause", F.when(F.col("clause.pos") > F.col("head.pos"), F.col("clause"))).withColumn("mark", F.when(F.col("mark.pos") > F.col("head.pos"), F.col("mark")))


def _text(of: str = "line") -> Column:
    return strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", of))), lambda x: x[of]), "\n"))


def headings(placed: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, start, level, number, heading: the text of a heading goes on to the next heading or article."""
    rows = placed.where(F.col("head.kind").isin(*HEADINGS)).groupBy(key, F.col("head.pos").alias("start"), F.col("head.kind").alias("level"), F.col("head.number").alias("number"))
    return rows.agg(collapse(_text()).alias("heading"))


def parse_units(placed: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, level (article, clause, point), start, end (lines, the end exclusive), number, title (of the article), article, clause,
    point (numbers), part, chapter, section (numbers), parent_start (of the unit or heading that it is in, or null), text.

    An article ends before the next article or heading, a clause before the next clause, a point before the next point or clause. A
    point before any clause is its article's. Units without text are left out; a number may occur any number of times.
    """
    none = F.lit(None).cast("int")
    article = F.struct(F.lit("article").alias("level"), F.col("head.pos").alias("start"), F.coalesce("section.pos", "chapter.pos", "part.pos").alias("parent"))
    clause = F.when(F.col("clause").isNotNull(), F.struct(F.lit("clause").alias("level"), F.col("clause.pos").alias("start"), F.col("head.pos").alias("parent")))
    point = F.when(F.col("mark.kind") == "point", F.struct(F.lit("point").alias("level"), F.col("mark.pos").alias("start"), F.coalesce("clause.pos", "head.pos").alias("parent")))
    rows = placed.where("head.kind = 'article'").withColumn("unit", F.explode(F.filter(F.array(article, clause, point), lambda x: x.isNotNull())))
    level = F.col("unit.level")
    numbers = [F.first("head.number").alias("article"), F.first(F.when(level != "article", F.col("clause.number"))).alias("clause"), F.first(F.when(level == "point", F.col("mark.number"))).alias("point")]
    units = rows.groupBy(key, level.alias("level"), F.col("unit.start").alias("start")).agg(
        (F.max("pos") + 1).alias("end"), F.first("head.title").alias("title"), *numbers, *[F.first(f"{k}.number").alias(k) for k in HEADINGS], F.first("unit.parent").alias("parent_start"), _text().alias("text")
    )
    return units.where("text != ''").withColumn("parent_start", F.coalesce("parent_start", none))


def summarize_units(units: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, n_article, n_clause, n_point, n_short (texts of under SHORT characters), n_untitled (articles), n_repeated (articles whose number occurs before)."""
    n = [F.count_if(F.col("level") == x).alias(f"n_{x}") for x in ("article", "clause", "point")]
    is_article = F.col("level") == "article"
    return units.groupBy(key).agg(*n, F.count_if(F.length("text") < SHORT).alias("n_short"), F.count_if(is_article & (F.col("title") == "")).alias("n_untitled"), (F.count_if(is_article) - F.count_distinct(F.when(is_article, F.col("article")))).alias("n_repeated"))


def _cut(c: Column, boundary: str) -> Column:
    return F.filter(F.transform(F.split(c, boundary), strip), lambda x: x != "")


def _cut_at_spaces(c: Column, limit: Column) -> Column:
    """Pieces of at most `limit` (2 or more) characters that end before white space; a longer word is a piece of its own."""
    pattern = F.concat(F.lit(r"(?s)\S.{0,"), (limit - 2).cast("string"), F.lit(r"}\S(?:\s|\z)|\S(?:\s|\z)|\S+"))
    return F.transform(F.regexp_extract_all(c, pattern, F.lit(0)), strip)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), then)[0]


def split_text(c: Column, limit: Column, ladder: tuple[str, ...] = LADDER) -> Column:
    """A text in pieces of at most `limit` characters, in order.

    What is too long is cut at the first boundary of the ladder that it has; its parts are split on by the boundaries below, and what comes
    out of that is packed, a line break between. What no boundary cuts is cut at white space; only a longer word stays longer.
    """

    def pieces(whole: Column) -> Column:
        if not ladder:
            longer = _cut_at_spaces(whole, limit)
        else:
            parts = F.flatten(F.transform(F.array(whole), lambda w: _cut(w, ladder[0])))
            below = F.struct(F.size(parts).alias("n"), F.flatten(F.transform(parts, lambda x: split_text(x, limit, ladder[1:]))).alias("all"))
            longer = _let(below, lambda b: F.when(b["n"] > 1, pack_units(b["all"], limit, "\n")).otherwise(b["all"]))
        return F.when(F.coalesce(whole, F.lit("")) == "", F.array().cast("array<string>")).when(F.length(whole) <= limit, F.array(whole)).otherwise(longer)

    return _let(strip(c), pieces)


def compose(heading: Column, parts: Column) -> Column:
    """The heading and the parts that are not blank, blank lines between."""
    return F.array_join(F.concat(F.array(heading), F.filter(F.transform(parts, strip), lambda x: x != "")), "\n\n")


def _record(text: Column, clause: Column, points: Column, kind: Column) -> Column:
    return F.struct(text.alias("text"), clause.cast("string").alias("clause_ref"), points.cast("array<string>").alias("point_refs"), kind.alias("chunk_type"))


def _whole_article(heading: Column, parts: Column, limit: int, kind: str) -> Column:
    """One chunk, or as many as the limit makes, each with the heading."""
    body = F.array_join(F.filter(F.transform(parts, strip), lambda x: x != ""), "\n\n")
    room = F.greatest(limit - F.length(heading) - 2, F.lit(100))
    texts = _let(body, lambda b: F.when(F.length(compose(heading, F.array(b))) <= limit, F.array(b)).when(b == "", F.array(b)).otherwise(split_text(b, room)))
    return F.transform(texts, lambda x: _record(compose(heading, F.array(x)), F.lit(None), F.array(), F.lit(kind)))


def _split_beside(heading: Column, prefix: Column, body: Column, limit: int) -> Column:
    """body in pieces that fit beside the heading and the prefix (but of 100 characters at least)."""
    room = F.greatest(limit - F.length(compose(heading, prefix)) - 2, F.lit(100))
    return F.when(strip(body) == "", F.array(F.lit(""))).otherwise(split_text(body, room))


def _clause(heading: Column, intro: Column, clause: Column, limit: int) -> Column:
    """The chunks of one clause: whole if it fits, else points packed behind its introduction, and too long ones split."""
    points = clause["points"]
    prefix = F.concat(intro, clause["intro"])
    every = lambda chosen: F.concat(prefix, F.flatten(F.transform(chosen, lambda p: p["parts"])))
    size = lambda parts: F.length(compose(heading, parts))
    made = lambda chosen, kind: _record(compose(heading, every(chosen)), clause["ref"], F.transform(chosen, lambda p: p["ref"]), F.lit(kind))
    pieces = _split_beside(heading, intro, F.array_join(clause["intro"], "\n\n"), limit)
    plain = _let(pieces, lambda own: F.transform(own, lambda x: _record(compose(heading, F.concat(intro, F.array(x))), clause["ref"], F.array(), F.when(F.size(own) == 1, "clause").otherwise("clause_part"))))
    part = lambda chosen: made(chosen, "clause_part")
    no_points, no_records = F.array().cast(POINTS), F.array().cast(RECORDS)

    def add(state: Column, point: Column) -> Column:
        pending = state["pending"]
        full = (F.size(pending) > 0) & (size(every(F.array_append(pending, point))) > limit)
        alone = size(F.concat(prefix, point["parts"])) > limit
        done = F.when((full | alone) & (F.size(pending) > 0), F.array_append(state["done"], part(pending))).otherwise(state["done"])
        cut = _split_beside(heading, prefix, F.array_join(point["parts"], "\n\n"), limit)
        split = F.transform(cut, lambda x: _record(compose(heading, F.concat(prefix, F.array(x))), clause["ref"], F.array(point["ref"]), F.lit("clause_part")))
        left = F.when(alone, no_points).when(full, F.array(point)).otherwise(F.array_append(pending, point))
        return F.struct(F.when(alone, F.concat(done, split)).otherwise(done).alias("done"), left.alias("pending"))

    def finish(state: Column) -> Column:
        return F.when(F.size(state["pending"]) > 0, F.array_append(state["done"], part(state["pending"]))).otherwise(state["done"])

    packed = F.aggregate(points, F.struct(no_records.alias("done"), no_points.alias("pending")), add, finish)
    return F.when(F.size(points) == 0, plain).when(size(every(points)) <= limit, F.array(made(points, "clause"))).otherwise(packed)


def clause_groups(articles: DataFrame, key: list[str], body: str) -> DataFrame:
    """key, intro (parts before any clause), clauses (ref, intro, points (ref, parts)), body_parts: the segments of each article's body.

    Paragraphs are cut where a line starts with a marker. Points before any clause make a clause without a number.
    """
    segments = F.flatten(F.transform(paragraphs(F.col(body)), lambda p: _cut(p, SEGMENTS)))
    rows = articles.select(*key, F.posexplode_outer(segments).alias("pos", "segment"))
    point, clause = F.regexp_extract("segment", SEGMENT_POINT, 1), F.regexp_extract("segment", SEGMENT_CLAUSE, 1)
    upto = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*key, "pos", "segment", point.alias("point"), clause.alias("number")).withColumn("c", F.count_if(F.col("number") != "").over(upto)).withColumn("p", F.count_if(F.col("point") != "").over(upto))
    rows = rows.withColumn("p", F.when(F.max(F.when(F.col("number") != "", F.col("pos"))).over(upto) > F.coalesce(F.max(F.when(F.col("point") != "", F.col("pos"))).over(upto), F.lit(-1)), 0).otherwise(F.col("p")))
    parts = lambda c: F.transform(F.array_sort(c), lambda x: x["segment"])
    held = F.filter(F.collect_list(F.struct("pos", "segment")), lambda x: x["segment"].isNotNull())
    points = rows.groupBy(*key, "c", "p").agg(parts(held).alias("parts"), F.max("point").alias("ref"), F.max("number").alias("number"))
    own = F.struct("p", F.struct("ref", "parts").alias("point"))
    clauses = points.groupBy(*key, "c").agg(F.array_sort(F.collect_list(own)).alias("all"), F.max("number").alias("number"))
    intro = F.flatten(F.transform(F.filter("all", lambda x: x["p"] == 0), lambda x: x["point"]["parts"]))
    named = clauses.select(*key, "c", F.when(F.col("c") == 0, F.array().cast("array<string>")).otherwise(intro).alias("intro"), F.when(F.col("c") == 0, intro).alias("before"), F.when(F.col("number") != "", F.col("number")).alias("ref"), F.transform(F.filter("all", lambda x: x["p"] > 0), lambda x: x["point"]).alias("points"))
    group = F.struct("c", F.struct("ref", "intro", "points").alias("g"))
    out = named.groupBy(*key).agg(F.max("before").alias("before"), F.array_sort(F.collect_list(F.when((F.col("c") > 0) | (F.size("points") > 0), group))).alias("all"))
    return out.select(*key, F.coalesce("before", F.array().cast("array<string>")).alias("intro"), F.transform("all", lambda x: x["g"]).alias("clauses"))


def chunk_articles(articles: DataFrame, *, key: list[str], number: str = "article", heading: str = "heading", body: str = "body", limit: int = 1200, sequential: tuple[str, ...] = ()) -> DataFrame:
    """key, index (from 1), text, clause_ref, point_refs, chunk_type: the chunks of each article, of at most `limit` characters unless a
    heading, an introduction or a word leaves no room.

    A clause that fits is a chunk, behind the heading and what stands before the first clause. Of a longer one points are packed; each chunk
    repeats the heading and the introductions. What stands before the first clause is a chunk too. Articles without clauses, and those whose number is in
    `sequential`, are cut as they run. The key tells articles apart; a null heading or body counts as empty.
    """
    rows = articles.select(*key, F.coalesce(F.col(number), F.lit("")).alias("__number"), strip(F.coalesce(F.col(heading), F.lit(""))).alias("__heading"), F.coalesce(F.col(body), F.lit("")).alias("__body"))
    groups = clause_groups(rows, key, "__body")
    joined = rows.join(groups, key)
    h = F.col("__heading")
    whole = lambda parts, kind: _whole_article(h, parts, limit, kind)
    by_clause = F.flatten(F.transform("clauses", lambda c: _clause(h, F.col("intro"), c, limit)))
    intro = F.flatten(F.transform(F.filter(F.array("intro"), lambda x: F.size(x) > 0), lambda x: whole(x, "article_intro")))
    made = F.when(F.col("__number").isin(*sequential), whole(paragraphs(F.col("__body")), "article_sequential")) if sequential else F
    made = made.when(F.size("clauses") == 0, whole(paragraphs(F.col("__body")), "article_full")).otherwise(F.concat(intro, by_clause))
    return joined.select(*key, F.posexplode(made).alias("index", "r")).select(*key, (F.col("index") + 1).alias("index"), "r.*")

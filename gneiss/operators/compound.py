"""Citation fields of benchmark cases: compound citations become atomic ones, in and out of a scope of documents, and what was observed
is scored against them.

A field holds fragments between semicolons. A fragment that names one article with several clauses, one clause with several points, or
several articles and nothing else, becomes one citation each; one that could be read in several ways stays as it is. The document is the
fragment's own, or else the only one that its field names. Rows are worked on by themselves; a case's rows meet once, after repeated
citations have been dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from . import citations as C
from .units import strip

#: Patterns of articles and clauses over bare words, and of points over folded text.
ARTICLE = r"\bdieu\s+(\d+[a-z]?)"
CLAUSE = r"\bkhoan\s+(\d+)"
POINTS = r"\bdiem\s+([a-z](?:\s*(?:,|va)\s*[a-z])*)"
#: How what is observed must cover what is expected: as text, by its parts, or by its parts where those not named stand for all.
MODES = ("literal", "normalized", "containment")


@dataclass(frozen=True)
class Family:
    """A document: its name, how it is cited, and bare words that tell it."""

    name: str
    label: str
    signatures: tuple[str, ...]


def _words(form: Column) -> Column:
    """Bare words of folded text."""
    return F.trim(F.regexp_replace(form, " [^a-z0-9]+|[^a-z0-9 ][^a-z0-9]*", " "))


def _family(words: Column, families: list[Family]) -> Column:
    """The name of the only document that bare words name, or null."""
    return C.only(C.families_of(words, [(f.name, list(f.signatures)) for f in families]))


def family(c: Column, families: list[Family]) -> Column:
    """The name of the only document that a citation names, or null."""
    return _family(_words(fold(F.coalesce(c, F.lit("")))), families)


def _label(name: Column, families: list[Family]) -> Column:
    if not families:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for f in families for x in (f.name, f.label)])[name]


def _cited(label: Column, article: Column, clause: Column | None = None, point: Column | None = None) -> Column:
    parts = [F.concat(F.lit("Điều "), article)]
    if clause is not None:
        parts.append(F.concat(F.lit("khoản "), clause))
    if point is not None:
        parts.append(F.concat(F.lit("điểm "), point))
    return F.concat_ws(" ", *parts, label)


def _values(c: Column, pattern: str) -> Column:
    return F.array_distinct(C.all_of(c, pattern))


def atoms(fields: DataFrame, families: list[Family]) -> DataFrame:
    """case_id, place (from 0), citation of case_id, field (its place in the case), text: each citation of a case once, in order.

    Null and empty fields and fragments give none. Fields with equal places are taken in the order of their texts.
    """
    # A field is folded once; its folded text has the same parts.
    texts = fields.where("text != ''").withColumn("folded", fold(F.col("text"))).withColumn("default", _family(_words(F.col("folded")), families))
    parts = F.arrays_zip(F.transform(F.split(strip("text"), r"\s*;\s*"), strip).alias("part"), F.split("folded", r"\s*;\s*").alias("folded"))
    rows = texts.select("case_id", F.struct("field", "text").alias("at"), "default", F.posexplode(parts).alias("i", "each"))
    rows = rows.select("case_id", "at", "default", "i", "each.part", "each.folded").where("part != ''").withColumn("bare", _words(F.col("folded")))
    own = _family(F.col("bare"), families)
    points = F.flatten(F.transform(C.all_of(F.col("folded"), POINTS), lambda v: F.split(v, C.LIST)))
    rows = rows.select("case_id", "at", "i", "part", _label(F.coalesce(own, F.col("default")), families).alias("label"), _values(F.col("bare"), ARTICLE).alias("a"), _values(F.col("bare"), CLAUSE).alias("c"), F.array_distinct(points).alias("p"))
    label, first, sole = F.col("label"), F.get("a", F.lit(0)), F.get("c", F.lit(0))
    n_a, n_c, n_p = (F.size(x) for x in "acp")
    unclear = (n_a == 0) | ((n_a > 1) & (n_c + n_p > 0)) | ((n_c > 1) & (n_p > 0))
    made = (
        F.when(unclear, F.array("part"))
        .when(n_a > 1, F.transform("a", lambda x: _cited(label, x)))
        .when(n_p > 0, F.transform("p", lambda x: _cited(label, first, sole, x)))
        .when(n_c > 0, F.transform("c", lambda x: _cited(label, first, x)))
        .otherwise(F.array(_cited(label, first)))
    )
    each = rows.select("case_id", "at", "i", F.posexplode(made).alias("j", "citation"))
    once = each.groupBy("case_id", "citation").agg(F.min(F.struct("at", "i", "j")).alias("first"))
    return once.select("case_id", (F.row_number().over(Window.partitionBy("case_id").orderBy("first")) - 1).alias("place"), "citation")


def in_scope(name: Column, allowed: list[str] | None) -> Column:
    """Whether a citation of a document (null: of none that is known) counts. Without a scope, all do."""
    return F.coalesce(name.isin(*allowed), F.lit(True)) if allowed else F.lit(True)


def scopes(cases: DataFrame, expected: DataFrame, families: list[Family], allowed: list[str] | None = None) -> DataFrame:
    """case_id, n_in, n_out, scope: no_gold_citation, in_scope, out_of_scope or mixed_scope, of cases (case_id) and expected (case_id, citation)."""
    inside = F.col("inside")
    n = expected.select("case_id", in_scope(family(F.col("citation"), families), allowed).alias("inside")).groupBy("case_id").agg(F.count_if(inside).alias("n_in"), F.count_if(~inside).alias("n_out"))
    both = cases.select("case_id").distinct().join(n, "case_id", "left").fillna(0, ["n_in", "n_out"])
    none_in, none_out = F.col("n_in") == 0, F.col("n_out") == 0
    return both.withColumn("scope", F.when(none_in & none_out, "no_gold_citation").when(none_out, "in_scope").when(none_in, "out_of_scope").otherwise("mixed_scope"))


def _described(rows: DataFrame, families: list[Family], documents: C.Documents) -> DataFrame:
    form = F.col("__form")
    cite = F.struct(form.alias("form"), _family(_words(form), families).alias("family"), C.parse_form(form, documents).alias("parts"))
    return rows.withColumn("__form", C.citation_form(F.col("citation"))).withColumn("cite", cite).drop("__form")


def covers(found: Column, expected: Column, mode: str = "containment") -> Column:
    """Whether a described citation covers another: never across documents; as text where the expected one names no parts."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    apart = F.coalesce(found["family"] != expected["family"], F.lit(False))
    a, b, parts = found["form"], expected["form"], expected["parts"]
    literal = (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    if mode == "literal":
        return ~apart & literal
    named = parts["document"].isNotNull() | parts["article"].isNotNull() | (F.size(parts["clauses"]) > 0) | (F.size(parts["points"]) > 0)
    return ~apart & F.when(named, C.contains(found["parts"], parts, broad=mode == "containment")).otherwise(literal)


def _verdict(n: Column, met: Column, seen: Column, none: str) -> Column:
    return F.when(n == 0, none).when(~seen, "no").when(met == n, "exact").when(met > 0, "partial").otherwise("no")


def scores(cases: DataFrame, expected: DataFrame, observed: DataFrame, families: list[Family], documents: C.Documents, *, allowed: list[str] | None = None, mode: str = "containment", k: int = 5) -> DataFrame:
    """case_id, n_expected (in scope), n_covered, citation_score, document_score (exact, partial, no or na), hit (whether one of the
    first k observed citations covers an expected one; null where a scope leaves none).

    cases: case_id; expected: case_id, citation; observed: case_id, rank (from 1), citation. The observed citations of a case, of which
    there are as many as an answer or a hit list has, lie beside each of its expected ones; the expected ones may be any number.
    """
    found = _described(observed, families, documents).groupBy("case_id").agg(F.collect_list(F.struct("rank", "cite")).alias("found"))
    wanted = _described(expected, families, documents).where(in_scope(F.col("cite.family"), allowed))
    both = wanted.join(found, "case_id", "left").withColumn("found", F.coalesce("found", F.array()))
    cite = F.col("cite")
    rows = both.select(
        "case_id", F.col("cite.family").alias("family"), (F.size("found") > 0).alias("seen"),
        F.filter("found", lambda o: covers(o["cite"], cite, mode)).alias("met"), F.exists("found", lambda o: F.coalesce(o["cite"]["family"] == cite["family"], F.lit(False))).alias("same"),
    )
    met = F.size("met") > 0
    n = rows.groupBy("case_id").agg(
        F.count("*").alias("n_expected"), F.count_if(met).alias("n_covered"), F.bool_or("seen").alias("seen"), F.bool_or(F.exists("met", lambda o: o["rank"] <= k)).alias("hit"),
        F.size(F.collect_set("family")).alias("n_families"), F.size(F.collect_set(F.when(F.col("same"), F.col("family")))).alias("n_same"),
    )
    all_cases = cases.select("case_id").distinct().join(n, "case_id", "left").fillna(0, ["n_expected", "n_covered", "n_families", "n_same"]).fillna(False, ["seen"])
    n_e = F.col("n_expected")
    return all_cases.select(
        "case_id", "n_expected", "n_covered", _verdict(n_e, F.col("n_covered"), F.col("seen"), "na" if allowed else "no").alias("citation_score"),
        _verdict(F.col("n_families"), F.col("n_same"), F.col("seen"), "na").alias("document_score"), F.when(n_e > 0, F.col("hit")).otherwise(F.lit(None if allowed else False).cast("boolean")).alias("hit"),
    )

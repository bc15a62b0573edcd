"""Citations of numbered texts: normal forms, parts, containment, scores, ids and sort keys, all as column functions.

A citation names a document, an article (dieu), clauses (khoan) and points (diem), alone or in lists, with or without accents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, unaccent

#: Patterns over normal forms, separators of lists, and the order of points' letters.
ARTICLE = r"\bdieu\s+(\d+[a-z]?)\b"
CLAUSES = r"\b(?:cac\s+)?khoan\s+(\d+(?:\s*(?:,|va)\s*\d+)*)"
POINTS = r"\b(?:cac\s+)?diem\s+([a-z](?:\.\d+)?(?:\s*(?:,|va)\s*[a-z](?:\.\d+)?)*)"
LIST = r"\s*(?:,|va)\s*"
HINTS = (("dieu", r"\bdieu\s+(\d+[a-z]?)"), ("khoan", r"\bkhoan\s+(\d+)"), ("diem", r"\bdiem\s+([a-z](?:\.\d+)?)"))
LETTERS = ("a", "b", "c", "d", "đ", "e", "g", "h", "i", "k", "l", "m", "n", "o", "p", "q", "r", "s", "t", "u", "v", "x", "y")
PLACEHOLDERS = ("[article]", "[clause]", "example.com", "replace the placeholder")
#: The name space of URL ids (RFC 4122), in hexadecimal.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"

#: Names of documents: a name and the pattern over normal forms that tells it.
Documents = list[tuple[str, str]]


def all_of(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def citation_form(c: Column) -> Column:
    """Folded, brackets and semicolons as spaces, no spaces around slashes, one after commas; null counts as empty."""
    c = F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"[;:()\[\]{}]", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"\s*/\s*", "/"), r"\s*,\s*", ", ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def letters_and_digits(c: Column, more: str = "") -> Column:
    """Folded, with everything but a-z, 0-9 and `more` as single spaces."""
    return F.trim(F.regexp_replace(fold(c), f"[^a-z0-9{more}]+", " "))


def surface(c: Column) -> Column:
    """letters_and_digits without what is in parentheses."""
    return letters_and_digits(F.regexp_replace(c, r"\([^)]*\)", " "))


def values(form: Column, pattern: str) -> Column:
    """Sorted distinct members of all lists that follow the pattern."""
    split = F.transform(all_of(form, pattern), lambda v: F.split(v, LIST))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.flatten(split), lambda x: F.regexp_replace(x, r"\s+", "")), lambda x: x != "")))


def only(found: Column) -> Column:
    """The member of an array of one; else null."""
    return F.get(F.transform(F.array(found), lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0)))), F.lit(0))


def parse(c: Column, documents: Documents) -> Column:
    """struct: document (the first whose pattern is met, or null), article (null unless all that are named are one), clauses, points."""
    return parse_form(citation_form(c), documents)


def parse_form(form: Column, documents: Documents) -> Column:
    """parse of a text's citation_form."""
    document = F.lit(None).cast("string")
    for name, pattern in reversed(documents):
        document = F.when(form.rlike(pattern), name).otherwise(document)
    return F.struct(document.alias("document"), only(F.array_distinct(all_of(form, ARTICLE))).alias("article"), values(form, CLAUSES).alias("clauses"), values(form, POINTS).alias("points"))


def contains(found: Column, expected: Column, *, broad: bool = True) -> Column:
    """Whether a parsed citation covers another one. With `broad`, one that names no clauses (points) covers all of them."""
    def part(name: str) -> Column:
        none = F.size(expected[name]) == 0
        inside = F.size(F.array_except(expected[name], found[name])) == 0
        return none | F.when(F.size(found[name]) > 0, inside).otherwise(F.lit(broad))

    says = expected["document"].isNotNull() | expected["article"].isNotNull() | (F.size(expected["clauses"]) > 0) | (F.size(expected["points"]) > 0)
    document = F.coalesce(expected["document"] == found["document"], F.lit(True))
    article = expected["article"].isNull() | F.coalesce(expected["article"] == found["article"], F.lit(False))
    return says & document & article & part("clauses") & part("points")


def literal_match(found: Column, expected: Column) -> Column:
    """Whether one normal form holds the other and neither is empty."""
    a, b = citation_form(found), citation_form(expected)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def correctness(expected: Column, observed: Column, *, scoped: bool = False) -> Column:
    """exact, partial or no: how many of an array of parsed citations are covered by any of another; na (no if not scoped) for none expected."""
    covered = F.size(F.filter(expected, lambda e: F.exists(observed, lambda o: contains(o, e))))
    return F.when(F.size(expected) == 0, "na" if scoped else "no").when(covered == F.size(expected), "exact").when(covered > 0, "partial").otherwise("no")


def _hints(folded: Column) -> Column:
    def named(name: str, pattern: str) -> Column:
        return F.transform(all_of(folded, pattern), lambda x: F.concat(F.lit(f"{name}_"), x))

    return F.concat(*[named(*hint) for hint in HINTS])


def hint_tokens(c: Column) -> Column:
    """dieu_n, then khoan_n, then diem_x for each that a text names, with repeats."""
    return _hints(fold(c))


def with_form(rows: DataFrame, c: str, name: str) -> DataFrame:
    """Adds a struct of what overlapping needs of a citation: folded, bare (its surface), n (hint tokens), tokens (each once). Each row is folded once."""
    folded, hints = F.col("__folded"), F.col("__hints")
    bare = F.trim(F.regexp_replace(F.regexp_replace(folded, r"\([^)]*\)", " "), "[^a-z0-9]+", " "))
    out = rows.withColumn("__folded", fold(F.col(c))).withColumn("__hints", _hints(folded))
    return out.withColumn(name, F.struct(folded.alias("folded"), bare.alias("bare"), F.size(hints).alias("n"), F.array_distinct(hints).alias("tokens"))).drop("__folded", "__hints")


def forms_overlap(allowed: Column, requested: Column) -> Column:
    """overlap of two structs of with_form."""
    a, b, c, d, t, u = allowed["folded"], requested["folded"], allowed["bare"], requested["bare"], allowed["tokens"], requested["tokens"]
    nested = F.contains(a, b) | F.contains(b, a) | ((c != "") & F.contains(d, c)) | ((d != "") & F.contains(c, d))
    agree = (F.size(t) == 0) | (F.size(u) == 0) | (F.size(F.array_except(t, u)) == 0) | (F.size(F.array_except(u, t)) == 0)
    return (a != "") & (b != "") & ((a == b) | ((c != "") & (c == d)) | (nested & agree))


def overlap(allowed: Column, requested: Column) -> Column:
    """Whether two citations are the same, or one holds the other (as folded or as bare words) without naming other parts."""
    forms = [F.struct(fold(c).alias("folded"), surface(c).alias("bare"), F.array_distinct(hint_tokens(c)).alias("tokens")) for c in (allowed, requested)]
    return forms_overlap(*forms)


def article_numbers(c: Column) -> Column:
    """The articles that a text names, each once, in order."""
    return F.array_distinct(all_of(fold(c), HINTS[0][1]))


def families(c: Column, signatures: list[tuple[str, list[str]]]) -> Column:
    """The names whose signatures (any of them) a text's bare words hold, in the order given."""
    return families_of(letters_and_digits(c), signatures)


def families_of(words: Column, signatures: list[tuple[str, list[str]]]) -> Column:
    """families of a text's bare words."""
    def found(words: Column) -> Column:
        # A lambda's variable: the words are made once, however many signatures there are.
        held = [F.when(reduce(Column.__or__, [F.contains(words, F.lit(x)) for x in own], F.lit(False)), name) for name, own in signatures]
        return F.filter(F.array(*held), lambda x: x.isNotNull())

    return F.get(F.transform(F.array(words), lambda words: found(words)), F.lit(0))


def id_token(c: Column) -> Column:
    """Letters (case kept, no accents) and digits, all else as single underscores."""
    return F.regexp_replace(F.regexp_replace(unaccent(F.trim(c)), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def point_token(c: Column) -> Column:
    """id_token of a point's letters, in which a stroked d is dd and dots go."""
    return id_token(F.replace(F.replace(F.replace(c, F.lit("đ"), F.lit("dd")), F.lit("Đ"), F.lit("DD")), F.lit("."), F.lit("")))


def metadata_token(prefix: str, c: Column) -> Column:
    """prefix_value, folded, other signs than a-z, 0-9, _ and . as underscores; null if nothing is left."""
    own = F.regexp_replace(F.regexp_replace(F.replace(fold(c), F.lit(" "), F.lit("_")), "[^a-z0-9_.]+", "_"), "^_+|_+$", "")
    return F.when(own != "", F.concat(F.lit(f"{prefix}_"), own))


def reference_token(prefix: str, c: Column) -> Column:
    """prefix_value in lower case without white space; null for null and empty."""
    return F.when(c != "", F.concat(F.lit(f"{prefix}_"), F.regexp_replace(F.lower(F.trim(c)), r"\s+", "")))


def point_key(c: Column) -> Column:
    """A struct that sorts points by their letter's place in the alphabet, then by their numbers; points without a letter come last."""
    parts = F.split(F.lower(F.trim(c)), r"\.")
    place = F.array_position(F.array(*map(F.lit, LETTERS)), parts[0])
    known = F.when(place > 0, place - 1).otherwise(1000 + F.ascii(parts[0]))
    suffix = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.struct(F.when(x.rlike(r"^\d+$"), 0).otherwise(1).alias("kind"), F.coalesce(x.try_cast("int"), F.lit(0)).alias("number"), x.alias("text")))
    return F.struct(F.when(F.coalesce(c, F.lit("")) == "", 10_000).otherwise(known).cast("int").alias("letter"), suffix.alias("suffix"), F.lower(F.trim(c)).alias("point"))


def level(clause: Column, point: Column) -> Column:
    return F.when(F.coalesce(point, F.lit("")) != "", "point").when(F.coalesce(clause, F.lit("")) != "", "clause").otherwise("article")


def chunk_id(prefix: Column, article: Column, clause: Column, points: Column) -> Column:
    """PREFIX_Dieu_n_Khoan_m_Diem_x_y; parts that are null or empty are left out."""
    own = F.transform(F.filter(F.coalesce(points, F.array().cast("array<string>")), lambda x: x != ""), point_token)
    return F.concat_ws("_", prefix, F.lit("Dieu"), id_token(article), F.when(clause != "", F.concat(F.lit("Khoan_"), id_token(clause))), F.when(F.size(own) > 0, F.concat(F.lit("Diem_"), F.array_join(own, "_"))))


def citation_text(title: Column, article: Column, clause: Column, points: Column) -> Column:
    """Title, then article, clause and points as they are cited."""
    label = F.when(F.size(points) == 1, F.concat(F.lit("điểm "), points[0])).when(F.size(points) > 1, F.concat(F.lit("các điểm "), F.array_join(points, ", ")))
    return F.concat_ws(", ", title, F.when(article != "", F.concat(F.lit("Điều "), article)), F.when(clause != "", F.concat(F.lit("khoản "), clause)), label)


def node_id(document: Column, article: Column, clause: Column, point: Column) -> Column:
    """The graph id of the smallest part that is named: document:, article:, clause: or point:, parts with their kind before them once."""
    def part(kind: str, c: Column) -> Column:
        return F.when(F.startswith(F.trim(c), F.lit(f"{kind}-")), F.trim(c)).otherwise(F.concat(F.lit(f"{kind}-"), F.trim(c)))

    a, b, c = part("dieu", article), part("khoan", clause), part("diem", point)
    named = [F.coalesce(x, F.lit("")) != "" for x in (article, clause, point)]
    return (
        F.when(named[0] & named[1] & named[2], F.concat(F.lit("point:"), F.concat_ws(":", document, a, b, c)))
        .when(named[0] & named[1], F.concat(F.lit("clause:"), F.concat_ws(":", document, a, b)))
        .when(named[0], F.concat(F.lit("article:"), F.concat_ws(":", document, a)))
        .otherwise(F.concat(F.lit("document:"), document))
    )


def url_uuid(c: Column) -> Column:
    """The version 5 UUID of a text in the name space of URLs."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), F.encode(c, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def placeholder(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = F.lit(False)
    for p in PLACEHOLDERS:
        out = out | F.contains(low, F.lit(p))
    return out


def cut_at_spaces(c: Column, most: int) -> Column:
    """Pieces of at most `most` characters that end before white space; a longer word is a piece of its own."""
    pieces = F.regexp_extract_all(c, F.lit(rf"(?s)\S.{{0,{most - 2}}}\S(?:\s|\z)|\S(?:\s|\z)|\S+"), F.lit(0))
    return F.transform(pieces, lambda x: F.regexp_replace(x, r"\s+\z", ""))

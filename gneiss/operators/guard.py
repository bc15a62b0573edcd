"""Answers held against the contexts that they were given: canonical citations, and verdicts, for many answers at once.

Citations meet the contexts' citations of the same answer only, so a join compares at most requests * contexts of one answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from .citations import HINTS, all_of, article_numbers, forms_overlap, surface, with_form


def _told(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def _matched(requests: DataFrame, allowed: DataFrame, *more: str) -> DataFrame:
    """answer, place, citation, copies (how often it is asked so), more, canonical, and cited: the least rank, if allowed has one, of the
    allowed citations that read the same. requests: a row for each answer, place, citation and more, with copies and form.

    Citations are folded before they meet, and rows of an answer stay together, so nothing is dealt out again.
    """
    ranks = "rank" in allowed.columns
    own = with_form(allowed.select("answer", "index", F.col("citation").alias("meant"), F.col("rank") if ranks else F.lit(None).cast("int").alias("rank"), _told("citation").alias("told")), "meant", "own")
    asked = requests.withColumnRenamed("answer", "asked").withColumn("asks", _told("citation"))
    mine, other = F.col("form"), F.col("own")
    means = F.col("asks") & F.col("told")
    met = (F.col("citation") == F.col("meant")) | (means & ((mine["folded"] == other["folded"]) | forms_overlap(other, mine)))
    pairs = asked.join(own, (F.col("asked") == F.col("answer")) & met, "left")
    same = mine["folded"] == other["folded"]
    apart, longer = F.abs(other["n"] - mine["n"]), F.abs(F.length(other["folded"]) - F.length(mine["folded"]))
    best = F.when(means & same, F.struct(F.lit(0).alias("fuzzy"), F.lit(0).alias("apart"), F.lit(0).alias("longer"), "index", "meant")).when(means, F.struct(F.lit(1).alias("fuzzy"), apart.alias("apart"), longer.alias("longer"), "index", "meant"))
    one = pairs.groupBy(F.col("asked").alias("answer"), "place", "citation", "copies", *more).agg(F.min(best).alias("best"), F.min(F.when(F.col("citation") == F.col("meant"), F.col("rank"))).alias("cited"))
    # Requests at one place of an answer mean the same; null is no place.
    canonical = F.when(F.col("place").isNotNull(), F.min("best").over(Window.partitionBy("answer", "place"))["meant"])
    return one.select("answer", "place", "citation", "copies", *more, canonical.alias("canonical"), "cited")


def _once(requests: DataFrame) -> DataFrame:
    return with_form(requests.groupBy("answer", "place", "citation").agg(F.count("*").alias("copies")), "citation", "form")


def canonical_citations(requests: DataFrame, allowed: DataFrame) -> DataFrame:
    """answer, place, citation, canonical: the allowed citation (answer, index, citation) that each request (answer, place, citation) means.

    One that is the same in folded form comes first, by index; then of those that overlap the one with the closest number of named
    parts, then of length, then the first. Null if none does. Blank and null citations mean nothing and are meant by none.
    """
    found = _matched(_once(requests), allowed)
    return found.select("answer", "place", "citation", "canonical", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def legal_basis(canonical: DataFrame) -> DataFrame:
    """answer, basis: each canonical citation of an answer once, in the order of its first request."""
    first = canonical.where("canonical is not null").groupBy("answer", "canonical").agg(F.min("place").alias("at"))
    return first.groupBy("answer").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "canonical"))), lambda x: x["canonical"]).alias("basis"))


def mentions(answer: Column, citation: Column) -> Column:
    """Whether an answer holds a citation, as folded or as bare words."""
    return ((fold(citation) != "") & F.contains(fold(answer), fold(citation))) | ((surface(citation) != "") & F.contains(surface(answer), surface(citation)))


def validate_answers(answers: DataFrame, requests: DataFrame, contexts: DataFrame, hints: list[str]) -> DataFrame:
    """answer and its verdicts: has_citation, citations_allowed, n_unretrieved, unsupported_articles, keeps_rank, says_insufficient, passed.

    answers: answer, text, insufficient; requests: answer, place, citation (the answer's basis); contexts: answer, index, citation,
    article, rank (1 the highest, or null). An answer with contexts, unless it says that they do not suffice, must mention a citation of its
    basis; all of the basis must be allowed; articles that it or its basis names must be in the contexts; it may not leave a higher text
    unnamed; one that is insufficient must say so, by a hint. An answer without requests or contexts is judged by what is left.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(fold(F.col("text")), r"\([^)]*\)", " "), "[^a-z0-9]+", " "))
    texts = answers.select("answer", fold(F.col("text")).alias("folded"), bare.alias("bare")).groupBy("answer").agg(F.collect_list(F.struct("folded", "bare")).alias("texts"))
    form = F.col("form")
    held = lambda t, name: (form[name] != "") & F.contains(t[name], form[name])
    named = F.exists("texts", lambda t: held(t, "folded") | held(t, "bare"))
    articles_of = F.array_distinct(all_of(form["folded"], HINTS[0][1]))
    asked = _once(requests).join(texts, "answer").withColumns({"said": named, "articles": articles_of}).drop("texts")
    basis = _matched(asked, contexts, "said", "articles").groupBy("answer").agg(
        F.max("said").alias("said"), F.array_distinct(F.flatten(F.collect_list("articles"))).alias("basis_articles"),
        F.sum(F.when(F.col("canonical").isNull(), F.col("copies")).otherwise(0)).alias("n_unretrieved"), F.min("cited").alias("cited"),
    )
    known = contexts.groupBy("answer").agg(F.count("*").alias("n_contexts"), F.min("rank").alias("highest"), F.array_distinct(F.flatten(F.collect_list(F.concat(F.array_compact(F.array("article")), F.coalesce(article_numbers(F.col("citation")), F.array().cast("array<string>")))))).alias("articles"))
    out = answers
    for part in (basis, known):
        out = out.join(part, "answer", "left")
    none = F.array().cast("array<string>")
    text = F.coalesce("text", F.lit(""))
    articles = F.array_except(F.array_union(article_numbers(text), F.coalesce("basis_articles", none)), F.coalesce("articles", none))
    ordered = F.transform(F.array_sort(F.transform(articles, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), lambda x: x["x"])
    insufficient = F.coalesce("insufficient", F.lit(False))
    said = F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(fold(text), h))
    out = out.select(
        "answer", ((F.coalesce("n_contexts", F.lit(0)) == 0) | insufficient | F.coalesce("said", F.lit(False))).alias("has_citation"), F.coalesce("n_unretrieved", F.lit(0)).alias("n_unretrieved"), ordered.alias("unsupported_articles"),
        (~F.coalesce(F.col("cited") > F.col("highest"), F.lit(False))).alias("keeps_rank"), (~insufficient | said).alias("says_insufficient"),
    ).withColumn("citations_allowed", F.col("n_unretrieved") == 0)
    return out.withColumn("passed", F.col("has_citation") & F.col("citations_allowed") & (F.size("unsupported_articles") == 0) & F.col("keeps_rank") & F.col("says_insufficient"))

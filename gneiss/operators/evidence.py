"""Evidence for answers: how well contexts meet a question, which of them are cited, and the sentence that is quoted.

All run over many questions at once. Questions are a few words long; contexts are joined to their own question only, and what is
gathered for one question is bounded by the number of citations asked for, not by its number of contexts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, fold

#: How many contexts of each rank are taken first.
RANK_QUOTAS = {1: 3, 2: 2, 3: 2}


def terms(question: Column, stop: list[str]) -> Column:
    """Distinct folded words of a question of three letters or more, in order, without numbers and stop words; null has none."""
    words = F.split(fold(F.coalesce(question, F.lit(""))), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\d+$") & ~w.isin(stop)))


def phrases(found: Column) -> Column:
    """Distinct runs of four, three and two neighbouring terms of at least eight characters, longest runs first."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i, n), " "))

    return F.array_distinct(F.filter(F.concat(runs(4), runs(3), runs(2)), lambda p: F.length(p) >= 8))


def relevance(questions: DataFrame, contexts: DataFrame, stop: list[str], opposed: tuple[str, str] | None = None) -> DataFrame:
    """contexts and relevance, for each question that has contexts.

    questions: question_id, question. contexts: question_id, place, citation, body, score, rank (1 highest, or null). A phrase of
    the question counts 8 in the citation, else 4 in citation and body; a term 2.5, else 1; then the score, held between 0 and 1,
    and 0.05 for each rank above the fourth. `opposed`: two folded names of parties. A question on the second, or on the first alone, puts
    a context 30 down whose citation names the other party only. Null texts hold nothing, a null score or rank counts 0.
    """
    words = terms(F.col("question"), stop)
    asked = questions.select("question_id", fold(F.coalesce("question", F.lit(""))).alias("_q"), words.alias("_terms")).withColumn("_phrases", phrases(F.col("_terms")))
    head = fold(F.coalesce("citation", F.lit("")))
    both = fold(F.concat_ws(" ", "citation", "body"))
    joined = contexts.join(asked, "question_id").withColumn("_head", head).withColumn("_both", both)

    def met(parts: str, high: float, low: float) -> Column:
        each = F.transform(parts, lambda p: F.when(F.contains(F.col("_head"), p), high).when(F.contains(F.col("_both"), p), low).otherwise(0.0))
        return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)

    total = met("_phrases", 8.0, 4.0) + met("_terms", 2.5, 1.0)
    total = total + F.least(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) + F.greatest(4 - F.coalesce("rank", F.lit(0)), F.lit(0)) * 0.05
    if opposed:
        first, second = opposed
        on_first = F.contains("_q", F.lit(first)) & ~F.contains("_q", F.lit(second))
        only = [F.contains("_head", F.lit(a)) & ~F.contains("_head", F.lit(b)) for a, b in (opposed, opposed[::-1])]
        total = total - F.when((on_first & only[1]) | (F.contains("_q", F.lit(second)) & only[0]), 30.0).otherwise(0.0)
    return joined.select(*contexts.columns, F.round(total, 6).alias("relevance"))


def relevant(scored: DataFrame) -> DataFrame:
    """Contexts whose relevance is 8 or more and 0.6 of their question's best; all of them if the best is 0 or less; the first if none is left."""
    w = Window.partitionBy("question_id")
    best = scored.withColumn("_best", F.max("relevance").over(w)).withColumn("_first", F.min("place").over(w))
    keep = (F.col("_best") <= 0) | (F.col("relevance") >= F.greatest(F.lit(8.0), F.col("_best") * 0.6))
    some = best.withColumn("_keep", keep).withColumn("_some", F.max(keep.cast("int")).over(w))
    return some.where(F.col("_keep") | ((F.col("_some") == 0) & (F.col("place") == F.col("_first")))).select(*scored.columns)


def by_relevance(scored: DataFrame) -> DataFrame:
    """place becomes the place from 0 by falling relevance, ties by the old place."""
    w = Window.partitionBy("question_id").orderBy(F.desc("relevance"), "place")
    return scored.withColumn("place", F.row_number().over(w) - 1)


def selected(contexts: DataFrame, most: int, quotas: dict[int, int] = RANK_QUOTAS) -> DataFrame:
    """contexts that are cited, with cited_at (from 0): by rank within its quota, each article once, then all others by place.

    contexts: question_id, place (distinct within a question), document, article (null: the context's own chunk_id), chunk_id, rank.
    At most `most` for a question. Of one rank, the first 2 * most contexts with distinct articles decide: at most `most` of them can be
    taken as articles of another rank. So a fold over (ranks + 1) * 2 * most rows is all that a question gathers.
    """
    key = F.struct(F.coalesce("document", F.lit("")).alias("document"), F.coalesce("article", F.col("chunk_id")).alias("article"))
    group = F.when(F.col("rank").isin(*quotas), F.col("rank")).otherwise(F.lit(None)).cast("int")
    keyed = contexts.select("question_id", "place", key.alias("key"), group.alias("group"))
    once = keyed.groupBy("question_id", "group", "key").agg(F.min("place").alias("place"))
    near = once.withColumn("n", F.row_number().over(Window.partitionBy("question_id", "group").orderBy("place"))).where(F.col("n") <= 2 * most)
    gathered = near.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", "group", "key"))).alias("all"))

    def quota(x: Column) -> Column:
        out = F.lit(0)
        for rank, n in quotas.items():
            out = F.when(x["group"] == rank, n).otherwise(out)
        return out

    def take(kept: Column, x: Column) -> Column:
        fresh = (F.size(kept) < most) & ~F.exists(kept, lambda k: k["key"] == x["key"])
        return F.when(fresh, F.array_append(kept, x)).otherwise(kept)

    def take_ranked(kept: Column, x: Column) -> Column:
        room = F.size(F.filter(kept, lambda k: k["group"] == x["group"])) < quota(x)
        return F.when(room, take(kept, x)).otherwise(kept)

    none = F.array().cast(gathered.schema["all"].dataType)
    by_rank = F.array_sort(F.transform(F.filter("all", lambda x: x["group"].isNotNull()), lambda x: F.struct(x["group"].alias("group"), x["place"].alias("place"), x.alias("x"))))
    ranked = F.aggregate(F.transform(by_rank, lambda x: x["x"]), none, take_ranked)
    cited = gathered.withColumn("ranked", ranked).select("question_id", F.aggregate("all", F.col("ranked"), take).alias("cited"))
    places = cited.select("question_id", F.posexplode(F.transform("cited", lambda x: x["place"])).alias("cited_at", "place"))
    return contexts.join(places, ["question_id", "place"])


def best_sentence(text: Column, wanted: Column, ends: str, most: int = 500) -> Column:
    """The first sentence (parts between matches of `ends`) that holds the first three wanted terms, else any, else the first; null if there is none.

    At most `most` characters of it. Terms are folded; of no terms nothing is held.
    """
    sentences = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ends), collapse), lambda s: s != "")
    first = F.slice(wanted, 1, 3)
    grades = F.transform(
        sentences,
        lambda s: F.struct(
            F.when((F.size(wanted) > 0) & F.forall(first, lambda t: F.contains(fold(s), t)), 0).when(F.exists(wanted, lambda t: F.contains(fold(s), t)), 1).otherwise(2).alias("grade"),
        )["grade"],
    )
    at = F.array_position(grades, F.array_min(grades))
    return F.when(F.size(sentences) > 0, F.substring(F.get(sentences, (at - 1).cast("int")), 1, most))

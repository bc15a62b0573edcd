"""From questions to ranked hits: search by variants, hits for articles that rules ask for, expansion along the graph, one list that
says where each hit comes from, boosts, and coverage of comparisons. All steps work on many questions at once.

A hit is a row of HIT: what its lists say of it is kept beside its score (sources, seeds, nodes, kinds of edges), and lists are merged
by grouping, so a hit that several lists have costs one exchange. A question has as many hits as the limits of its lists add up to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle
from . import rules, sparse
from .expansion import expand_from_chunks

HIT = ["query", "place", "chunk", "score", "source", "vector_score", "graph_score", "seeds", "nodes", "kinds"]
ARRAYS = ("seeds", "nodes", "kinds")


def as_hits(rows: DataFrame, source: str, **given: Column) -> DataFrame:
    """Rows of HIT from query, place, chunk and score: a hit's score is its list's score too, and arrays that are not given are empty."""
    own = {"vector_score": F.col("score") if source == "vector" else F.lit(0.0), "graph_score": F.col("score") if source == "graph" else F.lit(0.0)}
    none = dict.fromkeys(ARRAYS, F.array().cast("array<string>"))
    made = {**own, **none, **given, "source": F.lit(source)}
    return rows.select("query", F.col("place").cast("int").alias("place"), "chunk", "score", *[made[c].alias(c) for c in HIT[4:]])


def _union(name: str) -> Column:
    """The members of the arrays of one hit, once each, in the order of its lists."""
    return F.array_distinct(F.filter(F.flatten(F.transform("rows", lambda r: F.coalesce(r[name], F.array()))), lambda x: F.coalesce(x, F.lit("")) != ""))


def merged(*lists: DataFrame) -> DataFrame:
    """One row of HIT for each query and chunk of lists of HIT: the largest of each score, arrays united in the order of lists and
    places, hybrid where both a vector and a graph list have it; place counts from 1 in the order in which chunks are first met.

    Of rows that are null in query or chunk nothing stays; null scores count as 0. Arrays of one hit come together, not those of a query.
    """
    rows = None
    for i, hits in enumerate(lists):
        own = hits.where("query is not null and chunk is not null").select(*HIT, F.lit(i).alias("list"))
        rows = own if rows is None else rows.unionByName(own)
    at = F.struct("list", "place")
    sources = F.collect_set("source")
    united = rows.groupBy("query", "chunk").agg(
        F.min(at).alias("at"), *[F.max(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("score", "vector_score", "graph_score")], sources.alias("sources"),
        F.array_sort(F.collect_list(F.struct("list", "place", "source", *ARRAYS))).alias("rows"),
    )
    is_graph, is_vector = F.array_contains("sources", "graph"), F.arrays_overlap("sources", F.array(F.lit("vector"), F.lit("hybrid")))
    first = F.get(F.filter(F.transform("rows", lambda r: r["source"]), lambda s: F.coalesce(s, F.lit("")) != ""), F.lit(0))
    source = F.when(is_graph & is_vector, "hybrid").otherwise(F.coalesce(first, F.lit("vector")))
    out = united.select("query", "chunk", "at", "score", source.alias("source"), "vector_score", "graph_score", *[_union(c).alias(c) for c in ARRAYS])
    return out.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("at", "chunk"))).select(*HIT)


def route(questions: DataFrame, tests: DataFrame, results: DataFrame) -> DataFrame:
    """query, kind, value, n (from 0 in each kind): what the rules that a question's text meets bring, each value once, in order."""
    texts = questions.select(F.col("query").alias("subject"), F.lit("query").alias("field"), "text")
    facts = texts.select("subject", "field", F.lit(None).cast("string").alias("value"))
    brought = rules.outcomes(rules.matches(tests, facts, texts), results)
    return brought.select(F.col("subject").alias("query"), "kind", F.posexplode("values").alias("n", "value"))


def variants(questions: DataFrame, routed: DataFrame) -> DataFrame:
    """query, variant, text: each question, and once more with the terms that rules bring to it."""
    terms = routed.where("kind = 'term'").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("t"))
    more = questions.join(terms, "query").select("query", F.lit(1).alias("variant"), F.concat_ws(" ", "text", F.array_join(F.transform("t", lambda x: x["value"]), " ")).alias("text"))
    return questions.select("query", F.lit(0).alias("variant"), "text").unionByName(more)


def searched(asked: DataFrame, chunks: DataFrame, prefetch: int, constant: int = 60) -> DataFrame:
    """Rows of HIT: the lists of a question's variants, each of at most `prefetch` hits, fused by reciprocal ranks."""
    found = sparse.top_k(chunks, asked.select(F.struct("query", "variant").alias("ask"), "text"), "chunk", "ask", prefetch)
    fused = found.groupBy(F.col("ask.query").alias("query"), "chunk").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 8).alias("score"))
    placed = fused.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "chunk"))).where(F.col("place") <= prefetch)
    return as_hits(placed, "vector")


def asked_articles(hits: DataFrame, routed: DataFrame, chunks: DataFrame, *, first: int = 4, others: int = 2, most: int = 4) -> DataFrame:
    """Rows of HIT: the first chunks of each article that rules bring to a question and none of its hits is of, just below its best hit.

    A question with more than `most` such articles gets none. The articles' chunks are cut to `first` before they meet the questions.
    """
    wanted = routed.where("kind = 'article'").select("query", F.col("value").alias("article"), "n")
    few = wanted.groupBy("query").agg(F.count("*").alias("n_wanted")).where(F.col("n_wanted") <= most).select("query")
    have = hits.join(chunks.select("chunk", "article"), "chunk").select("query", "article").distinct()
    missing = wanted.join(few, "query", "left_semi").join(have, ["query", "article"], "left_anti")
    missing = missing.withColumn("turn", F.row_number().over(Window.partitionBy("query").orderBy("n")))
    ahead = chunks.join(missing.select("article").distinct(), "article", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("article").orderBy("chunk"))).where(F.col("k") <= max(first, others))
    rows = missing.join(ahead.select("article", "chunk", "k"), "article").where(F.col("k") <= F.when(F.col("turn") == 1, first).otherwise(others))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("turn", "k")))
    best = hits.groupBy("query").agg(F.max("score").alias("best"))
    score = F.round(F.greatest(F.coalesce("best", F.lit(0.0)) - 1e-3, F.lit(0.0)) - (F.col("place") - 1) * 1e-4, 8)
    return as_hits(rows.join(best, "query", "left").withColumn("score", score), "vector")


def expanded(hits: DataFrame, edges: DataFrame, *, limit: int, weight: float, max_seeds: int, confidence: float, depth: int) -> DataFrame:
    """Rows of HIT: what the graph leads to from a question's first hits, with the path, at `weight` times its strength."""
    found = expand_from_chunks(hits.select("query", "place", F.col("chunk").alias("seed")), edges, limit=limit, confidence=confidence, depth=depth, max_seeds=max_seeds)
    rows = found.withColumnRenamed("rank", "place").withColumn("score", F.round(F.round("strength", 6) * weight, 8))
    return as_hits(rows, "graph", seeds=F.array(F.get("nodes", F.lit(0))), nodes=F.col("nodes"), kinds=F.col("kinds"))


def ranked(hits: DataFrame, boost: Column) -> DataFrame:
    """Adds base (the score before) and rank: by the boosted score, then the score before, then the chunk."""
    out = hits.withColumn("base", F.col("score")).withColumn("score", F.round(F.col("score") + boost, 8))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc("base"), "chunk")))


def covered(hits: DataFrame, applies: DataFrame, required: DataFrame, step: float = 1e-3) -> DataFrame:
    """hits with promoted (the plan that moved a hit up, or null), and score and rank after it.

    hits: query, chunk, document, article, score, rank and any others; applies: query, plan; required: plan, turn (order of plans),
    place, document, article, lift. Of each required article the first hit goes to the top, in the order of places, if at least two are found: at
    the top score plus lift less `step` for each place. Plans apply one after the other in the order of turns, a later one above an earlier.
    """
    once = required.groupBy("plan", "document", "article").agg(F.min("turn").alias("turn"), F.min("place").alias("need"), F.max("lift").alias("lift"))
    found = hits.join(applies.select("query", "plan").distinct(), "query").join(once, ["plan", "document", "article"])
    best = found.groupBy("query", "plan", "turn", "need", "document", "article").agg(F.min_by("chunk", "rank").alias("chunk"), F.max("lift").alias("lift"))
    of_plan = Window.partitionBy("query", "plan")
    best = best.withColumn("n", F.count("*").over(of_plan)).where("n >= 2").withColumn("k", F.row_number().over(of_plan.orderBy("need", "document", "article")) - 1)
    # A plan lifts the top by its lift; its first place counts it, so the lifts of all plans up to one are the sum over first places.
    best = best.withColumn("order", F.struct("turn", "plan"))
    upto = Window.partitionBy("query").orderBy("order").rangeBetween(Window.unboundedPreceding, 0)
    best = best.withColumn("lifted", F.sum(F.when(F.col("k") == 0, F.col("lift"))).over(upto))
    last = best.groupBy("query", "chunk").agg(F.max_by(F.struct("plan", "turn", "k", "lifted"), "order").alias("p"))
    top = hits.groupBy("query").agg(F.max("score").alias("top"))
    out = hits.join(last, ["query", "chunk"], "left").join(top, "query")
    moved = F.col("p").isNotNull()
    out = out.withColumn("score", F.when(moved, F.round(F.col("top") + F.col("p.lifted") - step * F.col("p.k"), 8)).otherwise(F.col("score")))
    order = Window.partitionBy("query").orderBy((~moved).cast("int"), F.desc("p.turn"), F.desc("p.plan"), "p.k", "rank")
    return out.withColumn("rank", F.row_number().over(order)).withColumn("promoted", F.col("p.plan")).drop("p", "top")


def retrieve(questions: DataFrame, chunks: DataFrame, edges: DataFrame, tests: DataFrame, results: DataFrame, required: DataFrame, *, k: int = 8, prefetch: int = 24, graph_limit: int = 8, graph_weight: float = 0.2, max_seeds: int = 3, confidence: float = 0.6, depth: int = 4, article_boost: float = 0.002) -> DataFrame:
    """The k best hits of each question: rows of HIT without place, with rank, document, article and promoted.

    questions: query (string), text; chunks: chunk (a node of the graph), text, document, article; edges as in expansion; tests
    and results as in rules, where results bring terms, articles and plans; required as in covered. Questions without hits have no rows.
    """
    routed = settle(route(questions, tests, results), "routed")
    hits = settle(searched(variants(questions, routed), chunks, prefetch), "searched")
    about = chunks.select("chunk", "document", "article")
    hits = settle(merged(hits, asked_articles(hits, routed, about)), "hits")
    graph = expanded(hits, edges, limit=graph_limit, weight=graph_weight, max_seeds=max_seeds, confidence=confidence, depth=depth)
    both = merged(hits, graph).join(about, "chunk")
    wanted = routed.where("kind = 'article'").select("query", F.col("value").alias("article"), F.lit(True).alias("wanted"))
    both = ranked(both.join(wanted, ["query", "article"], "left"), F.when(F.col("wanted"), article_boost).otherwise(0.0))
    plans = routed.where("kind = 'plan'").select("query", F.col("value").alias("plan"))
    return covered(settle(both.drop("wanted"), "ranked"), plans, required).where(F.col("rank") <= k).drop("place", "base")

"""Expansion from the chunks that a query has found to others, along path patterns, with a limit for each pattern.

Paths are not grown from the seeds: behind a frequent topic there are as many as chunks have it, for every seed. They are built from
their ends. Each node keeps its best suffixes only, of which a query can lose no more than those that end in its own seeds; so what is
kept is enough for every query's best, exactly, and a node never holds more than a fixed number. Windows with a limit prune before
they shuffle, so a node with very many edges costs no task more than others. Only nodes that seeds can reach take part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle
from .graph import strength


@dataclass(frozen=True)
class Hop:
    """One edge of a pattern: its kinds, and whether it is followed forwards, backwards or either way."""

    kinds: tuple[str, ...]
    way: str = "out"


#: Kinds of edges, and the patterns from chunk to chunk, in the order in which they are looked at.
REFERENCES = ("REFERENCES", "DETAILS", "GUIDED_BY", "GUIDES", "SUPERIOR_TO", "SUBORDINATE_TO", "MUST_COMPLY_WITH", "IMPLEMENTS")
TAXONOMY = ("MENTIONS_TOPIC", "APPLIES_TO_ACTOR", "HAS_ISSUE_TYPE")
PATTERNS = (
    (Hop(("SOURCE_OF",)), Hop(("HAS_SOURCE_CHUNK",))),
    (Hop(TAXONOMY), Hop(TAXONOMY, "in")),
    (Hop(("SOURCE_OF",)), Hop(REFERENCES, "both"), Hop(("HAS_SOURCE_CHUNK",))),
    (Hop(("SOURCE_OF",)), Hop(TAXONOMY), Hop(TAXONOMY, "in"), Hop(("HAS_SOURCE_CHUNK",))),
)


def _turned(edges: DataFrame, hop: Hop, confidence: float) -> DataFrame:
    """v, u, kind, c, edge: the edges that the hop may follow, from v to u. edge tells relations apart, whichever way they are followed."""
    c = F.coalesce("confidence", F.lit(1.0))
    used = edges.where(F.col("kind").isin(*hop.kinds) & (c >= confidence))
    edge = F.struct("src", "dst", "kind").alias("edge")
    out = used.select(F.col("src").alias("v"), F.col("dst").alias("u"), "kind", c.alias("c"), edge)
    back = used.select(F.col("dst").alias("v"), F.col("src").alias("u"), "kind", c.alias("c"), edge)
    return {"out": out, "in": back, "both": out.unionByName(back)}[hop.way]


def _order(conf: str = "conf") -> list[Column]:
    return [F.round(conf, 9).desc(), F.col("end"), F.array_join("nodes", ">")]


def _best_suffixes(paths: DataFrame, paths_kept: int, ends_kept: int) -> DataFrame:
    """Of each node v, the best paths to its best ends."""
    by_end = Window.partitionBy("v", "end").orderBy(*_order())
    of_end = paths.withColumn("__n", F.row_number().over(by_end)).where(F.col("__n") <= paths_kept).withColumn("__best", F.max(F.round("conf", 9)).over(Window.partitionBy("v", "end")))
    ranked = of_end.withColumn("__rank", F.dense_rank().over(Window.partitionBy("v").orderBy(F.desc("__best"), "end")))
    return ranked.where(F.col("__rank") <= ends_kept).drop("__n", "__best", "__rank")


def suffixes(seeds: DataFrame, edges: DataFrame, hops: tuple[Hop, ...], *, confidence: float, paths_kept: int, ends_kept: int, is_end: Column, known: dict[tuple[Hop, ...], DataFrame] | None = None) -> DataFrame:
    """v, end, kinds, nodes, confs, conf: of each seed (column seed), its `paths_kept` best paths to each of its `ends_kept` best ends (a
    column over end) along the hops.

    No relation comes twice in a path; nodes may. What a node keeps must do for every path that comes to it, and one that comes over a
    relation loses the suffixes that begin with it. So where a hop may go back over the one before, a node keeps as many more as one
    relation can take away: those that the next node keeps. Hops that are further apart may not have kinds in common. known: the edges
    that the beginnings of other patterns have reached from the same seeds, which this adds to.
    """
    together = [set(a.kinds) & set(b.kinds) for a, b in zip(hops, hops[1:], strict=False)]
    if any(set(hops[i].kinds) & set(h.kinds) for i in range(len(hops)) for h in hops[i + 2 :]):
        raise ValueError("hops that are not adjacent have kinds in common")
    reached, by_hop = seeds.select(F.col("seed").alias("v")).distinct(), []
    known = {} if known is None else known
    for j, hop in enumerate(hops):
        # Read again by the next hop and on the way back, and by the patterns that begin alike.
        if hops[: j + 1] not in known:
            known[hops[: j + 1]] = settle(_turned(edges, hop, confidence).join(reached, "v", "left_semi"), "hop")
        by_hop.append(known[hops[: j + 1]])
        reached = by_hop[-1].select(F.col("u").alias("v")).distinct()
    found, ends, paths = None, 1, 1
    for j, hop_edges in reversed(list(enumerate(by_hop))):
        if found is None:
            found = hop_edges.select("v", F.col("u").alias("end"), F.array("kind").alias("kinds"), F.array("v", "u").alias("nodes"), F.array("c").alias("confs"), F.array("edge").alias("edges"), F.col("c").alias("conf")).where(is_end)
        else:
            longer = hop_edges.join(found.withColumnRenamed("v", "u"), "u").where(~F.array_contains("edges", F.col("edge")))
            found = longer.select("v", "end", *[F.array_prepend(f"{c}s", F.col(x)).alias(f"{c}s") for c, x in (("kind", "kind"), ("node", "v"), ("conf", "c"), ("edge", "edge"))], (F.col("c") * F.col("conf")).alias("conf"))
        back = j > 0 and bool(together[j - 1])
        ends, paths = ends_kept + ends * back, paths_kept + paths * back
        found = _best_suffixes(found, paths, ends)
    return found.drop("edges")


def expand_from_chunks(seeds: DataFrame, edges: DataFrame, *, limit: int, confidence: float = 0.6, depth: int = 4, max_seeds: int = 12, patterns: tuple[tuple[Hop, ...], ...] = PATTERNS, is_chunk=lambda c: c.startswith("chunk:")) -> DataFrame:
    """query, rank, chunk, kinds, nodes, confidence, depth, strength: for each query the `limit` strongest chunks that are no seeds of its own.

    seeds: query, place, seed (a query's first max_seeds distinct seeds by place count); edges: src, dst, kind, confidence (null
    counts as 1). Of each pattern of at most `depth` hops the max(4 * limit, 20) most confident paths are looked at, ties by chunk and by nodes;
    of the paths to a chunk the strongest stays, then the shorter, then the earlier pattern. Queries and seeds that are null, and
    seeds without edges, find nothing.
    """
    most = max(4 * limit, 20)
    once = seeds.where(F.col("query").isNotNull() & F.col("seed").isNotNull()).groupBy("query", "seed").agg(F.min("place").alias("place"))
    first = once.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("place", "seed"))).where(F.col("n") <= max_seeds)
    own = first.groupBy("query").agg(F.collect_set("seed").alias("own"))  # max_seeds at most
    asked = settle(first.select("query", "seed").join(own, "query"), "seeds")
    edges = settle(edges.select("src", "dst", "kind", "confidence"), "edges")  # read by every hop
    found, known = [], {}
    for i, hops in enumerate(patterns):
        if len(hops) > depth:
            continue
        tails = suffixes(asked, edges, hops, confidence=confidence, paths_kept=most, ends_kept=most + max_seeds, is_end=is_chunk(F.col("end")), known=known)
        paths = asked.join(tails, F.col("seed") == F.col("v")).where(~F.array_contains("own", F.col("end")))
        exact = F.aggregate("confs", F.lit(1.0), lambda a, c: a * c)
        paths = paths.select("query", "end", "kinds", "nodes", exact.alias("confidence"), F.lit(len(hops)).alias("depth"), F.lit(i).alias("pattern"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(*_order("confidence")))
        found.append(settle(paths.withColumn("n", rank).where(F.col("n") <= most), "paths"))
    scored = reduce(DataFrame.unionByName, found).withColumn("strength", strength())
    better = F.struct((-F.col("strength")).alias("s"), "depth", "pattern", "n")
    best = scored.groupBy("query", "end").agg(F.min_by(F.struct("kinds", "nodes", "confidence", "depth", "strength"), better).alias("p")).select("query", F.col("end").alias("chunk"), "p.*")
    order = Window.partitionBy("query").orderBy(F.desc("strength"), "depth", F.round("confidence", 9).desc(), "chunk")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)

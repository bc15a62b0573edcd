"""Pruned expansion against all paths."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from gneiss.operators import expansion as X
from gneiss.operators.graph import DEFAULT_WEIGHT, RELATION_WEIGHTS


def all_paths(edges, seed, hops, least):
    paths = [([seed], [], [], [])]
    for hop in hops:
        grown = []
        for nodes, kinds, used, confs in paths:
            for i, (src, dst, kind, c) in enumerate(edges):
                c = 1.0 if c is None else c
                if kind not in hop.kinds or c < least or (src, dst, kind) in used:
                    continue
                ends = ([dst] if src == nodes[-1] and hop.way != "in" else []) + ([src] if dst == nodes[-1] and hop.way != "out" else [])
                grown += [([*nodes, end], [*kinds, kind], [*used, (src, dst, kind)], [*confs, c]) for end in ends]
        paths = grown
    return paths


def loop_expand(seeds, edges, limit, least, max_seeds):
    out = []
    most = max(4 * limit, 20)
    for query in sorted({q for q, *_ in seeds}):
        own = list(dict.fromkeys(s for _, _, s in sorted(x for x in seeds if x[0] == query)))[:max_seeds]
        best = {}
        for number, hops in enumerate(X.PATTERNS):
            found = []
            for seed in own:
                for nodes, kinds, _, confs in all_paths(edges, seed, hops, least):
                    conf = 1.0
                    for c in confs:
                        conf *= c
                    if nodes[-1].startswith("chunk:") and nodes[-1] not in own:
                        found.append((-round(conf, 9), nodes[-1], ">".join(nodes), conf, kinds))
            found.sort(key=lambda x: x[:3])
            for n, (_, end, nodes, conf, kinds) in enumerate(found[:most]):
                strength = round(max(RELATION_WEIGHTS.get(k, DEFAULT_WEIGHT) for k in kinds) + 0.05 * conf - 0.005 * len(hops), 6)
                key = (-strength, len(hops), number, n)
                if end not in best or key < best[end][0]:
                    best[end] = (key, nodes, conf, len(hops), strength)
        ranked = sorted((-s, d, -round(c, 9), end, nodes) for end, (_, nodes, c, d, s) in best.items())
        out += [(query, i + 1, end, nodes, d) for i, (_, d, _, end, nodes) in enumerate(ranked[:limit])]
    return out


def test_expansion_equals_all_paths(spark):
    rng = random.Random(5)
    chunks, units, topics = [f"chunk:{i}" for i in range(40)], [f"unit:{i}" for i in range(12)], ["topic:0", "topic:1"]
    conf = lambda: rng.choice([None, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])
    edges = {}
    for c in chunks:
        unit = rng.choice(units)
        edges[c, unit, "SOURCE_OF"] = conf()
        edges[unit, c, "HAS_SOURCE_CHUNK"] = conf()
        for t in topics:
            if rng.random() < 0.8:  # frequent topics
                edges[c, t, rng.choice(X.TAXONOMY)] = conf()
    for u, v in itertools.product(units, units):
        if u != v and rng.random() < 0.2:
            edges[u, v, rng.choice(X.REFERENCES)] = conf()
    for u in units:
        for t in topics:
            edges[u, t, rng.choice(X.TAXONOMY)] = conf()
            edges[u, t, rng.choice(X.TAXONOMY)] = conf()
    rows = [(*k, c) for k, c in edges.items()]
    seeds = [(q, p, rng.choice(chunks)) for q in range(6) for p in range(4)]
    df = spark.createDataFrame(rows, "src string, dst string, kind string, confidence double").withColumn("seed", F.lit(1))
    asked = spark.createDataFrame([*seeds, (None, 0, "chunk:1"), (9, 0, None), (8, 0, "chunk:none")], "query int, place int, seed string")
    for limit, max_seeds in ((3, 2), (7, 4)):
        got = X.expand_from_chunks(asked, df, limit=limit, confidence=0.6, max_seeds=max_seeds).collect()
        assert sorted((r["query"], r["rank"], r["chunk"], ">".join(r["nodes"]), r["depth"]) for r in got) == sorted(loop_expand(seeds, rows, limit, 0.6, max_seeds))
    assert X.expand_from_chunks(asked.limit(0), df, limit=3).count() == 0 and X.expand_from_chunks(asked, df.limit(0), limit=3).count() == 0


def test_a_node_keeps_few(spark):
    """Behind one topic of 3,000 chunks every seed keeps as many suffixes as it may, not 3,000."""
    edges = spark.range(3000).select(F.concat(F.lit("chunk:"), "id").alias("src"), F.lit("topic:0").alias("dst"), F.lit("HAS_ISSUE_TYPE").alias("kind"), (0.6 + F.col("id") % 40 / 100).alias("confidence"))
    seeds = spark.range(30).select(F.concat(F.lit("chunk:"), "id").alias("seed"))
    kept = X.suffixes(seeds, edges, X.PATTERNS[1], confidence=0.6, paths_kept=5, ends_kept=8, is_end=F.col("end").startswith("chunk:"))
    assert {r["n"] for r in kept.groupBy("v").agg(F.count("*").alias("n")).collect()} == {8}
    with pytest.raises(ValueError):
        X.suffixes(seeds, edges, (X.PATTERNS[1][0], X.PATTERNS[0][0], X.PATTERNS[1][1]), confidence=0.6, paths_kept=5, ends_kept=8, is_end=F.lit(True))

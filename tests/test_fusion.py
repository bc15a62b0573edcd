"""Merged lists and promoted hits against loops over plain lists."""

import random

from gneiss.operators import fusion as X
from pyspark.sql import functions as F

HITS = "query string, place int, chunk string, score double, source string, vector_score double, graph_score double, seeds array<string>, nodes array<string>, kinds array<string>"


def test_merged_equals_a_loop(spark):
    rng = random.Random(3)
    lists = [[], []]
    for which, source in ((0, "vector"), (1, "graph")):
        for q in ("a", "b", "c"):
            for place in range(rng.choice([0, 3, 25])):
                arrays = [[rng.choice([None, "", *"xyz"]) for _ in range(rng.randrange(4))] or None for _ in range(3)]
                lists[which].append((q, place, f"c{rng.randrange(9)}", rng.choice([None, 0.1, 0.5, 0.9]), rng.choice([source, source, "hybrid", None, ""]), rng.choice([None, 0.2]), rng.choice([None, 0.3]), *arrays))
    want = {}
    for hits in lists:
        for h in hits:
            want.setdefault((h[0], h[2]), []).append(h)
    got = X.merged(*[spark.createDataFrame(x, HITS) for x in lists]).collect()
    assert {(r["query"], r["chunk"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        rows = want[r["query"], r["chunk"]]
        sources = [h[4] for h in rows if h[4]]
        source = "hybrid" if "graph" in sources and {"vector", "hybrid"} & set(sources) else (sources or ["vector"])[0]
        assert r["source"] == source and r["score"] == max(h[3] or 0.0 for h in rows) and r["vector_score"] == max(h[5] or 0.0 for h in rows)
        for i, name in enumerate(X.ARRAYS):
            assert r[name] == list(dict.fromkeys(x for h in rows for x in h[7 + i] or [] if x))
        order = list(dict.fromkeys(k for k in want if k[0] == r["query"]))
        assert r["place"] == order.index((r["query"], r["chunk"])) + 1
    assert X.merged(spark.createDataFrame([], HITS), spark.createDataFrame([(None, 1, "c", 1.0, "graph", 0.0, 0.0, None, None, None)], HITS)).count() == 0


def promote(hits, plans, required, step=1e-3):
    """Plans one after the other over a sorted list of (score, chunk, document, article)."""
    for plan in plans:
        found, used = [], set()
        for doc, article in required[plan][1]:
            for h in hits:
                if h[1] not in used and h[2:] == (doc, article):
                    found.append(h)
                    used.add(h[1])
                    break
        if len(found) < 2:
            continue
        top = max(h[0] for h in hits)
        hits = [(round(top + required[plan][0] - i * step, 8), *h[1:]) for i, h in enumerate(found)] + [h for h in hits if h[1] not in used]
    return hits


def test_covered_equals_a_loop(spark):
    rng = random.Random(8)
    required = {"p": (0.30, [("law", "40"), ("law", "42"), ("law", "47")]), "q": (0.25, [("law", "42"), ("decree", "9"), ("law", "98")])}
    need = [(plan, turn, i, doc, article, lift) for turn, (plan, (lift, arts)) in enumerate(required.items()) for i, (doc, article) in enumerate(arts)]
    rows, applies, want = [], [], {}
    for q in range(80):
        plans = rng.choice([[], ["p"], ["q"], ["p", "q"]])
        hits = sorted([(rng.randrange(9) / 8, f"c{i}", rng.choice(["law", "decree"]), rng.choice(["40", "42", "47", "98", "9"])) for i in range(rng.randrange(12))], key=lambda h: (-h[0], h[1]))
        rows += [(str(q), h[1], h[2], h[3], h[0], i + 1) for i, h in enumerate(hits)]
        applies += [(str(q), p) for p in plans * 2]
        want[str(q)] = [(h[1], h[0]) for h in promote(hits, plans, required)]
    hits = spark.createDataFrame(rows, "query string, chunk string, document string, article string, score double, rank int")
    need = spark.createDataFrame(need, "plan string, turn int, place int, document string, article string, lift double")
    got = {}
    for r in X.covered(hits, spark.createDataFrame(applies, "query string, plan string"), need).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["chunk"], r["score"]))
    for q, own in want.items():
        assert [(c, s) for _, c, s in sorted(got.get(q, []))] == own


def test_asked_articles(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", str(i % 3)) for i in range(12)], "chunk string, document string, article string")
    hits = X.as_hits(spark.createDataFrame([("a", 1, "c0", 0.5)], "query string, place int, chunk string, score double"), "vector")
    routed = spark.createDataFrame([("a", "article", "0", 0), ("a", "article", "2", 1), ("a", "article", "1", 2), ("a", "term", "x", 0), ("b", "article", "1", 0), *[("c", "article", str(i), i) for i in range(5)]], "query string, kind string, value string, n int")
    got = {(r["query"], r["place"]): (r["chunk"], r["score"]) for r in X.asked_articles(hits, routed, chunks, first=2, others=1).collect()}
    assert got == {("a", 1): ("c11", 0.499), ("a", 2): ("c2", 0.4989), ("a", 3): ("c1", 0.4988), ("b", 1): ("c1", 0.0), ("b", 2): ("c10", -0.0001)}

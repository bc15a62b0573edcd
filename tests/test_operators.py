"""Operators on small fixtures written for these tests."""

from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import dense, graph, labels, references, retrieval, structure
from gneiss.sources import tables


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_folding(spark):
    assert one(spark, T.fold, "  Điều  12.\tÀ Ế ß ") == "dieu 12. a e ß"
    assert one(spark, T.slug, "Luật Lao động 2019!") == "luat-lao-dong-2019"
    assert one(spark, T.slug, "!!!") == "document"
    assert one(spark, T.clean, "a ­b  c , d\n\n\n\ne") == "a b c, d\n\ne"
    assert one(spark, T.repair_mojibake, "caf" + "é".encode().decode("latin-1")) == "café"
    assert one(spark, T.token_count, "  a  b\nc ") == 3
    assert one(spark, T.token_count, " ") == 0
    assert one(spark, lambda c: T.preview(c, 8), "alpha beta") == "alpha..."
    assert one(spark, T.paragraphs, "a\n\n \nb\n") == ["a", "b"]


LAW = "Phần thứ nhất\nChương I\nĐiều 1. Phạm vi\n1. Một\na) Điểm\n2. Hai\nChương II\nĐiều 2. Khác\n1. Ba\nĐiều 1. Lặp"


def test_structure(spark):
    lines = structure.lines_of(spark.createDataFrame([("d", LAW)], "doc_id string, text string"))
    rows = {r["pos"]: r for r in structure.with_context(lines).collect()}
    assert [rows[4][c] for c in ("part", "chapter", "article", "clause", "point")] == ["nhat", "i", "1", "1", "a"]
    assert [rows[5][c] for c in ("clause", "point")] == ["2", None]
    assert [rows[6][c] for c in ("chapter", "article", "clause")] == ["ii", None, None]
    spans = sorted((r["start"], r["end"], r["article"], r["occurrence"]) for r in structure.article_spans(lines).collect())
    assert spans == [(2, 6, "1", 1), (7, 9, "2", 1), (9, 10, "1", 2)]


def test_packing_of_units(spark):
    df = spark.createDataFrame([(["aa", "bb", "cccccc", "d"],), ([],)], "u array<string>")
    assert [r["x"] for r in df.select(structure.pack_units(F.col("u"), 5, "-").alias("x")).collect()] == [["aa-bb", "cccccc", "d"], []]


def test_references(spark):
    folded = "theo diem a khoan 2 dieu 35 va dieu 36a, dieu 35"
    found = spark.createDataFrame([(folded,)], "t string").select(references.legal_references(F.col("t")).alias("x")).first()["x"]
    assert (found["articles"], found["clauses"], found["points"]) == (["35", "36a"], ["2"], ["a"])


def test_graph_paths(spark):
    edges = spark.createDataFrame([("a", "b", "REFERENCES", 0.9), ("b", "c", "DETAILS", None), ("c", "a", "GUIDES", 0.5), ("a", "c", "OTHER", 1.0)], "src string, dst string, kind string, confidence double")
    seeds = spark.createDataFrame([("a",)], "seed string")
    two = graph.expand(seeds, edges, [[(["REFERENCES"], False), (["DETAILS"], False)]]).collect()
    assert [(r["at"], r["nodes"], r["confidence"]) for r in two] == [("c", ["a", "b", "c"], 0.9)]
    loose = graph.expand(seeds, edges, [[(["GUIDES"], True)]], confidence=0.4).collect()
    assert [r["at"] for r in loose] == ["c"]
    assert graph.expand(seeds, edges, [[(["GUIDES"], True)]]).count() == 0
    both = graph.expand(seeds, edges, [[(["REFERENCES"], False), (["DETAILS"], False)], [(["OTHER"], False)]])
    assert [(r["at"], r["depth"]) for r in graph.best_paths(both, 5).collect()] == [("c", 2)]
    assert graph.first_wins(edges.union(edges), ["src", "dst", "kind"], ["confidence"]).count() == 4


def test_budget_and_diversity(spark):
    rows = spark.createDataFrame([("q", 1, "a", 50), ("q", 2, "a", 60), ("q", 3, "b", 5), ("r", 1, "x", 500)], "query string, rank int, g string, size int")
    assert sorted((r["query"], r["rank"]) for r in retrieval.budget(rows, "query", "size", 100).collect()) == [("q", 1), ("r", 1)]
    assert [r["rank"] for r in retrieval.diversified(rows, "query", "g").where("query = 'q'").orderBy("place").collect()] == [1, 3, 2]
    parts = spark.createDataFrame([(["abc", "b", "abcd"],)], "p array<string>").select(retrieval.overlap_free(F.col("p")).alias("x")).first()["x"]
    assert parts == ["abc", "abcd"]


def test_dense_ties_and_nulls(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r["vec_id"], r["rank"]) for r in dense.top_k(vectors, asked, 2).orderBy("rank").collect()] == [(3, 1), (2, 2)]
    assert dense.top_k(vectors.limit(0), asked, 2).count() == 0


def test_labels_and_guard(spark):
    df = spark.createDataFrame([("dieu 5",), ("how was that",), ("hm",), (None,)], "t string")
    got = [r["x"] for r in df.select(labels.guard(F.col("t"), ["how", "was"], r"dieu\s+\d+", 2).alias("x")).collect()]
    assert got == ["reference", "signals", "refused", "refused"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x  y\n\n\n\nz", encoding="utf-8")
    assert [r["text"] for r in tables.text_files(spark, str(tmp_path / "a.txt")).collect()] == ["x y\n\nz"]
    c = spark.createDataFrame([("p1", "Luật A (extract)", "long long"), ("p2", "Luật A", "short"), ("p3", "B", "b")], "path string, title string, text string")
    assert sorted(r["path"] for r in tables.pick_sources(c).collect()) == ["p2", "p3"]
    found = spark.createDataFrame([("a",)], "name string")
    assert [r["name"] for r in tables.missing_files(spark, found, ["a", "b"]).collect()] == ["b"]
    tables.write_records(c, str(tmp_path / "out"))
    assert tables.read_records(spark, str(tmp_path / "out"), "path string, title string, text string").count() == 3


def test_containment_and_quotes(spark, sf):
    import re

    from gneiss.operators.containment import contained
    from gneiss.registry import QUERIES

    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    asked = {r["item_id"]: r["text"] for r in items.collect()}
    got = {(r["item_id"], r["doc_id"]) for r in contained(docs, items, "doc_id", "item_id").collect()}
    assert got == {(i, k) for i, p in asked.items() for k, t in texts.items() if p in t}
    assert contained(docs, items.limit(0), "doc_id", "item_id").count() == 0
    quotes = {r["item_id"]: (r["n_quotes"], r["n_supported"]) for r in QUERIES["quote_support"](spark, sf).collect()}
    for i, p in asked.items():
        own = [q for q in re.split(r"(?<=[.])\s+", p) if len(q) >= 8]
        if own:
            assert quotes[i] == (len(own), sum(any(q in t for t in texts.values()) for q in own))


def test_chunks_against_a_loop(spark, sf):
    from gneiss.registry import QUERIES

    got = {}
    for r in QUERIES["chunk_pack"](spark, sf).collect():
        got.setdefault(r["doc_id"], {})[r["n"]] = r["n_chars"]
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        chunks = []
        for unit in filter(None, (x.strip(" ") for x in r["text"].split("\n"))):
            if chunks and len(chunks[-1]) + 1 + len(unit) <= 1200:
                chunks[-1] += "\n" + unit
            else:
                chunks.append(unit)
        assert [got.get(r["doc_id"], {}).get(n) for n in range(len(chunks))] == [len(c) for c in chunks]


def test_the_last_hop_builds_no_arrays(spark, sf):
    from gneiss.operators import graph
    from gneiss.registry import QUERIES

    plan = QUERIES["expand_taxonomy_4hop"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_append") < 4 and "array_join" not in plan
    edges = spark.createDataFrame([("a", "b", "x", None), ("b", "c", "y", 0.9), ("b", "a", "y", 1.0)], "src string, dst string, kind string, confidence double")
    rows = graph.expand(spark.createDataFrame([("a",)], "seed string"), edges, [[(["x"], False), (["y"], False)]]).collect()
    assert [(r["trail"], r["path"], r["kinds"], r["nodes"]) for r in rows] == [("x>y", "a>b>c", ["x", "y"], ["a", "b", "c"])]

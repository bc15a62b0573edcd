"""Folding with places, spans that hide others, references and their edges, against loops."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from gneiss.functions.alignment import fold_with_offsets, raw_span
from gneiss.operators import references as X
from gneiss.operators.spans import Pattern, drop_hidden, find_spans
from gneiss.plans.reference_queries import CROSS, DOCUMENTS, MARK, NAMES, PATTERNS, rank


def loop_fold(text):
    out, places, space = [], [], True
    for i, c in enumerate(text):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.replace("đ", "d").replace("Đ", "D")) if not unicodedata.combining(x)).lower()
        for x in plain:
            if not x.isspace() or not space:
                out.append(" " if x.isspace() else x)
                places.append(i)
            space = x.isspace()
    if out and out[-1] == " ":
        out.pop(), places.pop()
    return "".join(out), places


def test_folding_keeps_places():
    rng = random.Random(1)
    signs = [*"aB đĐ\t\n ", "ﬁ", "İ", "é", "é", "̂", "½", "ạ", " ", "𝒳", "ß", "  "]
    for _ in range(400):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(12)))
        folded, places = fold_with_offsets(text)
        assert (folded, places.tolist()) == loop_fold(text), repr(text)
    assert fold_with_offsets(None)[0] == ""
    folded, places = fold_with_offsets("  Điều   5 ")
    assert folded == "dieu 5" and raw_span(places, 0, 6) == (2, 12) and raw_span(places, 2, 2) is None and raw_span(places, 0, 7) is None


def test_spans_have_raw_text(spark):
    rows = [(1, "Xem  Điều 7 và điều\n12a.", 0), (2, None, 0), (3, "", 0), (None, "điều 1", 0), (4, "nothing", 0), (1, "Xem  Điều 7 và điều\n12a.", 0)]
    df = spark.createDataFrame(rows, "id long, body string, start int")
    got = find_spans(df, ["id"], "body", [Pattern("a", r"dieu (?P<n>\d+[a-z]?)")]).collect()
    assert sorted((r["id"] or 0, r["raw"], r["groups"]["n"], r["suffix"]) for r in got) == sorted([(0, "điều 1", "1", ""), *[(1, "Điều 7", "7", " va dieu 12a"), (1, "điều\n12a", "12a", "")] * 2])
    for r in got:
        text = "điều 1" if r["id"] is None else rows[0][1]
        assert text[r["raw_start"] : r["raw_end"]] == r["raw"]
    assert find_spans(df.limit(0), ["id"], "body", PATTERNS).count() == 0


def test_matching_starts_behind_the_mark(spark):
    df = spark.createDataFrame([(1, "Điều 1 quy định: Điều 2"), (2, "Điều 3 mở"), (3, "quy định:")], "id long, t string")
    got = find_spans(df, ["id"], "t", [Pattern("a", r"dieu (?P<n>\d+)")], after=MARK).collect()
    assert sorted((r["id"], r["groups"]["n"], r["raw_start"]) for r in got) == [(1, "2", 17), (2, "3", 0)]


def test_hidden_spans_equal_a_loop(spark):
    rng = random.Random(2)
    patterns = [Pattern("a", "", ("b", "c")), Pattern("b", "", ("c",)), Pattern("c", "")]
    rows = [(rng.randrange(6), rng.choice("abc"), s := rng.randrange(30), s + rng.randrange(1, 12)) for _ in range(300)]
    got = drop_hidden(spark.createDataFrame(rows, "key int, pattern string, start int, end int"), ["key"], patterns)
    hides = {p.name: p.hides for p in patterns}
    want = [r for r in rows if not any(o[0] == r[0] and r[1] in hides[o[1]] and o[2] <= r[2] and r[3] <= o[3] for o in rows)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


CHUNKS = "chunk_id string, document_id string, article_number string, clause_ref string, point_ref string, level string, text string, retrieval_text string"


def parsed(spark, rows):
    df = spark.createDataFrame([(*r, None) if len(r) == 7 else r for r in rows], CHUNKS).withColumn("document_type_rank", rank(F.col("document_id"))).withColumn("start", F.lit(0))
    return df, X.parse_references(df, [("text", None), ("retrieval_text", MARK)], PATTERNS, NAMES, DOCUMENTS)


@pytest.mark.parametrize(
    ("document", "article", "text", "expected"),
    [
        ("nghi-dinh-145-2020-nd-cp", "2", "theo quy định tại khoản 1, 2 và 3 Điều 35 của Bộ luật Lao động", {"clause:45-2019-qh14:dieu-35:khoan-1", "clause:45-2019-qh14:dieu-35:khoan-2", "clause:45-2019-qh14:dieu-35:khoan-3"}),
        ("nghi-dinh-145-2020-nd-cp", "2", "điểm a khoản 1 Điều 5 Nghị định này", {"point:nghi-dinh-145-2020-nd-cp:dieu-5:khoan-1:diem-a"}),
        ("nghi-dinh-145-2020-nd-cp", "1", "quy định chi tiết Điều 8", {"article:45-2019-qh14:dieu-8"}),
        ("nghi-dinh-145-2020-nd-cp", "3", "quy định chi tiết Điều 8", {"article:nghi-dinh-145-2020-nd-cp:dieu-8"}),
        ("45-2019-qh14", "219", "sửa khoản 2 Điều 54 luật này", {"clause:external-quoted-amended-law:dieu-54:khoan-2"}),
        ("45-2019-qh14", "9", "Nghị định số 1 và Thông tư 9/2020/TT-BLĐTBXH", {"document:thong-tu-09-2020-tt-bldtbxh"}),
        ("45-2019-qh14", "9", "Điều 3. Bộ luật Dân sự", {"article:45-2019-qh14:dieu-3"}),
        ("45-2019-qh14", "9", "Điều 3 và Bộ luật Dân sự", {"article:external-bo-luat-dan-su:dieu-3"}),
        ("thong-tu-10-2020-tt-bldtbxh", "9", "Điều 3 Nghị định này", {"article:thong-tu-10-2020-tt-bldtbxh:dieu-3"}),
        ("45-2019-qh14", "9", "điều khoản chung", set()),
    ],
)
def test_targets(spark, document, article, text, expected):
    got = parsed(spark, [("c", document, article, None, None, "article", text)])[1].collect()
    assert {r["target_id"] for r in got} == expected
    assert all(text[r["raw_start"] : r["raw_end"]] == r["raw"] for r in got)


def test_edges(spark):
    decree, code = "nghi-dinh-145-2020-nd-cp", "45-2019-qh14"
    rows = [
        ("a", decree, "4", "1", None, "clause", "khoản 1 Điều 35 của Bộ luật Lao động; Điều 35 của Bộ luật Lao động", "Cited: x quy định: Điều 35 của Bộ luật Lao động"),
        ("b", code, "35", "1", None, "clause", "Điều 35 và khoản 1 Điều 35"), ("c", code, "36", None, None, "article", "theo Nghị định 145/2020/NĐ-CP"), ("d", code, "37", None, None, "article", None), ("e", None, None, None, None, None, "Điều 99 Bộ luật Lao động"),
    ]
    df, found = parsed(spark, rows)
    edges = {(r["source_id"], r["edge_type"], r["target_id"]): r for r in X.reference_edges(df, found, rank).collect()}
    clause, article = f"clause:{code}:dieu-35:khoan-1", f"article:{code}:dieu-35"
    mine = f"clause:{decree}:dieu-4:khoan-1"
    assert set(edges) == {
        (mine, "DETAILS", clause), (clause, "GUIDED_BY", mine), (mine, "DETAILS", article), (article, "GUIDED_BY", mine), (clause, "REFERENCES", article),
        (f"article:{code}:dieu-36", "GUIDED_BY", f"document:{decree}"), ("chunk:e", "REFERENCES", f"article:{code}:dieu-99"),
    }
    assert edges[mine, "DETAILS", article]["duplicates"] == 1 and edges[article, "GUIDED_BY", mine]["method"] == "inverse:guided_by"
    assert [k for k, r in edges.items() if not r["resolved"]] == [("chunk:e", "REFERENCES", f"article:{code}:dieu-99")]
    assert [tuple(r)[1] for r in X.unresolved_reasons(X.reference_edges(df, found, rank), X.known_nodes(df)).collect()] == ["missing_article"]
    empty = df.limit(0)
    assert X.reference_edges(empty, X.parse_references(empty, [("text", None)], PATTERNS, NAMES, DOCUMENTS), rank).count() == 0


def test_patterns_are_over_folded_text():
    assert all(unicodedata.normalize("NFKD", p.regex).isascii() and re.compile(p.regex) for p in PATTERNS)


def test_cross_references(spark):
    rows = [
        ("a", "nghi-dinh-1-2020-nd-cp", "4", None, None, None, "Theo quy định tại  Điểm a khoản 2 Điều 5; Nghị định 2/2021/NĐ-CP, Nghị định 1/2020/NĐ-CP", None),
        ("b", "doc", "5", None, None, None, "Điều 5, điều 6", None), ("c", "doc", None, None, None, None, "Bộ luật Lao động, Điều 7", None), ("d", None, None, None, None, None, None, None), ("e", None, None, None, None, None, "không", None),
    ]
    df = spark.createDataFrame(rows, CHUNKS)
    got = X.cross_references(df, "text", CROSS, "nghi-dinh-%s-%s-nd-cp", main=("bo luat lao dong", "code"), prefix="nghi-dinh").collect()
    assert sorted((r["chunk_id"], r["target_id"], r["edge_type"], r["raw"]) for r in got) == [
        ("a", "document:nghi-dinh-2-2021-nd-cp", "GUIDED_BY", "Nghị định 2/2021/NĐ-CP"), ("a", "point:code:dieu-5:khoan-2:diem-a", "REFERENCES", "Theo quy định tại  Điểm a khoản 2 Điều 5"),
        ("b", "article:doc:dieu-6", "REFERENCES", "điều 6"), ("c", "article:code:dieu-7", "REFERENCES", "Điều 7"),
    ]

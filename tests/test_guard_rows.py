"""Answers' rows are dealt out once and folded before they meet; odd requests keep their rows."""

import pytest

from gneiss.operators import guard as G
from gneiss.plans import guard_queries


@pytest.mark.parametrize("name", sorted(guard_queries.QUERIES))
def test_rows_are_dealt_out_by_answer_alone(spark, sf, name):
    plan = guard_queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert {line.split("hashpartitioning(")[1].split(",")[0].split("#")[0] for line in plan.splitlines() if "hashpartitioning(" in line} == {"l_orderkey"}


def test_repeated_blank_and_placeless_requests(spark):
    allowed = spark.createDataFrame([(1, 0, "Điều 5, khoản 1"), (1, 1, "Điều 5"), (1, 2, " "), (2, 0, None)], "answer long, index int, citation string")
    rows = [(1, 0, "dieu 5"), (1, 0, "dieu 5"), (1, 0, None), (1, 1, " "), (1, None, "Điều 5"), (None, 3, "Điều 5"), (2, 0, "Điều 5")]
    got = G.canonical_citations(spark.createDataFrame(rows, "answer long, place int, citation string"), allowed).select("answer", "place", "citation", "canonical").collect()
    meant = {(1, 0): "Điều 5"}
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*r, meant.get(r[:2]))) for r in rows)


def test_verdicts_count_repeated_requests(spark):
    contexts = spark.createDataFrame([(1, 0, "Điều 5", "5", 1)], "answer long, index int, citation string, article string, rank int")
    requests = spark.createDataFrame([(1, 0, "Điều 9"), (1, 0, "Điều 9"), (1, 1, "Điều 5")], "answer long, place int, citation string")
    answers = spark.createDataFrame([(1, "Theo Điều 5.", False), (2, "Không rõ", None)], "answer long, text string, insufficient boolean")
    got = {r["answer"]: (r["has_citation"], r["n_unretrieved"], r["unsupported_articles"], r["keeps_rank"], r["passed"]) for r in G.validate_answers(answers, requests, contexts, ["x"]).collect()}
    assert got == {1: (True, 2, ["9"], True, False), 2: (True, 0, [], True, True)}

"""Canonical citations and verdicts on small answers, against what each must be."""

from gneiss.operators import guard as G

ALLOWED = [(1, 0, "Điều 5, khoản 2 Bộ luật Lao động", None, 1), (1, 1, "Điều 5 Bộ luật Lao động", "5", 1), (1, 2, "Nghị định 145, Điều 7", None, 2), (2, 0, "Điều 5 Bộ luật Lao động", None, 1), (2, 1, "dieu 5  bo luat lao dong", None, 1), (3, 0, None, None, None), (3, 1, " ", "9", None)]
REQUESTS = [
    (1, 0, "điều 5 bộ luật lao động"), (1, 1, "Điều 5, khoản 2"), (1, 2, "Điều 6 Bộ luật Lao động"), (1, 3, None), (1, 4, " "), (1, 5, "Nghị định 145 (sửa đổi), Điều 7"), (1, 6, "Điều 5 Bộ luật Lao động"), (2, 0, "DIEU 5 BO LUAT LAO DONG"), (3, 0, "Điều 9"), (4, 0, "Điều 1"),
]


def frames(spark):
    return spark.createDataFrame(REQUESTS, "answer int, place int, citation string"), spark.createDataFrame(ALLOWED, "answer int, index int, citation string, article string, rank int")


def test_canonical_citations(spark):
    requests, allowed = frames(spark)
    got = {(r["answer"], r["place"]): r["canonical"] for r in G.canonical_citations(requests, allowed).collect()}
    code, clause = ALLOWED[1][2], ALLOWED[0][2]
    assert got == {(1, 0): code, (1, 1): clause, (1, 2): None, (1, 3): None, (1, 4): None, (1, 5): "Nghị định 145, Điều 7", (1, 6): code, (2, 0): code, (3, 0): None, (4, 0): None}
    basis = {r["answer"]: r["basis"] for r in G.legal_basis(G.canonical_citations(requests, allowed)).collect()}
    assert basis == {1: [code, clause, "Nghị định 145, Điều 7"], 2: [code]}
    assert G.canonical_citations(requests.limit(0), allowed).count() == 0 and G.canonical_citations(requests, allowed.limit(0)).where("canonical is not null").count() == 0


def test_verdicts(spark):
    answers = spark.createDataFrame(
        [(1, "Theo điều 5 bộ luật lao động, được.", False), (2, "Theo Điều 8, được.", False), (3, "Chưa đủ căn cứ.", True), (4, "Có.", True), (5, None, None), (6, "Theo Nghị định 145, Điều 7: có", False), (7, "Theo Điều 3 Luật A: có", False)], "answer int, text string, insufficient boolean"
    )
    requests = spark.createDataFrame([(1, 0, "Điều 5 Bộ luật Lao động"), (2, 0, "Điều 5 Bộ luật Lao động"), (6, 0, "Nghị định 145, Điều 7"), (7, 0, "Điều 3 Luật A"), (7, 1, "Điều 4 Luật A")], "answer int, place int, citation string")
    contexts = spark.createDataFrame(
        [(1, 0, "Điều 5 Bộ luật Lao động", None, 1), (2, 0, "Điều 5 Bộ luật Lao động", None, 1), (3, 0, "Điều 1", None, None), (6, 0, "Nghị định 145, Điều 7", None, 2), (6, 1, "Điều 5 Bộ luật Lao động", "5", 1), (7, 0, "Điều 3 Luật A", "3", None)], "answer int, index int, citation string, article string, rank int"
    )
    got = {r["answer"]: r for r in G.validate_answers(answers, requests, contexts, ["chua du can cu"]).collect()}
    verdict = lambda i: (got[i]["has_citation"], got[i]["citations_allowed"], got[i]["unsupported_articles"], got[i]["keeps_rank"], got[i]["says_insufficient"], got[i]["passed"])
    assert verdict(1) == (True, True, [], True, True, True)
    assert verdict(2) == (False, True, ["8"], True, True, False)
    assert verdict(3) == (True, True, [], True, True, True)
    assert verdict(4) == (True, True, [], True, False, False)  # says neither what it cites nor that it can't
    assert verdict(5) == (True, True, [], True, True, True)  # nothing to judge by
    assert verdict(6) == (True, True, [], False, True, False)
    assert verdict(7) == (True, False, ["4"], True, True, False)
    assert G.validate_answers(answers.limit(0), requests, contexts, ["x"]).count() == 0

"""Relevance, selection and sentences against loops over plain lists."""

import random

from gneiss.operators import evidence as E
from pyspark.sql import functions as F

STOP = ["the", "what"]


def test_terms_and_phrases(spark):
    rows = [(1, "What  Éarly notice of 30 days, early pay"), (2, None), (3, ""), (4, "ab the 12"), (5, "notice")]
    df = spark.createDataFrame(rows, "i int, q string").select("i", E.terms(F.col("q"), STOP).alias("t"))
    got = {r["i"]: (r["t"], r["p"]) for r in df.select("i", "t", E.phrases(F.col("t")).alias("p")).collect()}
    assert got[1] == (["early", "notice", "days,", "pay"], ["early notice days, pay", "early notice days,", "notice days, pay", "early notice", "notice days,", "days, pay"])
    assert got[2] == got[3] == got[4] == ([], []) and got[5] == (["notice"], [])


def test_relevance(spark):
    questions = spark.createDataFrame([(1, "notice period worker"), (2, None), (3, "worker pay"), (4, "employer pay")], "question_id int, question string")
    contexts = spark.createDataFrame(
        [(1, 0, "Notice period", "of a worker", 0.5, 1), (1, 1, None, "period", 7.0, None), (1, 2, "x", None, None, 9), (2, 0, "a", "b", -1.0, 2), (3, 0, "Employer pay", None, 0.0, 4), (4, 0, "Worker pay", None, 0.0, 4), (4, 1, "Employer and worker", None, 0.0, 4), (9, 0, "a", "b", 0.0, 1)],
        "question_id int, place int, citation string, body string, score double, rank int",
    )
    got = {(r["question_id"], r["place"]): r["relevance"] for r in E.relevance(questions, contexts, STOP, ("worker", "employer")).collect()}
    # 1, 0: "notice period" 8 in the citation; longer phrases only across "of a"; terms 2.5, 2.5, 1; 0.5; 3 ranks up
    assert got == {(1, 0): 14.65, (1, 1): 2.2, (1, 2): 0.0, (2, 0): 0.1, (3, 0): -27.5, (4, 0): -27.5, (4, 1): 2.5}
    scored = spark.createDataFrame([(1, 0, 20.0), (1, 1, 12.0), (1, 2, 11.9), (2, 0, 3.0), (2, 1, 7.0), (3, 0, 0.0), (3, 1, -2.0)], "question_id int, place int, relevance double")
    assert sorted((r["question_id"], r["place"]) for r in E.relevant(scored).collect()) == [(1, 0), (1, 1), (2, 0), (3, 0), (3, 1)]
    assert sorted((r["question_id"], r["place"], r["relevance"]) for r in E.by_relevance(scored).collect())[3:5] == [(2, 0, 7.0), (2, 1, 3.0)]


def loop(rows, most):
    chosen, seen = [], set()
    for rank, quota in E.RANK_QUOTAS.items():
        own = 0
        for r in rows:
            if r[5] == rank and own < quota and len(chosen) < most and r[6] not in seen:
                chosen.append(r[1])
                seen.add(r[6])
                own += 1
    for r in rows:
        if len(chosen) < most and r[6] not in seen:
            chosen.append(r[1])
            seen.add(r[6])
    return chosen


def test_selected_equals_a_loop(spark):
    rng = random.Random(4)
    rows = []
    for q in range(120):
        for place in range(rng.choice([1, 4, 12, 60])):
            rows.append((q, place, rng.choice(["a", "b", None]), rng.choice([None, *"123456789"]), f"c{rng.randrange(9)}", rng.choice([None, 0, 1, 1, 2, 3, 4])))
    df = spark.createDataFrame(rows, "question_id int, place int, document string, article string, chunk_id string, rank int")
    for most in (1, 3, 6, 20):
        got = {}
        for r in E.selected(df, most).collect():
            got.setdefault(r["question_id"], []).append((r["cited_at"], r["place"]))
        for q in range(120):
            own = [(*r, (r[2] or "", r[3] or r[4])) for r in rows if r[0] == q]
            assert [p for _, p in sorted(got[q])] == loop(own, most)
    assert E.selected(df.limit(0), 3).count() == 0


def test_best_sentence(spark):
    text = "One thing here. Notice and pay.\nNotice, pay and leave of Ánything!"
    rows = [(1, text, ["notice", "pay", "leave"]), (2, text, ["pay", "zzz"]), (3, text, []), (4, None, ["a"]), (5, " . ", ["a"]), (6, text, ["anything", "leave", "notice", "zzz"])]
    df = spark.createDataFrame(rows, "i int, t string, w array<string>")
    got = {r["i"]: r["s"] for r in df.select("i", E.best_sentence(F.col("t"), F.col("w"), r"[.!\n]+", 30).alias("s")).collect()}
    assert got == {1: "Notice, pay and leave of Ánything"[:30], 2: "Notice and pay", 3: "One thing here", 4: None, 5: None, 6: "Notice, pay and leave of Ánything"[:30]}

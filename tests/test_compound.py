"""Compound citations against a loop over plain strings, and scores of odd cases."""

import random
import re
import unicodedata

from gneiss.operators import compound as P
from gneiss.plans.compound_queries import DOCUMENTS, FAMILIES


def folded(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", s.replace("đ", "d").replace("Đ", "d").lower()).strip()


def bare(s):
    return re.sub(r"[^a-z0-9]+", " ", folded(s)).strip()


def named(s):
    return [f for f in FAMILIES if any(x in bare(s) for x in f.signatures)]


def loop(fields):
    out = []
    for field in fields:
        if not field:
            continue
        whole = named(field)
        for part in (x.strip(" ;") for x in re.split(r"\s*;\s*", field.strip())):
            own = named(part)
            one = own[0] if len(own) == 1 else whole[0] if len(whole) == 1 else None
            articles = list(dict.fromkeys(re.findall(r"\bdieu\s+(\d+[a-z]?)", bare(part))))
            clauses = list(dict.fromkeys(re.findall(r"\bkhoan\s+(\d+)", bare(part))))
            points = list(dict.fromkeys(p for g in re.findall(P.POINTS, folded(part)) for p in re.split(r"\s*(?:,|va)\s*", g) if p))
            if not articles or (len(articles) > 1 and (clauses or points)) or (len(clauses) > 1 and points):
                out.append(part)
                continue
            for a in articles:
                for c in clauses or [None]:
                    for p in points or [None]:
                        out.append(" ".join(filter(None, [f"Điều {a}", c and f"khoản {c}", p and f"điểm {p}", one and one.label])))
    return list(dict.fromkeys(x for x in out if x))


def test_atoms_equal_a_loop(spark):
    rng = random.Random(11)
    bits = ["Điều 5", "điều 12a", "khoản 1", "Khoản 2", "điểm a, b và đ", "các điểm c", "và", ",", ";", " ; ", ";;", "Bộ luật Lao động 2019", "Nghị định 145/2020/NĐ-CP", "45/2019/QH14", "(", ")", "phụ lục"]
    rows = [(1, 0, None), (1, 1, ""), (1, 2, " ; "), (2, 0, "Điều 1"), (2, 1, "Điều 1;Điều 1; Điều 2"), (3, 0, "Khoản 1 Điều 4 " * 3)]
    rows += [(case, field, " ".join(rng.choices(bits, k=rng.randrange(1, 14)))) for case in range(10, 150) for field in range(rng.randrange(1, 4))]
    got = {}
    for r in P.atoms(spark.createDataFrame(rows, "case_id int, field int, text string"), FAMILIES).collect():
        got.setdefault(r["case_id"], []).append((r["place"], r["citation"]))
    for case in {r[0] for r in rows}:
        want = loop([t for c, _, t in sorted(rows, key=lambda r: r[:2]) if c == case])
        assert [c for _, c in sorted(got.get(case, []))] == want
        assert [p for p, _ in sorted(got.get(case, []))] == list(range(len(want)))
    assert P.atoms(spark.createDataFrame([], "case_id int, field int, text string"), FAMILIES).count() == 0


def test_scopes_and_scores(spark):
    code, decree = FAMILIES[0].label, FAMILIES[1].label
    cases = spark.createDataFrame([(i,) for i in range(1, 8)], "case_id int")
    expected = spark.createDataFrame(
        [(1, f"Điều 5 khoản 1 {code}"), (1, f"Điều 6 {decree}"), (2, f"Điều 6 {decree}"), (3, "Điều 7"), (4, f"Điều 5 khoản 1 điểm a {code}"), (5, "phụ lục 3"), (7, f"Điều 5 {code}")], "case_id int, citation string"
    )
    observed = spark.createDataFrame([(1, 1, f"Điều 9 {code}"), (1, 2, f"điều 5 {code}"), (2, 1, f"Điều 6 {code}"), (3, 1, f"Điều 7 khoản 2 {code}"), (4, 1, f"Điều 5 khoản 1 {code}"), (5, 1, "xem Phụ lục 3 này"), (5, 2, None), (6, 1, "Điều 1")], "case_id int, rank int, citation string")
    scope = {r["case_id"]: (r["n_in"], r["n_out"], r["scope"]) for r in P.scopes(cases, expected, FAMILIES, ["bo_luat_2019"]).collect()}
    assert scope == {1: (1, 1, "mixed_scope"), 2: (0, 1, "out_of_scope"), 3: (1, 0, "in_scope"), 4: (1, 0, "in_scope"), 5: (1, 0, "in_scope"), 6: (0, 0, "no_gold_citation"), 7: (1, 0, "in_scope")}

    def run(**how):
        rows = P.scores(cases, expected, observed, FAMILIES, DOCUMENTS, **how).collect()
        return {r["case_id"]: (r["n_expected"], r["n_covered"], r["citation_score"], r["document_score"], r["hit"]) for r in rows}

    assert run(k=1) == {1: (2, 1, "partial", "partial", False), 2: (1, 0, "no", "no", False), 3: (1, 1, "exact", "na", True), 4: (1, 1, "exact", "exact", True), 5: (1, 1, "exact", "na", True), 6: (0, 0, "no", "na", False), 7: (1, 0, "no", "no", False)}
    narrow = run(allowed=["bo_luat_2019"], mode="normalized")
    assert narrow[1] == (1, 0, "no", "exact", False) and narrow[2] == (0, 0, "na", "na", None) and narrow[4] == (1, 0, "no", "exact", False) and narrow[6][2] == "na"
    assert run(mode="literal")[3][1] == 1 and run(mode="literal")[4][1] == 0

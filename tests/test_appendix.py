"""Appendices against a loop over the lines of plain strings."""

import random
import re

from gneiss.operators import appendix as A
from pyspark.sql import functions as F

APPENDIX, FORM = re.compile(r"^PHỤ\s+LỤC(?:\s+([IVXLCDM0-9A-Z]+))?\b", re.I), re.compile(r"^Mẫu\s+số\s+(\d+)\s*/?\s*(PL[IVXLCDM]+)", re.I)


def footer(line):
    return bool(re.match(r"^(?:Nơi nhận\b|TM\.\s|KT\.\s)", line, re.I)) or line in A.FOOTERS


def parts(text):
    lines = text.strip().split("\n")
    bare = [x.strip() for x in lines]
    articles = [i for i, x in enumerate(bare) if re.match(r"^Điều\s+\d+[A-Za-z]?\.", x)]
    if not articles:
        return text.strip(), "", []
    ends = [i for i in range(articles[0], len(lines)) if i not in articles and footer(bare[i])]
    after = ends[0] if ends else articles[-1]
    starts = [i for i in range(after + 1, len(lines)) if APPENDIX.match(bare[i]) or FORM.match(bare[i])]
    end = ends[0] if ends else starts[0] if starts else len(lines)
    return "\n".join(lines[:end]).strip(), "\n".join(lines[starts[0] :]).strip() if starts else "", [x for x in bare[starts[0] :] if x] if starts else []


def packed(heading, lines, limit):
    groups = []
    for x in lines:
        if groups and len("\n".join([heading, *groups[-1], x])) <= limit:
            groups[-1].append(x)
        else:
            groups.append([x])
    return ["\n".join([heading, *g]) for g in groups] or [heading]


def loop(lines, tabular, limit):
    opens = [i for i, x in enumerate(lines) if APPENDIX.match(x) or (not tabular and FORM.match(x))]
    if tabular and lines and not opens:
        opens = [0]
    out = []
    for a, b in zip(opens, [*opens[1:], len(lines)]):
        own, found = lines[a:b], APPENDIX.match(lines[a])
        label = (found and found.group(1) or "").upper() or "Khong_Ro"
        if tabular:
            heading, body = f"{own[0]}. {own[1] if len(own) > 1 else ''}".strip(". "), own[2:]
            low = [x.lower() for x in body]
            m, w = (low.index(x) if x in low else None for x in ("lao động nam", "lao động nữ"))
            if m is not None and w is not None and m < w:
                made = [(f"P_Phu_Luc_{label}_Bang_Nam", f"{heading}. Lao động nam", "appendix_table", body[m + 1 : w], "Nhom"), (f"P_Phu_Luc_{label}_Bang_Nu", f"{heading}. Lao động nữ", "appendix_table", body[w + 1 :], "Nhom")]
            else:
                made = [(f"P_Phu_Luc_{label}", heading, "appendix_list", body, "Nhom")]
        elif found:
            made = [(f"P_Phu_Luc_{label}", own[0], "appendix", own[1:], "Nhom")]
        else:
            form = FORM.match(own[0])
            code = form.group(2).upper()
            made = [(f"P_Phu_Luc_{code[2:]}_Mau_{form.group(1)}_{code}", own[0], "appendix_form", own[1:], "Phan")]
        for base, heading, kind, body, suffix in made:
            texts = packed(heading, body, limit)
            out += [(base if len(texts) == 1 else f"{base}_{suffix}_{i:02d}", base, heading, kind, t) for i, t in enumerate(texts, 1) if len(t) >= 20]
    return [(i, *x) for i, x in enumerate(out, 1)]


def test_appendices_equal_a_loop(spark):
    rng = random.Random(5)
    kinds = ["Điều 1. Tên", "  Điều 22a. Khác", "Nơi nhận: ban", "TM. CHÍNH PHỦ", "BỘ TRƯỞNG", "PHỤ LỤC I", "Phụ lục iia", " PHỤ LỤC", "PHỤ LỤC 2 . ", "Mẫu số 01/PLIII", "mẫu số 2 plv", "Lao động nam", "lao động NỮ", "", "  ", "BẢNG 1", "x" * 70]
    texts = [None, "", "PHỤ LỤC I\nx", "Điều 1. a\nPHỤ LỤC", "Điều 1. a\nMẫu số 1/PLI\n" + "dòng\n" * 30, "Điều 1. a\nPHỤ LỤC II\nTên bảng\nLao động nam\n" + "năm 2021 60 tuổi 3 tháng\n" * 9 + "Lao động nữ\n" + "năm 2021 55 tuổi 4 tháng\n" * 9]
    texts += ["\n".join(rng.choice(kinds) if rng.random() < 0.5 else "từ " * rng.randrange(1, 12) for _ in range(rng.randrange(1, 45))) for _ in range(250)]
    texts += ["\n".join(["Điều 1. a", *[rng.choice(kinds[5:]) for _ in range(30)]]) for _ in range(100)]
    df = spark.createDataFrame([(i, i % 2 == 1, t) for i, t in enumerate(texts)], "doc_id int, tabular boolean, text string")
    lines = A.split_lines(df)
    got = {r["doc_id"]: (r["main"], r["appendix"]) for r in A.split_texts(lines).collect()}
    made = {}
    for limit in (60, 200):
        for r in A.blocks(lines, F.lit("P"), limit, tabular=F.col("doc_id") % 2 == 1).collect():
            made.setdefault((limit, r["doc_id"]), []).append(tuple(r)[1:])
    for i, t in enumerate(texts):
        if t is None:
            assert i not in got
            continue
        main, appendix, rows = parts(t)
        assert got[i] == (main, appendix)
        for limit in (60, 200):
            assert sorted(made.get((limit, i), [])) == loop(rows, i % 2 == 1, limit)
    assert A.blocks(A.split_lines(df.limit(0)), F.lit("P"), 60).count() == 0

"""Units, pieces and chunks of numbered texts against loops over lines."""

import random
import re

from pyspark.sql import functions as F

from gneiss.operators import units as U

HEADS = [("part", r"(?i)^PHẦN\s+(.+)$"), ("chapter", r"(?i)^CHƯƠNG\s+([IVXLCDM0-9]+[A-ZĐ]?)\.?\s*.*$"), ("section", r"(?i)^MỤC\s+([IVXLCDM0-9]+)\.?\s*.*$"), ("article", r"^Điều\s+(\d+[A-Za-z]?)\.\s*.*$")]
RANK = {"part": 0, "chapter": 1, "section": 2}


def loop_units(text):
    lines = text.strip().split("\n")
    context, head, out, open_ = {}, None, [], {}
    for i, line in enumerate([*lines, None]):
        found = next(((k, m.group(1)) for k, p in HEADS if (m := re.match(p, line.strip()))), None) if line is not None else ("end", "")
        bare = re.sub(r"^[\s\"'`“”‘’\-–—•]+", "", line or "").strip()
        clause, point = re.match(r"^(\d+)\.(?!\d)\s+.*$", bare), re.match(r"(?i)^([a-zđ](?:\.?\d+)?)\)\s+.*$", bare)
        closes = ["point", "clause", "article"] if found else ["point", "clause"] if clause and head else ["point"] if point and head else []
        for level in closes:
            if level in open_:
                start, c, p, number = open_.pop(level)
                body = "\n".join(lines[start:i]).strip()
                if body:
                    out.append((level, start, i, number, c, p, body))
        if found:
            if found[0] in RANK:
                context = {k: v for k, v in context.items() if RANK[k] < RANK[found[0]]} | {found[0]: found[1]}
            head = found[1] if found[0] == "article" else None
            current = None
            if head:
                open_["article"] = (i, None, None, (head, *[context.get(k) for k in RANK]))
                number = open_["article"][3]
        elif clause and head:
            current = clause.group(1)
            open_["clause"] = (i, current, None, number)
        elif point and head:
            open_["point"] = (i, current, point.group(1), number)
    return sorted((level, s, e, *number, c, p, t) for level, s, e, number, c, p, t in out)


def made_text(rng):
    starts = ["Điều {}. tên ", "Điều {}.", "{}. ", "a) ", "đ) ", "b.{}) ", "B) ", "1.{} ", "- {}. ", "“c) ", "", "", "~ ", "PHẦN {}", "CHƯƠNG {} x", "Mục {}.", "  ", "dieu {}. "]
    return "\n".join(rng.choice(starts).format(rng.randrange(1, 9)) + " ".join(rng.choice(["từ", "of.", "x;", "y"]) for _ in range(rng.randrange(5))) for _ in range(rng.randrange(40)))


def test_units_equal_a_loop(spark):
    rng = random.Random(1)
    texts = [made_text(rng) for _ in range(120)] + ["", "\n \n", "Điều 1. một", "a) b\n1. c", "Điều 1. x\n\n\nCHƯƠNG 2\n\nĐiều 2. y\n\n"]
    df = spark.createDataFrame([*enumerate(texts), (999, None), (0, None)], "doc_id long, text string").where("not (doc_id = 0 and text is null)").withColumn("pos", F.lit(7)).withColumn("kind", F.lit("x"))
    rows = U.parse_units(U.with_places(U.read_lines(df))).collect()
    for i, text in enumerate(texts):
        got = sorted((r["level"], r["start"], r["end"], r["article"], r["part"], r["chapter"], r["section"], r["clause"], r["point"], r["text"]) for r in rows if r["doc_id"] == i)
        assert sorted(map(str, got)) == sorted(map(str, loop_units(text))), repr(text)
    assert U.parse_units(U.with_places(U.read_lines(df.limit(0)))).count() == 0
    starts = {(r["doc_id"], r["level"], r["start"]) for r in rows}
    assert all(r["level"] == "article" or (r["doc_id"], "article" if r["level"] == "clause" or r["clause"] is None else "clause", r["parent_start"]) in starts for r in rows)


def test_headings_go_on(spark):
    text = "PHẦN một\nhai\n\nba\nCHƯƠNG 1\nĐiều 1. x\nCHƯƠNG 2 bốn\n1. năm"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = U.headings(U.with_places(U.read_lines(df))).orderBy("start").collect()
    assert [(r["start"], r["level"], r["number"], r["heading"]) for r in got] == [(0, "part", "một", "PHẦN một hai ba"), (4, "chapter", "1", "CHƯƠNG 1"), (6, "chapter", "2", "CHƯƠNG 2 bốn 1. năm")]


def loop_pack(units, limit):
    out = []
    for u in units:
        if out and len(out[-1]) + 1 + len(u) <= limit:
            out[-1] += "\n" + u
        else:
            out.append(u)
    return out


def loop_split(text, limit):
    text = text.strip()
    if not text:
        return []
    if len(text) <= limit:
        return [text]
    for boundary in (r"(?m)^(?=\d+\.\s)", r"(?m)^(?=[a-zđ]\.\d+\)\s)", r"(?m)^(?=[a-zđ]\)\s)", r"(?<=[.;])\s+"):
        parts = [p.strip() for p in re.split(boundary, text) if p.strip()]
        if len(parts) > 1:
            return loop_pack([x for p in parts for x in loop_split(p, limit)], limit)
    out = []
    while len(text) > limit:
        cuts = [i for i in range(len(text)) if text[i].isspace()]
        cut = max((i for i in cuts if i <= limit), default=min(cuts, default=None))
        if cut is None:
            break
        out.append(text[:cut].strip())
        text = text[cut:].strip()
    return [*out, text]


def test_pieces_equal_a_loop(spark):
    rng = random.Random(2)
    words = ["a", "từ", "dài" * 9, "b.", "c;", "word", "d" * 40, "\n", "\n1. ", "\na) ", "\nb.2) ", "\nđ) ", "\n\n", "  "]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", ""]) for _ in range(rng.randrange(60))) for _ in range(250)] + ["", "   ", "x" * 300]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id long, t string")
    for limit in (20, 60):
        got = {r["id"]: r["p"] for r in df.select("id", U.split_text(F.col("t"), F.lit(limit)).alias("p")).collect()}
        assert got.pop(-1) == []
        for i, text in enumerate(texts):
            assert got[i] == loop_split(text, limit), repr(text)


def loop_compose(heading, parts):
    return "\n\n".join([heading, *[p.strip() for p in parts if p.strip()]])


def loop_chunks(heading, body, limit, sequential):
    paragraphs = [p.strip(" \t\r\n") for p in re.split(r"\n\s*\n", body) if p.strip(" \t\r\n")]
    intro, clauses = [], []
    for paragraph in paragraphs:
        for s in (s.strip() for s in re.split(r"(?im)^(?=[a-zđ]\.\d+\)\s|[a-zđ]\)\s|\d+\.\s)", paragraph)):
            clause, point = re.match(r"^(\d+)\.\s", s), re.match(r"(?i)^([a-zđ](?:\.\d+)?)\)\s", s)
            if not s:
                continue
            if clause:
                clauses.append([clause.group(1), [s], []])
            elif point:
                if not clauses:
                    clauses.append([None, [], []])
                clauses[-1][2].append([point.group(1), [s]])
            elif not clauses:
                intro.append(s)
            else:
                (clauses[-1][2][-1][1] if clauses[-1][2] else clauses[-1][1]).append(s)

    def whole(parts, kind):
        text = "\n\n".join(parts)
        if len(loop_compose(heading, [text])) <= limit or not text:
            return [(loop_compose(heading, [text]), None, [], kind)]
        return [(loop_compose(heading, [p]), None, [], kind) for p in loop_split(text, max(limit - len(heading) - 2, 100))]

    def beside(prefix, text):
        return loop_split(text, max(limit - len(loop_compose(heading, prefix)) - 2, 100)) or [""]

    if sequential:
        return whole(paragraphs, "article_sequential")
    if not clauses:
        return whole(paragraphs, "article_full")
    out = whole(intro, "article_intro") if intro else []
    for ref, own, points in clauses:
        prefix = intro + own
        if not points:
            cut = beside(intro, "\n\n".join(own))
            out += [(loop_compose(heading, [*intro, p]), ref, [], "clause" if len(cut) == 1 else "clause_part") for p in cut]
            continue
        if len(loop_compose(heading, prefix + [x for _, parts in points for x in parts])) <= limit:
            out.append((loop_compose(heading, prefix + [x for _, parts in points for x in parts]), ref, [p for p, _ in points], "clause"))
            continue
        groups = []  # of points that share a chunk; a point that fits with nothing stands alone and is cut
        for p, parts in points:
            alone = len(loop_compose(heading, prefix + parts)) > limit
            if groups and not alone and not groups[-1][1] and len(loop_compose(heading, prefix + [x for _, q in groups[-1][0] for x in q] + parts)) <= limit:
                groups[-1][0].append((p, parts))
            else:
                groups.append(([(p, parts)], alone))
        for members, alone in groups:
            if alone:
                out += [(loop_compose(heading, [*prefix, x]), ref, [members[0][0]], "clause_part") for x in beside(prefix, "\n\n".join(members[0][1]))]
            else:
                out.append((loop_compose(heading, prefix + [x for _, q in members for x in q]), ref, [p for p, _ in members], "clause_part"))
    return out


def test_chunks_equal_a_loop(spark):
    rng = random.Random(3)
    lines = ["1. ", "2. ", "a) ", "b) ", "đ.1) ", "C) ", "", "", "\n"]
    rows = []
    for i in range(150):
        body = "\n".join(rng.choice(lines) + " ".join(rng.choice(["một", "hai.", "ba;", "dài" * 8, "x"]) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(0, 14)))
        rows.append((i, str(rng.randrange(1, 6)), "Điều 1. " + "tên " * rng.randrange(4), body))
    rows += [(900, None, None, None), (901, "1", "H", ""), (902, "9", "H", " \n "), (903, "1", "h" * 300, "1. x\na) y")]
    df = spark.createDataFrame(rows, "id long, article string, heading string, body string")
    got = {}
    for r in U.chunk_articles(df, key=["id"], limit=220, sequential=("3",)).orderBy("id", "index").collect():
        got.setdefault(r["id"], []).append((r["text"], r["clause_ref"], r["point_refs"], r["chunk_type"]))
    for i, number, heading, body in rows:
        assert got[i] == loop_chunks((heading or "").strip(), body or "", 220, number == "3"), (heading, body)
    assert U.chunk_articles(df.limit(0), key=["id"]).count() == 0

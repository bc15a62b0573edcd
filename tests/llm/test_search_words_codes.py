"""Top-k search, spelling variants and vector codes against brute force in Python's integers."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import codes, common, queries, spelling, topk

VECTORS = "vec_id long, embedding array<double>, label int"
MOST = (1 << 63) - 1


def odd_vectors(spark):
    """Nulls everywhere, other lengths, zeros, repeats, ties, huge components, and columns with clashing names."""
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, -0.25, 0.1, 0.0, 1.0, 0.0, 0.0, 0.3], 1), (1, [0.5, -0.25, 0.1, 0.0, 1.0, 0.0, 0.0, 0.3], None), (2, None, 1), (3, [0.1, None, 0.2, 0.0, 0.0, 0.0, 0.0, 0.0], 1),
        (4, [nan] * 8, 2), (5, [0.0, inf, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 2), (6, [0.0] * 8, None), (None, [0.2] * 8, 3), (7, [1.0, 2.0], 3), (8, [], 3), (50, [0.2, -0.2, 0.3, -0.001, 0.0, 1.5, 0.0, 2.0], 1),
        (50, [0.2, -0.2, 0.3, -0.001, 0.0, 1.5, 0.0, 2.0], 1), (51, [0.5, -0.25, 0.1, 0.0, 1.0, 0.0, 0.0, 0.3], 1), (100, [-0.5, 0.25, 0.1, 0.0, -1.0, 0.0, 0.0, -0.3], 4),
    ]
    df = spark.createDataFrame(rows, VECTORS)
    return df, df.select("*", *[F.lit(0).alias(c) for c in ("id", "row", "w", "v", "i", "j", "score", "code", "error", "size")])


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def loop_top(rows, k, every=50):
    found = []
    for q, v, _ in rows:
        if q is None or q % every or not usable(v):
            continue
        a = [math.floor(256 * x) for x in v]
        scores = sorted((-sum(x * math.floor(256 * y) for x, y in zip(a, w, strict=False)), c) for c, w, _ in rows if c is not None and c != q and usable(w))
        found += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scores[:k])]
    return sorted(found)


def test_top_k_equals_a_loop(spark):
    plain, clash = odd_vectors(spark)
    rows = [tuple(r) for r in plain.collect()]
    for k in (1, 3, 50):
        for cells in (topk.CELLS, 16):
            out = topk.top_k(clash.where("vec_id % 50 = 0"), clash, k=k, cells=cells)
            assert out.columns == ["query_id", "rank", "vec_id", "score"]
            assert sorted(map(tuple, out.collect())) == loop_top(rows, k)
    assert topk.top_k(clash.limit(0), clash).count() == 0 and topk.top_k(clash, clash.limit(0)).count() == 0


def test_top_k_ties_in_many_blocks(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.0, 0.5, -0.5]) for _ in range(6)], 0) for i in range(900)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    assert sorted(map(tuple, topk.top_k(df.where("vec_id % 50 = 0"), df, cells=300).collect())) == loop_top(rows, 5)


def test_top_k_of_wide_weights_and_string_ids(spark):
    rows = [("a", [1e12, -3e11]), ("b", [2e12, 1.0]), ("c", [-1e12, 5e13]), ("d", [1e300, 1.0])]
    df = spark.createDataFrame(rows, "name string, v array<double>")
    got = topk.top_k(df, df, k=3, id_col="name", vector_col="v").collect()
    whole = {n: [max(-MOST - 1, min(MOST, math.floor(256 * x))) for x in v] for n, v in rows}
    for q in whole:
        want = sorted(((-sum(x * y for x, y in zip(whole[q], whole[c], strict=True)), c) for c in whole if c != q))
        mine = sorted((r["rank"], r["name"], r["score"]) for r in got if r["query_id"] == q)
        assert sorted(s for *_, s in mine) == sorted(max(-MOST - 1, min(MOST, -s)) for s, _ in want)
        if all(abs(s) < MOST for s, _ in want):
            assert [n for _, n, _ in mine] == [c for _, c in want]


def test_postings_of_rare_and_common_terms():
    rng = np.random.default_rng(1)
    dense = rng.integers(-9, 9, (200, 12)) * (rng.random((200, 12)) < np.linspace(0.02, 1, 12))
    row, term = np.nonzero(dense)
    held = topk.Postings(row, term, dense[row, term], 200, np.int32)
    assert any(rows is None for rows, _ in held.lists.values()) and any(rows is not None for rows, _ in held.lists.values())
    query = rng.integers(-9, 9, 15)
    assert (held.scores(np.arange(15), query) == dense @ query[:12]).all()


def loop_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def loop_variants(counts):
    out = []
    near = {w: [v for v in counts if abs(len(v) - len(w)) <= 1 and v != w and loop_near(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = top if top is not None and counts[top] >= 2 * counts[w] else None
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None))
    return sorted(out)


def test_variants_equal_a_loop(spark):
    rng = random.Random(5)
    counts = {}
    while len(counts) < 700:
        counts["".join(rng.choice("abé𝒳ÿ"[: rng.choice([2, 3, 5])]) for _ in range(rng.randrange(1, 8)))] = 2 ** rng.randrange(0, 9) + rng.randrange(2)
    df = spark.createDataFrame([*counts.items(), (None, 5)], "word string, n long").repartition(3)
    got = sorted(map(tuple, spelling.group_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert got == loop_variants(counts)
    assert max(sum(1 for _ in chain(w, got)) for w in list(counts)[:50]) >= 2
    assert spelling.group_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(df, ratio=1)


def chain(word, rows):
    form = {r[0]: r[1] for r in rows}
    while word is not None:
        yield word
        word = form[word]


def test_variants_of_long_words_and_long_chains(spark):
    long = "ab" * 100_000
    counts = {long: 4, long + "a": 9, long[:5000] + "x" + long[5001:]: 2, long[1:] + "b": 1}
    ladder = "k" * 12
    for i in range(30):
        counts[ladder + "".join("xy"[(i >> b) & 1] for b in range(1)) + "z" * i] = 2**i
    got = {r["word"]: r for r in spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got[long]["form"] == long + "a" and got[long]["n_near"] == 2 and got[long[:5000] + "x" + long[5001:]]["root"] == long + "a"
    short = {w: n for w, n in counts.items() if len(w) < 100}
    assert sorted(tuple(got[w]) for w in short) == sorted((w, f, r, n, m, k) for w, f, r, n, m, k in loop_variants(short))


def test_variants_broadcast_no_table(spark, monkeypatch):
    """Settled tables are as large as the corpus; by their compressed bytes Spark would broadcast those of a million words."""
    plans = []

    def settle(df, name):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.settle(df, name)

    monkeypatch.setattr(spelling, "settle", settle)
    counts = spark.createDataFrame([("abcde" + "f" * k, 3**k) for k in range(9)], "word string, n long")
    settle(spelling.group_variants(counts), "out")
    assert len(plans) > 4 and any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]


def test_deletion_keys_are_distinct():
    place, keys = spelling.deletion_keys(["aaa", "", "ab", "aab"])
    assert [int((place == i).sum()) for i in range(4)] == [2, 1, 3, 3]
    assert len(set(keys[place == 2]) & set(keys[place == 3])) == 1  # "ab"
    assert len(set(keys[place == 0]) & set(keys[place == 3])) == 1  # "aa"


def test_one_apart_equals_a_loop():
    rng = random.Random(8)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(8))) for _ in range(2))
        assert spelling.one_apart(a, b) == loop_near(a, b), (a, b)


def loop_words(rows, min_count=3):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= min_count}


def test_op12_on_odd_texts(spark, tmp_path):
    rng = random.Random(6)
    stems = ["".join(rng.choice("abcdÉé×") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(stems) for _ in range(60))) for i in range(200)] + [(None, "ABCDE abcde AbCdE_abcde1abcde"), (1, None), (2, ""), (3, "1 2 3"), (4, "Abcdé " * 40_000), (4, "Abcdé " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("run", F.lit(2)).withColumn("h", F.lit(3))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    counts = loop_words(rows)
    assert len(counts) > 40
    got = queries.QUERIES["op12_spelling_variants"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str) == sorted(loop_variants(counts), key=str)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.QUERIES["op12_spelling_variants"](spark, f"{tmp_path}/none").count() == 0


def loop_codes(rows, parts=4, entries=256, rounds=4):
    """id, code, error, label_error, digest of rows whose vectors have one length."""
    kept = [(i, [max(-MOST - 1, min(MOST, math.floor(1024 * x))) for x in v], label) for i, v, label in rows if usable(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1])
    cut = [slice(d * p // parts, d * (p + 1) // parts) for p in range(parts)]
    books = [[w[c] for _, w, _ in kept[:entries]] for c in cut]

    def assign(w, p):
        return min((sum((x - y) ** 2 for x, y in zip(w[cut[p]], e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for _, w, _ in kept:
                groups[assign(w, p)[1]].append(w[cut[p]])
            books[p] = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], collections.Counter()
    for i, w, label in kept:
        found = [assign(w, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), min(MOST, sum(s for s, _ in found)), label))
        by_label[label] += out[-1][2]
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=str)


def test_codes_equal_a_loop(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], rng.choice([None, 0, 1])) for i in range(150)]
    rows += [(i, [0.25, -0.25] * 4, 0) for i in range(150, 230)]  # ties: many equal vectors and entries
    rows += [(3, [0.5] * 8, None), (None, [0.1] * 8, 2), (5, None, 1), (6, [None] * 8, 1), (7, [float("inf")] * 8, 0)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    for entries, rounds in ((256, 2), (20, 4)):
        got = codes.compress(df, entries=entries, rounds=rounds)
        assert sorted(map(tuple, got.collect()), key=str) == loop_codes(rows, entries=entries, rounds=rounds)


def test_codes_of_odd_tables(spark):
    plain, clash = odd_vectors(spark)
    got = codes.compress(clash)
    rows = [tuple(r) for r in plain.collect() if r["embedding"] is None or len(r["embedding"]) == 8]
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == loop_codes(rows)
    assert codes.compress(clash.limit(0)).count() == 0
    assert codes.compress(clash.where("vec_id = 8")).first()["code"] == "00000000"  # vectors without components
    # A length that 4 does not divide, no label column, and numbers beyond 64 bits when squared.
    wide = [(i, [float(10.0 ** (i + k)) for k in range(5)], None) for i in range(14)]
    got = codes.compress(spark.createDataFrame(wide, VECTORS).drop("label"), label_col=None, entries=3, rounds=2)
    assert sorted((r[0], r[1], r[2], r[4]) for r in got.collect()) == sorted((a, b, c, e) for a, b, c, _, e in loop_codes(wide, entries=3, rounds=2))
    with pytest.raises(ValueError):
        codes.compress(plain, entries=257)


@pytest.mark.parametrize("most", [3, 1000, 1 << 20, 1 << 28, 1 << 40])
def test_intervals_hold_the_exact_values(most):
    rng = np.random.default_rng(most)
    rows, entries = rng.integers(-most, most + 1, (40, 16)), rng.integers(-most, most + 1, (30, 16))
    low, high = codes.intervals(rows, entries)
    scale = 2 ** max(0, max(abs(int(rows.max())), abs(int(rows.min())), abs(int(entries.max())), abs(int(entries.min()))).bit_length() - 16)
    exact = (entries.astype(object) ** 2).sum(axis=1)[None, :] - 2 * rows.astype(object) @ entries.astype(object).T
    for i in range(40):
        for j in range(30):
            assert int(math.floor(low[i, j] * scale * scale)) <= exact[i, j] <= int(math.ceil(high[i, j] * scale * scale))


def test_nearest_takes_the_lower_of_ties():
    rng = np.random.default_rng(2)
    rows = rng.integers(-3, 4, (500, 4))
    entries = rng.integers(-3, 4, (256, 4))
    index, distance = codes.nearest(rows, entries)
    exact = ((rows[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    assert (index == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    index, distance = codes.nearest(np.full((2, 4), 1 << 33), np.array([[0] * 4, [1 << 33] * 4, [1 << 33] * 4]))
    assert index.tolist() == [1, 1] and distance.tolist() == [0, 0]

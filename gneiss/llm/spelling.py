"""Spelling variants of a vocabulary by a symmetric-delete join.

Every word emits a hash of itself and of each of its distinct single deletions. Two words that differ by one inserted, deleted or
replaced code point share one of these keys, so an equi-join finds all of them; what it finds is verified by the exact distance.
A key is shared by few words whatever the corpus: those that one insertion makes of one string. Words are numbered, so long words
are neither copied for each of their keys nor shuffled with them, and all of a word's keys come from one pass over its letters.

A word's form is its most frequent near word, if that is frequent enough. Forms lead to forms; as a form has at least twice the
occurrences, chains end after a logarithm of the corpus, and doubling the pointers ends them in a logarithm of that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, lower_ascii, settle, shuffled, table
from .jaccard import _mix, _powers

LETTERS = "[a-zÀ-ÿ]+"


def runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, run: every maximal run of letters of every text, A-Z in lower case. A null or empty text has none."""
    return docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(LETTERS), F.lit(0))).alias("run"))


def count_words(found: DataFrame, *, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """word, n of the words (column word) that are long and frequent enough; counted before the shuffle and after it."""
    return found.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, key) of each word itself and its distinct single deletions. Keys are 64-bit hashes."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    power, inverse = _powers(1 << max(12, int(len(codes) + 2).bit_length()))
    prefix = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes + np.uint64(1)) * power[: len(codes)], out=prefix[1:])
    end = np.cumsum(size)
    start = end - size
    whole = _mix((prefix[end] - prefix[start]) * inverse[start] + size.astype(np.uint64))
    at = np.arange(len(codes))
    own = np.repeat(np.arange(len(words)), size)
    s, e = start[own], end[own]
    # The letters before the deleted one stay where they are, those after it move one place to the left.
    less = (prefix[at] - prefix[s]) * inverse[s] + (prefix[e] - prefix[at + 1]) * inverse[s + 1]
    keys = np.concatenate([whole, _mix(less + (size[own] - 1).astype(np.uint64))])
    place = np.concatenate([np.arange(len(words)), own])
    order = np.lexsort((keys, place))
    place, keys = place[order], keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (keys[1:] != keys[:-1])
    return place[new], keys[new]


def one_apart(a: str, b: str) -> bool:
    """Whether the words differ by exactly one code point inserted, deleted or replaced, in time linear in their length."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    same, step = 0, len(a)  # letters at the front that are the same
    while step:
        if a[same : same + step] == b[same : same + step]:
            same += step
        step //= 2
    while same < len(a) and a[same] == b[same]:
        same += 1
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b (numbers, a < b) of the words (number, word) that differ by exactly one code point inserted, deleted or replaced."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                place, keys = deletion_keys(b.column(1).to_pylist())
                rows = pa.table({"number": b.column(0).take(pa.array(place)), "key": pa.array(keys.view(np.int64))})
                yield from rows.to_batches(max_chunksize=1 << 16)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [one_apart(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    keys = words.select("number", "word").mapInArrow(work, "number long, key long")
    met = keys.select(F.col("number").alias("a"), "key").join(shuffled(keys.select(F.col("number").alias("b"), "key")), "key").where("a < b").select("a", "b").distinct()
    x, y = (shuffled(words.select(F.col("number").alias(end), F.col("word").alias(name))) for end, name in (("a", "x"), ("b", "y")))
    both = met.join(x, "a").join(y, "b")
    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def follow(forms: DataFrame) -> DataFrame:
    """number, root: where the pointers (number, form) lead in the end. They have no cycles. Each round doubles the steps taken."""
    jumps = settle(forms.select("number", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while jumps.where("moved").limit(1).count():
        onward = jumps.select(F.col("number").alias("root"), F.col("root").alias("next"))
        after = settle(jumps.join(shuffled(onward), "root", "left").select("number", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(jumps)
        jumps = after
    return jumps.drop("moved")


def group_variants(counts: DataFrame, *, ratio: int = 2) -> DataFrame:
    """One row for each word of counts (word, n; words are distinct): word, form, root, n, n_near, form_n.

    form: the near word of largest n (ties: the smallest in code-point order) if that n is `ratio` (2 or more) times the word's or
    larger, else null, as form_n is; root: the last form, or the word itself; n_near: how many near words there are. A null word
    takes no part. Words differ as strings of code points: no case or accent is folded here. No words, no rows.
    """
    if ratio < 2:
        raise ValueError("a form has at least twice the word's occurrences")
    words = settle(counts.where("word is not null").select("word", "n", F.monotonically_increasing_id().alias("number")), "words")
    pairs = settle(near_pairs(words), "near")
    other = words.select(F.col("number").alias("b"), F.col("n").alias("m"), F.col("word").alias("near"))
    ends = pairs.union(pairs.select("b", "a")).join(shuffled(other), "b")
    best = ends.groupBy(F.col("a").alias("number")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near", "b")).alias("best"))
    linked = words.join(shuffled(best), "number", "left")
    has = F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False))
    formed = settle(linked.select("number", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.b")).alias("to"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    roots = follow(formed.where("to is not null").select("number", F.col("to").alias("form")))
    named = roots.join(shuffled(words.select(F.col("number").alias("root"), F.col("word").alias("root_word"))), "root").select("number", "root_word")
    return formed.join(shuffled(named), "number", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract deletes one letter of the runs of a document whose hash 97 divides. A null id is written as nothing."""
    found = runs(table(spark, sf_dir, "documents"))
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = F.pmod("h", F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return group_variants(count_words(found.withColumn("h", h).select(F.when(F.col("h") % 97 == 0, less).otherwise(F.col("run")).alias("word"))))


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
), runs AS (
  SELECT doc_id, run, count(*) AS n, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS x FROM found GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM runs, crc
), changed AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n, length(word) AS size FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), places AS (
  SELECT word, size, unnest(range(1, size + 1)) AS p FROM words
), masked AS MATERIALIZED (
  SELECT DISTINCT word, size, p, word[1:p - 1] || '*' || word[p + 1:] AS replaced, word[1:p - 1] || word[p + 1:] AS shorter FROM places
), near AS MATERIALIZED (
  SELECT a.word AS a, b.word AS b FROM masked a JOIN masked b ON a.replaced = b.replaced AND a.word <> b.word
  UNION SELECT a.word, b.word FROM masked a JOIN words b ON a.shorter = b.word
  UNION SELECT b.word, a.word FROM masked a JOIN words b ON a.shorter = b.word
), ranked AS (
  SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r, count(*) OVER (PARTITION BY a) AS n_near FROM near JOIN words ON b = word
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 2 * w.n THEN b END AS form, CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = a AND r = 1
), chain AS (
  SELECT word, word AS root FROM forms UNION SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON f.word = c.word JOIN forms e ON c.root = e.word AND e.form IS NULL
"""

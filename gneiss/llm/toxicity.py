"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Every text is lower-cased, put between spaces, and turned into the set of its hashed character n-grams. How many toxic and
clean training documents have each n-gram is counted over all training rows, in Spark; the log ratio of the smoothed shares
is the feature's value, and n-grams whose ratio is no further from zero than chance (`min_z`) are dropped. A logistic regression over
those values is fitted on the driver on a bounded sample of the training rows, chosen by hash of the id: about `max_fit_rows` of them,
or fewer, so that they have about `max_fit_entries` n-grams in all, a number that the counts give beforehand.
Scoring is one pass over the documents: the weights are one array of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table

SIZES = (3, 4, 5)
BITS = 20
#: Characters hashed at a time; longer texts are cut with an overlap, so that none of their n-grams is lost.
CHUNK = 1 << 20


def _segments(texts: list[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Texts between spaces in groups of about CHUNK characters, with their places in the list."""
    group, at, size = [], [], 0
    for i, text in enumerate(texts):
        full = f" {(text or '').lower()} "
        for a in range(0, max(len(full) - max(SIZES) + 1, 1), CHUNK):
            part = full[a : a + CHUNK + max(SIZES) - 1]
            group.append(part)
            at.append(i)
            size += len(part)
            if size >= CHUNK:
                yield group, at
                group, at, size = [], [], 0
    if group:
        yield group, at


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting in place: several times as fast as hashing where most values differ."""
    values.sort()
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def grams(texts: list[str | None], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, bucket) of each distinct n-gram of each text; only buckets marked in `keep`, if given."""
    found = []
    for group, at in _segments(texts):
        chars = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        doc = np.repeat(np.arange(len(group), dtype=np.int64), [len(x) for x in group])
        mixed = np.zeros(len(chars), dtype=np.uint32)
        weight, own = 1, []
        for n in range(1, max(SIZES) + 1):
            weight = weight * 0x01000193 & 0xFFFFFFFF
            m = len(chars) - n + 1
            if m <= 0:
                break
            mixed = mixed[:m] * np.uint32(0x85EBCA6B) + chars[n - 1 :] * np.uint32(weight | 1)
            if n in SIZES:
                bucket = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
                whole = doc[:m] == doc[n - 1 :]
                if keep is not None:
                    whole &= keep[bucket]
                i = np.flatnonzero(whole)
                own.append((np.array(at, dtype=np.int64)[doc[i]] << BITS) | bucket[i])
        if own:
            found.append(_distinct(np.concatenate(own)))
    pairs = found[0] if len(found) == 1 else _distinct(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of about CHUNK characters of whole texts, so that the n-grams of a few texts are held at a time."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "") + 2
        if size >= CHUNK:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


class Model:
    """weights: a value for each bucket, 0 for most; a text's score is the logistic of their sum and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.keep = weights, bias, weights != 0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        for a, b in _parts(texts):
            doc, bucket = grams(texts[a:b], self.keep)
            total[a:b] += np.bincount(doc, self.weights[bucket], b - a)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _regression(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, *, ridge: float = 0.02, rounds: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty, by Adam over all rows at once. feature: places in `value`."""
    w, bias = np.zeros(len(value)), 0.0
    moments = np.zeros((2, len(value) + 1))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(doc, (w * value)[feature], len(label)), -500, 500)))
        off = (p - label) / len(label)
        slope = np.append(np.bincount(feature, off[doc], len(value)) * value + ridge * w / len(label), off.sum())
        moments[0] += 0.1 * (slope - moments[0])
        moments[1] += 0.01 * (slope**2 - moments[1])
        move = rate * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-12)
        w -= move[:-1]
        bias -= move[-1]
    return w, bias


def gram_counts(labelled: DataFrame) -> DataFrame:
    """bucket, clean, toxic: how many texts of each label have each hashed n-gram. labelled: text, label (0 or 1)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), dtype=np.int64)
        for b in batches:
            texts, labels = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            for first, end in _parts(texts):
                doc, bucket = grams(texts[first:end])
                label = labels[first:end][doc]
                for k in (0, 1):
                    seen[k] += np.bincount(bucket[label == k], minlength=1 << BITS)
        i = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(seen[0][i]), pa.array(seen[1][i])], names=["bucket", "clean", "toxic"])

    each = labelled.select("text", "label").mapInArrow(count, "bucket int, clean long, toxic long")
    return each.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def fit(labelled: DataFrame, *, max_fit_rows: int = 20_000, max_fit_entries: int = 4_000_000, min_docs: int = 5, min_z: float = 4.0, smooth: float = 1.0) -> Model:
    """labelled: id, text, label (0 or 1); max_fit_rows and max_fit_entries bound the sample of the regression. Without rows of both labels the model gives every text the share of label 1 (at most 0.49 if there is none)."""

    n = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    if not clean or not toxic:
        share = min(max(toxic / max(clean + toxic, 1), 0.01), 0.49 if not toxic else 0.99)
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    counted = gram_counts(labelled)
    ratio = F.log((F.col("toxic") + smooth) / (toxic + 2 * smooth)) - F.log((F.col("clean") + smooth) / (clean + 2 * smooth))
    spread = F.sqrt(1 / (F.col("toxic") + smooth) + 1 / (F.col("clean") + smooth))
    seen = F.col("toxic") + F.col("clean")
    rows = counted.where(seen >= min_docs).select("bucket", seen.alias("n"), ratio.alias("r"), spread.alias("s")).where(F.abs("r") >= min_z * F.col("s")).select("bucket", "n", "r").toArrow()  # at most 2 ** BITS rows
    ratios = np.zeros(1 << BITS)
    ratios[rows.column("bucket").to_numpy()] = rows.column("r").to_numpy()
    keep = ratios != 0

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for first, end in _parts(texts):
                doc, bucket = grams(texts[first:end], keep)
                cuts = np.searchsorted(doc, np.arange(end - first + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(bucket.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists, b.column(1).slice(first, end - first)], names=["buckets", "label"])

    entries = int(rows.column("n").to_numpy().sum())  # of all training rows
    part = min(1.0, max_fit_rows / (clean + toxic), max_fit_entries / max(entries, 1))
    sample = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(part * (1 << 30))).select("text", "label").mapInArrow(chosen, "buckets array<int>, label int").toArrow()
    label = sample.column("label").to_numpy().astype(float)
    lists = sample.column("buckets").combine_chunks()
    doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    bucket = lists.flatten().to_numpy()
    used = np.flatnonzero(np.bincount(bucket, minlength=1 << BITS))
    feature = np.searchsorted(used, bucket)
    w, bias = _regression(doc, feature, ratios[used], label)
    weights = np.zeros(1 << BITS)
    weights[used] = w * ratios[used]
    return Model(weights, bias)


def label_rows(docs: DataFrame, labels: DataFrame, learn, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, text, label of the documents for which `learn` (a column over docs) holds. Rows with a null id or label, or a label
    other than 0 and 1, are not learnt from; of several labels of one id the largest counts."""
    own = docs.where(learn).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    by_id = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    return own.join(by_id.hint("shuffle_hash"), "id")


def with_scores(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of docs and the score of each row's text; null and empty texts have one too. A column of docs with the score's name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        return pd.Series(shared.value.scores(text.tolist()))

    return docs.withColumn(score_col, score(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, learn, **columns: str) -> DataFrame:
    """Fits on the labelled documents for which `learn` holds and scores all documents."""
    return with_scores(docs, fit(label_rows(docs, labels, learn, **columns)))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    scored = toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

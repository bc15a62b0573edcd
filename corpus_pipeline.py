"""From documents to packed training sequences, one operator a stage.

Toxic documents go; lines that spread over many sites keep their first place only; of each group of near copies one document
stays; documents contaminated by the benchmark go; what is left is packed. Each stage's rows are written as Parquet in the
shared folder and read again by the next. All stages but the last return the columns of documents.

Rows may have nulls in any column. A null text is not toxic, has no lines, is no copy of anything and is clean, so it stays
and is packed as an empty document; so is an empty one. A row that says the same as another in id and text is a copy of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import fold, fresh, settle, table
from gneiss.llm.decontamination import contamination
from gneiss.llm.jaccard import similar_components
from gneiss.llm.line_dedup import dedup_lines
from gneiss.llm.packing import pack_documents
from gneiss.llm.toxicity import fit, label_rows, with_scores

#: Documents are linked from this share of common five-word shingles on.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 1/2; learnt from labelled ones outside the held-out fold."""
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = fit(label_rows(docs, table(spark, sf_dir, "labels"), ~held_out))
    score = fresh(docs, "score")
    return with_scores(docs, model, score_col=score).where(F.col(score) < 0.5).drop(score)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site lines, except at their first place; n_chars follows. A document of nothing but such lines, all of
    which stay elsewhere, goes."""
    found = dedup_lines(docs)
    changed = F.col("__n_removed") > 0  # dedup_lines' own column
    found = found.where(~(changed & (F.trim("text") == "")))
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    found = similar_components(docs, width=SHINGLE_WORDS, threshold=SIMILARITY)
    at, ids, own, hashed = (fresh(docs, c) for c in ("at", "ids", "own", "hashed"))
    kept = found.where("representative").select(F.col("text_hash").alias(hashed), F.xxhash64("doc_id").alias(own)).distinct()
    # Hashes are never null, so that repeated rows go and the join is made in one exchange of the texts.
    once = docs.withColumn(at, F.xxhash64("text")).withColumn(ids, F.xxhash64("doc_id")).dropDuplicates([at, ids])
    return once.join(kept, (F.col(at) == F.col(hashed)) & (F.col(ids) == F.col(own)), "left_semi").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are less than a twentieth."""
    scan = contamination(table(spark, sf_dir, "benchmark"))
    found = fresh(docs, "found")
    return docs.withColumn(found, scan("text")).where(~F.col(f"{found}.contaminated")).drop(found)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of what is left, in sequences of 2,048."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Classifiers and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

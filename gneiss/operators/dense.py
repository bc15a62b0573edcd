"""Dense retrieval: exact top k by inner product, and rank fusion."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(vectors: DataFrame, queries: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", most_queries: int = 100_000) -> DataFrame:
    """query_key, key, score (rounded to 6 places), rank: the k nearest rows of each query, itself left out.

    Queries are a block that every task holds (its size is checked); each task keeps its k best for each query, so what is
    shuffled is tasks x queries x k rows, whatever the number of vectors.
    """
    rows = queries.select(F.col(query_key), F.col(vector)).limit(most_queries + 1).toArrow()
    if rows.num_rows > most_queries:
        raise ValueError(f"at most {most_queries} queries a call")
    ids = rows.column(0).to_numpy()
    points = np.array(rows.column(1).to_pylist(), dtype=np.float64).reshape(len(ids), -1)
    block = vectors.sparkSession.sparkContext.broadcast((ids, points))
    schema = f"{query_key} {queries.schema[query_key].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double"

    def nearest(batches):
        own, asked = block.value
        for b in batches:
            at = b.column(0).to_numpy()
            if not len(at) or not len(own):
                continue
            x = b.column(1).flatten().to_numpy().astype(np.float64).reshape(len(at), -1)
            scores = np.round(asked @ x.T, 6)
            scores[own[:, None] == at[None, :]] = -np.inf
            m = min(k, len(at))
            worst = -np.partition(-scores, m - 1, axis=1)[:, m - 1 : m]
            i, j = np.nonzero((scores >= worst) & (scores > -np.inf))
            yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(at[j]), pa.array(scores[i, j])], names=[query_key, key, "score"])

    found = vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(nearest, schema)
    best = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def fuse(lists: list[DataFrame], query_key: str, key: str, *, k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_key, key, rank from 1): score is the sum of 1 / (constant + rank)."""
    each = reduce(DataFrame.unionByName, [x.select(query_key, key, (1.0 / (constant + F.col("rank"))).alias("part")) for x in lists])
    total = each.groupBy(query_key, key).agg(F.round(F.sum("part"), 8).alias("score"))
    best = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return total.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

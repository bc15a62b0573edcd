"""Exact top-k by integer inner product, accumulated exhaustively one term after another.

A vector is a sparse row: its terms are the positions whose weight, floor(scale * x), is not 0. Rows are numbered and dealt into
blocks by a hash of their number, so blocks are of a size whatever ids and vectors repeat, and each block of queries meets each
block of candidates once. There the candidates' weights become postings by term; every query scatters the weighted postings of
its terms into one dense array of scores, from which a partition selects the best k. Spark merges the blocks' selections.

Nothing is broadcast or collected: the shuffle carries each candidate once for every block of queries and each query once for
every block of candidates. Both blocks are as large as `cells` allows, so that grows with rows * queries / cells and the work in
tasks, rows * queries * terms, outweighs it.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

#: Weights of a block of candidates; a block of queries has an eighth.
CELLS = 1 << 20
#: Blocks of candidates, if they have LEAST rows or more, so that a small table keeps more than one task busy.
SPREAD, LEAST = 32, 512


def weights(vectors: DataFrame, *, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """row (a number), id, w: floor(scale * x) of each component x as a double, at the limits of a long beyond them. Rows with a
    null id, a null vector, or null or non-finite components are left out."""
    v = F.col("v")
    doubles = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    usable = doubles.where(F.col("id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return usable.select(F.monotonically_increasing_id().alias("row"), "id", F.transform(v, lambda x: F.floor(x * scale)).alias("w"))


def _sparse(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of each weight that is not 0, by row and term."""
    lists = lists.combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    term = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    weight = lists.flatten().to_numpy(zero_copy_only=False)
    has = weight != 0
    return row[has], term[has], weight[has]


def _kind(a: np.ndarray, b: np.ndarray, terms: int) -> type:
    """The narrowest kind that holds every sum of `terms` products; Python's integers beyond 64 bits."""
    largest = [max(abs(int(x.max())), abs(int(x.min()))) if len(x) else 0 for x in (a, b)]
    bound = largest[0] * largest[1] * max(terms, 1)
    return np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object


class Postings:
    """The rows of a block by term. A term that most rows have is kept as one array over all of them."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, kind: type):
        self.rows, self.kind = rows, kind
        order = np.argsort(term, kind="stable")
        row, term, weight = row[order], term[order], weight[order].astype(kind)
        cuts = [0, *(np.flatnonzero(np.diff(term)) + 1).tolist(), len(term)]
        self.lists: dict[int, tuple[np.ndarray | None, np.ndarray]] = {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if 2 * (b - a) > rows:
                full = np.zeros(rows, dtype=kind)
                full[row[a:b]] = weight[a:b]
                self.lists[int(term[a])] = None, full
            else:
                self.lists[int(term[a])] = row[a:b], weight[a:b]

    def scores(self, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The inner product of every row with one query, term by term."""
        out = np.zeros(self.rows, dtype=self.kind)
        for t, w in zip(terms.tolist(), weight.astype(self.kind), strict=True):
            rows, values = self.lists.get(t, (None, None))
            if values is None:
                continue
            if rows is None:
                out += w * values
            else:
                out[rows] += w * values
        return out


def best_places(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, highest first, ties to the smaller place."""
    places = np.arange(len(scores))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        places = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    return places[np.argsort(-scores[places], kind="stable")]


def _search(k: int, own_id: bool):
    limit = (1 << 63) - 1

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        """The best k of one block of candidates for each query of one block."""
        out: list[tuple] = []
        if queries.num_rows and candidates.num_rows:
            candidates = candidates.sort_by("id")
            ids = candidates.column("id").to_numpy()
            row, term, weight = _sparse(candidates.column("w"))
            q_row, q_term, q_weight = _sparse(queries.column("w"))
            cuts = np.searchsorted(q_row, np.arange(queries.num_rows + 1))
            kind = _kind(weight, q_weight, int(np.diff(cuts).max()))
            postings = Postings(row, term, weight, len(ids), kind)
            for i, (number, own) in enumerate(zip(queries.column("row").to_pylist(), queries.column("id").to_pylist(), strict=True)):
                at = slice(cuts[i], cuts[i + 1])
                scores = postings.scores(q_term[at], q_weight[at])
                first, last = (int(np.searchsorted(ids, own, side=s)) for s in ("left", "right")) if own_id else (0, 0)
                places = best_places(scores, k + last - first)
                places = places[(places < first) | (places >= last)][:k]
                out += [(number, own, int(p), max(-limit - 1, min(limit, int(scores[p])))) for p in places]
        number, own, place, score = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({
            "row": pa.array(number, pa.int64()), "query_id": pa.array(own, queries.schema.field("id").type),
            "found_id": candidates.column("id").take(pa.array(place, pa.int64())), "score": pa.array(score, pa.int64()),
        })

    return search


def top_k(queries: DataFrame, candidates: DataFrame, *, k: int = 5, scale: float = 256.0, exclude_own: bool = True, cells: int = CELLS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the id and score of the k candidates with the highest integer inner products, ties to the smaller
    id, for each row of queries.

    With exclude_own, candidates with the query's own id are passed over. Rows without a usable vector (see `weights`), and those
    with a null id, take no part on either side. A vector has no terms beyond its end, so vectors of several lengths meet in the
    positions that both have; one without terms scores 0 everywhere. Repeated candidates each take a rank, repeated queries are
    each answered. With fewer than k candidates all are returned, without any (an empty table) no row. Scores are exact; those
    that a long can't hold are at its limit, in an order that is exact within a block.
    """
    kind = candidates.schema[id_col].dataType.simpleString()
    own = queries.schema[id_col].dataType.simpleString()
    left, right = (settle(weights(df, scale=scale, id_col=id_col, vector_col=vector_col), "weights") for df in (queries, candidates))
    size = right.agg(F.count("*").alias("n"), F.sum(F.size("w")).alias("cells")).first()
    most = max(1, int(cells / max(1.0, (size["cells"] or 0) / max(1, size["n"]))))
    columns = max(ceil(size["n"] / most), min(SPREAD, ceil(size["n"] / LEAST)), 1)
    rows = max(ceil(left.count() / max(1, most // 8)), 1)
    block = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = left.select("row", "id", "w", block(rows, 1).alias("i"), every(columns).alias("j")).groupBy("i", "j")
    held = right.select("id", "w", every(rows).alias("i"), block(columns, 2).alias("j")).groupBy("i", "j")
    found = asked.cogroup(held).applyInArrow(_search(k, exclude_own), f"row long, query_id {own}, found_id {kind}, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "found_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("found_id").alias(id_col), "score")


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors.where("vec_id % 50 = 0"), vectors)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are sampled from the vectors. Each vector is described by its `depth` nearest pivots in order, and
stands in the inverted list of every two of them. Two vectors that share a list share at least two pivots; the shared-pivot
count and the exact cosine then decide. Each pair is judged in one list only, that of the first two pivots that both have,
and in blocks of bounded size, so no pair is written down: a block returns how many vectors each one is linked with and a
forest that spans its links.

Equal vectors are one class with a weight, whatever their number. Pivots grow with the square root of the number of vectors,
so lists stay short; the depth grows with the logarithm of the pivots, as two vectors of one cosine share fewer of a finer set.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table
from .components import components

#: Nearest pivots of a vector: DEPTH among DEPTH_PIVOTS or fewer, more among more.
DEPTH = 7
DEPTH_PIVOTS = 179
BLOCK = 512


def valid_classes(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """cls (smallest id), weight, v: the distinct usable vectors. Null or zero vectors, and those with null or non-finite components, or of another length than the most common (of several such, the shortest), have none."""
    v = F.col("v")
    doubles = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    usable = doubles.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0) & F.col("id").isNotNull())
    common = usable.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return usable.where(F.size("v") == (common["size"] if common else 0)).groupBy("v").agg(F.min("id").alias("cls"), F.count("*").alias("weight"))


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy().reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sample_pivots(classes: DataFrame, pivots: int) -> np.ndarray:
    """About `pivots` of the distinct vectors, those with the smallest hashes: the bounded sample on which the index is fitted."""
    rows = classes.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(pivots).select("v").toArrow()
    return _unit(rows.column("v")) if rows.num_rows else np.zeros((0, 1))


def depth_for(pivots: int) -> int:
    return max(DEPTH, ceil(DEPTH * log(max(pivots, 2)) / log(DEPTH_PIVOTS)))


def describe(classes: DataFrame, pivots: np.ndarray, depth: int | None = None) -> DataFrame:
    """cls, weight, v, near: the `depth` nearest pivots, nearest first."""
    depth = depth or depth_for(len(pivots))
    shared = classes.sparkSession.sparkContext.broadcast(pivots)
    kind = classes.schema["cls"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                close = -(_unit(part.column(2)) @ points.T)
                k = min(depth, close.shape[1])
                best = np.argpartition(close, k - 1, axis=1)[:, :k]
                best = np.take_along_axis(best, np.argsort(np.take_along_axis(close, best, axis=1), axis=1, kind="stable"), axis=1)
                near = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, k), pa.int32()), pa.array(best.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), near], names=["cls", "weight", "v", "near"])

    return classes.select("cls", "weight", "v").mapInArrow(work, f"cls {kind}, weight long, v array<double>, near array<int>")


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links a[i]-b[i], those that join what wasn't joined yet."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _judge(threshold: float, min_shared: int):
    """Compares the two sides of a block; see the module's text."""

    def judge(t: pa.Table) -> pa.Table:
        """Each block of a lot: links of its left to its right side."""
        list_, i, j = (t.column(c).to_numpy() for c in ("list", "i", "j"))
        order = np.lexsort((j, i, list_))
        t = t.take(pa.array(order))
        cls, weight, tile = (t.column(c).to_numpy() for c in ("cls", "weight", "tile"))
        vectors = _unit(t.column("v"))
        near = np.sort(np.array(t.column("near").to_pylist()), axis=1)
        list_, i, j = list_[order], i[order], j[order]
        cuts = np.flatnonzero(np.diff(list_) | np.diff(i) | np.diff(j)) + 1
        out: list[tuple[int, int | None, int]] = []
        for at in np.split(np.arange(len(list_)), cuts):
            left, right = at[tile[at] == i[at[0]]], at[tile[at] == j[at[0]]]
            a, b = np.nonzero(vectors[left] @ vectors[right].T >= threshold)
            a, b = left[a], right[b]
            if i[at[0]] == j[at[0]]:
                a, b = a[a < b], b[a < b]
            if len(a):
                same = near[a][:, :, None] == near[b][:, None, :]
                shared = same.any(axis=2)
                first = np.argsort(~shared, axis=1, kind="stable")[:, :2]
                both = np.take_along_axis(near[a], first, axis=1).astype(np.int64)
                own = (shared.sum(axis=1) >= min_shared) & (both[:, 0] * (1 << 20) + both[:, 1] == list_[at[0]])
                a, b = a[own], b[own]
            if len(a):
                links = np.bincount(a - at[0], weight[b], len(at)) + np.bincount(b - at[0], weight[a], len(at))
                out += [(int(cls[at[k]]), None, int(links[k])) for k in np.flatnonzero(links)]
                out += [(x, y, 0) for x, y in _forest(cls[a], cls[b])]
        x, y, n = zip(*out, strict=True) if out else ((), (), ())
        kind = t.schema.field("cls").type
        return pa.table({"a": pa.array(x, kind), "b": pa.array(y, kind), "n": pa.array(n, pa.int64())})

    return judge


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.9, depth: int | None = None, pivots_per_root: float = 4.0, min_pivots: int = 48, min_shared: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each row of vectors: the id, n_links (other rows linked directly), component_id (the smallest id reachable),
    kept (whether it is its component's smallest).

    Links are pairs with a cosine of at least `threshold` that share `min_shared` of their `depth` nearest pivots (see depth_for); equal vectors
    are always linked. Unusable vectors (see valid_classes) and rows with a null id have no links and are their own component.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    classes = settle(valid_classes(vectors, id_col=id_col, vector_col=vector_col), "classes")
    n = classes.count()
    points = sample_pivots(classes, min(max(min_pivots, ceil(pivots_per_root * sqrt(n))), 1 << 16))
    depth = depth or depth_for(len(points))
    if len(points) < 2 or n < 2:
        found = classes.select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(0).cast("long").alias("n")).limit(0)
    else:
        described = settle(describe(classes, points, depth), "described")
        pairs = "flatten(transform(sequence(0, size(p) - 2), x -> transform(sequence(x + 1, size(p) - 1), y -> p[x] * 1048576L + p[y])))"
        listed = described.withColumn("p", F.array_sort("near")).select("cls", F.explode(F.expr(pairs)).alias("list"))
        sizes = listed.groupBy("list").agg(F.count("*").alias("size")).where("size > 1").withColumn("tiles", F.ceil(F.col("size") / BLOCK).cast("int"))
        tiled = listed.join(sizes, "list").withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
        dealt = tiled.select("list", "cls", "tile", "tiles", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        dealt = dealt.select("list", "cls", "tile", "tiles", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
        lots = max(1, n * depth * (depth - 1) // (8 * BLOCK))  # short lists share a lot of some thousand rows, each block of a long one is its own
        lot = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("list"), F.lit(lots))).otherwise(F.xxhash64("list", "i", "j"))
        blocks = dealt.withColumn("lot", lot).join(described, "cls").groupBy("lot")
        found = settle(blocks.applyInArrow(_judge(threshold, min_shared), f"a {kind}, b {kind}, n long"), "linked")
    counts = found.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    joined = components(found.where("b is not null").select("a", "b"))
    of_class = classes.join(counts, "cls", "left").join(joined, F.col("cls") == F.col("node"), "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "cls").alias("component"))
    rows = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("w"))
    out = rows.join(of_class, (F.col("w") == F.col("v")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), unit AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE len(e) = (SELECT mode(len(e)) FROM v)
), links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM unit x JOIN unit y ON x.vec_id <> y.vec_id AND list_dot_product(x.e, y.e) / (x.size * y.size) >= 0.9
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT m.vec_id, coalesce(n, 0) AS n_links, least AS component_id, m.vec_id = least AS kept
FROM (SELECT a AS vec_id, min(b) AS least FROM reached GROUP BY a) m LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON m.vec_id = c.a
"""

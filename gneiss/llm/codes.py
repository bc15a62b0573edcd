"""Vector codes: product quantisation in whole numbers, the same on every machine and in every order.

A vector's components become whole numbers and are cut into parts. Each part position has a codebook that starts as the parts of
the vectors with the smallest ids and is refined in rounds: every part goes to its nearest entry, and every entry becomes the mean,
rounded down, of its parts. To find the nearest entry a product of float32 matrices gives all distances to within an interval that
follows from the rounding errors of its terms; only the entries whose interval overlaps the best one's are evaluated again, in whole
numbers, and ties go to the lower index. So no code ever depends on how a product was summed.

Codebooks have a fixed size; they and the sums that make them are all that passes through the driver. A task adds up its own rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

#: Numbers evaluated at a time: rows * entries * components.
CELLS = 1 << 22


def whole_vectors(vectors: DataFrame, *, scale: float, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """id, label, w: floor(scale * x) of each component x, at the limits of a long beyond them. Null vectors and those with null or
    non-finite components are dropped, and so are those of another length than the most common (of several such, the shortest)."""
    v = F.col("v")
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    doubles = vectors.select(F.col(id_col).alias("id"), label.alias("label"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    usable = doubles.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    common = usable.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return usable.where(F.size("v") == (common["size"] if common else 0)).select("id", "label", F.transform(v, lambda x: F.floor(x * scale)).alias("w"))


def _largest(*arrays: np.ndarray) -> int:
    return max((max(abs(int(x.max())), abs(int(x.min()))) for x in arrays if x.size), default=0)


def intervals(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of |c|^2 - 2 x.c, times a power of two, for every row x and entry c, from one float32 product.

    With unit roundoff u = 2^-24, both factors are rounded once and their d products are summed in any order, so the product is off
    by at most g |x| |c| with g = (d + 4) u / (1 - (d + 4) u). Everything else is in doubles, off by (d + 8) 2^-52 of its size at most.
    The scale leaves whole numbers of 16 bits before the point, so nothing overflows, and nothing of 64 bits underflows.
    """
    d = rows.shape[1]
    scale = 2.0 ** -max(0, _largest(rows, entries).bit_length() - 16)
    x, c = rows.astype(np.float64) * scale, entries.astype(np.float64) * scale
    square = (c * c).sum(axis=1)
    sizes = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt(square)[None, :]
    g = (d + 4) * 2.0**-24 / (1 - (d + 4) * 2.0**-24)
    off = (2 * g * (1 + 2.0**-20)) * sizes + ((d + 8) * 2.0**-52) * (square[None, :] + 2 * sizes)
    value = square[None, :] - 2 * (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    return value - off, value + off


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry by squared distance, ties to the lower index, and that distance, exactly (Python's integers
    where 64 bits do not suffice)."""
    d, index, distance = rows.shape[1], [], []
    kind = np.int64 if max(d, 1) * (2 * _largest(rows, entries)) ** 2 < 1 << 63 else object
    step = max(1, CELLS // max(1, len(entries) * d))
    for a in range(0, len(rows), step):
        part = rows[a : a + step]
        low, high = intervals(part, entries)
        row, entry = np.nonzero(low <= high.min(axis=1, keepdims=True))
        apart = part[row].astype(kind) - entries[entry].astype(kind)
        exact = (apart * apart).sum(axis=1) if d else np.zeros(len(row), dtype=kind)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(exact, starts)
        hits = np.flatnonzero(exact == np.repeat(least, np.diff(starts, append=len(row))))
        index.append(entry[hits[np.unique(row[hits], return_index=True)[1]]])
        distance.append(least)
    return (np.concatenate(index), np.concatenate(distance)) if index else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=np.int64)


def _cuts(d: int, parts: int) -> list[slice]:
    return [slice(d * p // parts, d * (p + 1) // parts) for p in range(parts)]


def refine(kept: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over all rows (w): each entry the mean, rounded down, of the parts nearest to it, if any."""
    shared = kept.sparkSession.sparkContext.broadcast(books)  # of a fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        cuts = _cuts(sum(b.shape[1] for b in books), len(books))
        sums = [np.zeros(b.shape, dtype=object) for b in books]
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            rows = _matrix(batch.column(0))
            kind = np.int64 if _largest(rows) * max(len(rows), 1) < 1 << 63 else object
            for p, cut in enumerate(cuts if len(rows) else ()):
                index, _ = nearest(rows[:, cut], books[p])
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                sums[p][used] += np.add.reduceat(rows[order, cut].astype(kind), starts, axis=0).astype(object)
                counts[p] += np.bincount(index, minlength=len(counts[p]))
        found = [(p, e, i, int(counts[p][e]), Decimal(int(total))) for p in range(len(books)) for e in np.flatnonzero(counts[p]).tolist() for i, total in enumerate(sums[p][e])]
        columns = zip(*found, strict=True) if found else [()] * 5
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "entry", "place", "n", "total"])

    sums = kept.select("w").mapInArrow(work, "part int, entry int, place int, n long, total decimal(38,0)")
    after = [b.copy() for b in books]
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # a row for each number of the codebooks at most
        after[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return after


def encode(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """id, label, code (two hex digits for each part), error (the squared distances of all parts, at the limit of a long beyond it)."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    kinds = [kept.schema[c].dataType.simpleString() for c in ("id", "label")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        cuts = _cuts(sum(b.shape[1] for b in books), len(books))
        for batch in batches:
            rows = _matrix(batch.column(2))
            found = [nearest(rows[:, cut], books[p]) for p, cut in enumerate(cuts)] if len(rows) else []
            code = [bytes(x).hex() for x in zip(*(index.tolist() for index, _ in found), strict=True)]
            error = [min(sum(x), (1 << 63) - 1) for x in zip(*(distance.tolist() for _, distance in found), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    return kept.select("id", "label", "w").mapInArrow(work, f"id {kinds[0]}, label {kinds[1]}, code string, error long")


def train(kept: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4) -> list[np.ndarray]:
    """The codebooks of kept (id, w; settled), started with the vectors of the smallest ids; null ids come last, and of one id the
    smaller vector comes first. With fewer vectors than entries every one is an entry."""
    first = kept.select("w").orderBy(F.col("id").asc_nulls_last(), "w").limit(entries).toArrow()
    rows = _matrix(first.column("w").combine_chunks())
    books = [rows[:, cut].copy() for cut in _cuts(rows.shape[1], parts)]
    for _ in range(rounds if len(rows) else 0):
        books = refine(kept, books)
    return books


def compress(vectors: DataFrame, *, scale: float = 1024.0, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """The id, code, error, label_error and codebooks_sha256 of every row whose vector is kept (see `whole_vectors`).

    label_error sums the errors of equal labels, nulls together (of all rows without a label column). Repeated rows count each for
    itself; rows with a null id are coded too. Parts are d * p // parts to d * (p + 1) // parts: equal if `parts` divides d.
    An empty table, or one without a usable vector, gives no rows. label_error is null if the sum is more than a long holds.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits, so a codebook has 1 to 256 entries")
    kept = settle(whole_vectors(vectors, scale=scale, id_col=id_col, vector_col=vector_col, label_col=label_col), "vectors")
    books = train(kept, parts=parts, entries=entries, rounds=rounds)
    digest = hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()
    coded = settle(encode(kept, books), "codes")
    # Summed before the shuffle; of a frequent label only the one sum meets its rows, which Spark may split.
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    out = coded.alias("c").join(sums.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    out = ["""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS w, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, label, r, p, w[p * len(w) // 4 + 1:(p + 1) * len(w) // 4] AS w FROM v, (SELECT unnest(range(4)) AS p)
), b0 AS MATERIALIZED (
  SELECT p, r AS e, w FROM x WHERE r < 256
)"""]
    for k in range(5):
        out.append(f"""a{k} AS MATERIALIZED (
  SELECT vec_id, label, p, unnest(x) AS m FROM (
    SELECT x.vec_id, x.label, x.p, [min(struct_pack(d := list_dot_product(x.w, x.w) - 2 * list_dot_product(x.w, b.w) + list_dot_product(b.w, b.w), e := e))] AS x
    FROM x JOIN b{k} b ON x.p = b.p GROUP BY x.vec_id, x.label, x.p)
)""")
        if k < 4:
            out.append(f"""m{k} AS MATERIALIZED (
  SELECT p, e, list(mean ORDER BY i) AS w FROM (
    SELECT a.p, m.e AS e, i, floor(sum(x.w[i]) / count(*)) AS mean
    FROM a{k} a JOIN x ON a.vec_id = x.vec_id AND a.p = x.p, (SELECT unnest(range(1, (SELECT max(len(w)) FROM x) + 1)) AS i) WHERE i <= len(x.w) GROUP BY a.p, m.e, i) GROUP BY p, e
), b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e
)""")
    return ",\n".join(out) + """, codes AS MATERIALIZED (
  SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a4 GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(w, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY p, e)) FROM b4) AS codebooks_sha256
FROM codes
"""


OP13_SQL = _op13_sql()

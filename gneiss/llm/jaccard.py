"""Similarity join on word shingles by parity sketches.

A document's set is hashed; equal sets are one class, and classes are what is joined. In a class's sketch every shingle flips
one bit, so the Hamming distance of two sketches never exceeds the size of the sets' symmetric difference. Classes are banded
by size so that two similar ones lie in the same or in adjacent bands; a class of which a larger partner may lie in the next band
is sketched for that band too. All sketches of a band have P words of PART bits, a tenth more than the most differences d that a
link there allows. A differing shingle touches one word, so two linked classes agree in at least P - d words: they meet in a
bucket (band, word's place, hash of the word). P - d - 1 words of a class need no bucket: those without shingles, and as many at
the end. Words are wide, and kept as the places of their set bits, so that different shingles seldom make the same word.

Bucket rows are most of what is shuffled, and few of them share a bucket. They travel packed: a task sorts some of them by part (a
remainder of the bucket's hash) and bucket, and sends a part's as one compressed block of differences. A part is met as one group; the
number of parts grows with the rows.

Only buckets are made of whole sketches. Classes that meet others have a short sketch for each of their bands, with about eight bits
for each allowed difference, whose Hamming distance is a lower bound as well; a bucket's members are compared by those of its band.
With three bits, sets that differ in half as much again as a link allows passed, so all pairs of a group of distant copies did.

Buckets are not expanded into pairs. Three hubs of a bucket (its smallest class, its largest, and another one) are held against its
members of a size that allows a link; groups of near copies are joined by that. A bucket of three, or one whose members are all
connected, is then through. What remains is compared sketch by sketch in tiles of bounded size. Tiles of large buckets first yield a
forest, as many pairs as join what their pairs would; once it is verified, all tiles yield the pairs of different components, which
are few: those that the sketches let pass wrongly, and those that a refuted pair of the forest stood for. Every pair that passes the
sketches is verified on the whole sets. Members of a large bucket, and rows of a large class, are dealt into lots before they meet
what is known of it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, if_small, settle, table
from .components import components

#: Rows of a tile: a member of a large bucket is copied once for each of them. BLOCK of a tile's rows are compared at a time.
TILE, BLOCK = 1024, 64
#: Rows of tiles, and pairs with one text, that are met together.
DEALT, PAIRS = 1 << 14, 256
#: Buckets with more open members than this yield a forest before they yield pairs.
FOREST = 64
#: Bits of a short sketch for each difference that a link allows.
SHARP = 8
#: Rows of one bucket or class that meet what is known of it in one lot.
LOT = 1024
#: A size band is at most this factor wide, or as wide as two linked sets may differ: narrow bands allow few differences, so words
#: hold many shingles, and few texts that only share a passage have a word in common.
WIDTH = 1.4
#: Bits of a word of the sketches that make buckets.
PART = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_RADIX = 0x9E3779B97F4A7C15 | 1
#: Bytes hashed at a time; a worker holds some fifty times as much.
CHUNK = 1 << 18
#: Texts of a batch that are worked on at a time.
SLICE = 512
#: Bucket rows that a task packs at a time, and those of a part, or so.
PACKED, MET = 1 << 19, 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix modulo 2**64, and of its inverse."""
    out = []
    for r in (_RADIX, pow(_RADIX, -1, 1 << 64)):
        p = np.full(n, r, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of lower-cased bytes, by differences of a polynomial prefix hash over CHUNK bytes, or one longer word."""
    gap = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    word = np.zeros(len(start), dtype=np.uint64)
    k = 0
    while k < len(start):
        last = max(k + 1, int(np.searchsorted(end, start[k] + CHUNK, side="right")))
        a, b = start[k:last] - start[k], end[k:last] - start[k]
        size = int(b[-1])
        power, inverse = _powers(CHUNK) if size <= CHUNK else _powers.__wrapped__(size)
        prefix = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum((data[start[k] : end[last - 1]].astype(np.uint64) + np.uint64(1)) * power[:size], out=prefix[1:])
        word[k:last] = _mix((prefix[b] - prefix[a]) * inverse[a] + (b - a).astype(np.uint64))
        k = last
    return start, word


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words than `width`, the whole sequence is the one shingle."""
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size < CHUNK):
            raw = (texts[at] or "").encode("utf-8", "surrogatepass").translate(_LOWER)
            group.append(raw)
            size += len(raw) + 1
            at += 1
        begin = np.cumsum([0] + [len(x) + 1 for x in group])
        start, word = _word_hashes(np.frombuffer(b" ".join([*group, b""]), dtype=np.uint8))
        first = np.searchsorted(start, begin)
        n = max(len(word) - width + 1, 0)
        shingle = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            shingle = _mix(shingle + word[k : n + k] * np.uint64(2 * k + 3))
        for a, b in zip(first, first[1:], strict=False):
            if b - a >= width:
                yield np.unique(shingle[a : b - width + 1])
            elif b > a:
                whole = np.array([b - a], dtype=np.uint64)
                for k in range(a, b):
                    whole = _mix(whole + word[k : k + 1] * np.uint64(2 * (k - a) + 3))
                yield whole
            else:
                yield np.zeros(0, dtype=np.uint64)


class Bands:
    """Size bands for a threshold, each a whole number of times as wide (in factors) as two similar sets may differ: they lie in
    the same or in adjacent ones."""

    def __init__(self, threshold: Fraction):
        if not 0 < threshold < 1:
            raise ValueError("the threshold lies between 0 and 1")
        self.threshold = threshold
        self.factor = threshold ** max(1, int(log(WIDTH) / -log(threshold)))
        self.lower = [1]

    def _grow(self, n: int) -> None:
        while self.lower[-1] <= n:
            self.lower.append(-int(-self.lower[-1] / self.factor // 1))

    def of(self, n: int) -> int:
        self._grow(n)
        return bisect_right(self.lower, n) - 1

    def upper(self, band: int) -> int:
        """The first size above the band."""
        while len(self.lower) <= band + 1:
            self._grow(self.lower[-1])
        return self.lower[band + 1]

    def sides(self, n: int) -> list[int]:
        """The bands for which a set of n shingles is sketched: its own, and the next if a similar set may lie there."""
        k = self.of(n)
        return [k, k + 1] if n >= self.threshold * self.upper(k) else [k]

    def differences(self, band: int) -> int:
        """The most shingles in which two linked sets can differ if the larger lies in this band."""
        return int(2 * (self.upper(band) - 1) * (1 - self.threshold) / (1 + self.threshold))

    def words(self, band: int) -> int:
        """Words of the sketches that make buckets; none where only equal sets are linked."""
        d = self.differences(band)
        return d + 1 + (d + 1) // 10 if d else 0

    def short_words(self, band: int) -> int:
        d = self.differences(band)
        return SHARP * d // 64 + 1 if d else 0


def parity_sketch(shingles: np.ndarray, words: int) -> np.ndarray:
    """`words` numbers of 64 bits; each shingle flips one bit of one of them."""
    h = _mix(shingles + np.uint64(words))
    bit = (h >> np.uint64(6)) % np.uint64(words) * np.uint64(64) + (h & np.uint64(63))
    odd = np.bincount(bit.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def part_hashes(shingles: np.ndarray, words: int) -> np.ndarray:
    """A hash of each of the `words` words of PART bits of a parity sketch; 0 for those without a set bit."""
    h = _mix(shingles + np.uint64(words))
    bit, times = np.unique((h >> np.uint64(20)) % np.uint64(words) * np.uint64(PART) + (h & np.uint64(PART - 1)), return_counts=True)
    bit = bit[times & 1 == 1]
    out = np.zeros(words, dtype=np.uint64)
    np.add.at(out, (bit // np.uint64(PART)).astype(np.int64), _mix(bit))
    return out


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, SLICE rows at a time."""
    for b in batches:
        for k in range(0, b.num_rows, SLICE):
            yield b.slice(k, SLICE)


def hash_sets(docs: DataFrame, *, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), cls (hash of the set, null for an empty one)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            sets = [(len(s), np.uint64(_mix(np.array([_mix(s).sum(dtype=np.uint64) + np.uint64(len(s))]))[0]).view(np.int64) if len(s) else None) for s in shingle_sets(b.column(1).to_pylist(), width)]
            n, cls = zip(*sets, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64())], names=["id", "n", "cls"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(work, f"id {kind}, n long, cls long")


def short_sketches(texts: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """cls, at, band, n, sketch of the classes' texts (cls, text): a row for each band `at` for which a class is sketched."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(threshold)
        for b in _sliced(batches):
            rows = []
            for cls, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist(), width), strict=True):
                for at in bands.sides(len(s)) if len(s) else ():
                    if words := bands.short_words(at):
                        rows.append((cls, at, bands.of(len(s)), len(s), parity_sketch(s, words).view("<i8")))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["cls", "at", "band", "n", "sketch"])

    return texts.select("cls", "text").mapInArrow(work, "cls long, at int, band int, n long, sketch array<long>")


def bucket_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """The buckets of a set: 48 bits of a hash (buckets that fall together only cost a look), and the band in the last 10.

    Of a band's P words, linked sets agree in P - d. A set leaves out words that are 0 and then a run of words at the end, P - d - 1
    in all. What two sets that agree leave out together of the words in which they agree is what the one with the longer run leaves
    out, so one word remains in both. A set with too many words that are 0 leaves out none.
    """
    out = [np.zeros(0, dtype=np.uint64)]
    for band in bands.sides(len(shingles)) if len(shingles) else ():
        if not (words := bands.words(band)):
            continue
        sketch = part_hashes(shingles, words)
        spare = words - bands.differences(band) - 1
        kept = np.arange(words)
        empty = int((sketch == 0).sum())
        if empty <= spare:
            tail = np.cumsum(sketch[::-1] != 0)  # words with shingles in each run at the end
            kept = kept[: words - int(np.searchsorted(tail, spare - empty, side="right"))]
            kept = kept[sketch[kept] != 0]
        place = np.uint64(band * 0x9E3779B97F4A7C15 % (1 << 64)) + kept.astype(np.uint64)
        out.append((_mix(_mix(place) + sketch[kept]) >> np.uint64(16)) << np.uint64(10) | np.uint64(band))
    return np.concatenate(out)


def _pack(keys: np.ndarray, cls: np.ndarray, n: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """part, rows, block of bucket rows. A block has the differences of the sorted buckets' quotients, their bands, the classes and
    the sizes, by place of their bytes, of which most are 0."""
    quotient, part = np.divmod(keys >> np.uint64(10), np.uint64(parts))
    order = np.lexsort((quotient, part))
    columns = [x[order].view(np.uint64) for x in (quotient, keys & np.uint64(1023), cls, n)]
    part = part[order]
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    codec = pa.Codec("zstd", 1)
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            own = np.stack([np.diff(columns[0][a:b], prepend=np.uint64(0)), *(x[a:b] for x in columns[1:])])
            yield int(part[a]), b - a, codec.compress(own.view(np.uint8).reshape(4, b - a, 8).transpose(0, 2, 1).tobytes(), asbytes=True)


def _unpack(blocks: list[tuple[int, int, bytes]], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """buckets, classes and sizes of blocks."""
    codec, found = pa.Codec("zstd", 1), []
    for part, rows, block in blocks:
        raw = np.frombuffer(codec.decompress(block, 32 * rows, asbytes=True), dtype=np.uint8).reshape(4, 8, rows)
        own = raw.transpose(0, 2, 1).copy(order="C").view(np.uint64)[:, :, 0]
        own[0] = (np.cumsum(own[0], dtype=np.uint64) * np.uint64(parts) + np.uint64(part)) << np.uint64(10) | own[1]
        found.append(own[[0, 2, 3]])
    bucket, cls, n = np.concatenate(found, axis=1).view(np.int64)
    return bucket, cls, n


def _packed_rows(texts: DataFrame, width: int, threshold: Fraction, parts: int) -> DataFrame:
    """part, rows, block of the bucket rows of the classes' texts (cls, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(threshold)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = zip(*_pack(*(np.concatenate(x) for x in zip(*held, strict=True)), parts), strict=True)
            types = [pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "rows", "block"])

        for b in _sliced(batches):
            for cls, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist(), width), strict=True):
                if len(keys := bucket_keys(s, bands)):
                    held.append((keys, np.full(len(keys), cls, dtype=np.int64), np.full(len(keys), len(s), dtype=np.int64)))
                    size += len(keys)
                if size >= PACKED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return texts.select("cls", "text").mapInArrow(work, "part int, rows int, block binary")


def _bucket_members(texts: DataFrame, width: int, threshold: Fraction, parts: int) -> DataFrame:
    """bucket, cls, n, size of the bucket, and its hubs least, most and third (cls, n), of the classes (cls, text) that share a bucket."""
    hub = "struct<cls:long,n:long>"

    def meet(t: pa.Table) -> pa.Table:
        bucket, cls, n = _unpack(list(zip(*(t.column(c).to_pylist() for c in ("part", "rows", "block")), strict=True)), parts)
        order = np.lexsort((cls, bucket))
        bucket, cls, n = bucket[order], cls[order], n[order]
        begin = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
        size = np.diff(begin, append=len(bucket))
        shared = cls[begin] != cls[begin + size - 1]
        kept = np.repeat(shared, size)
        bucket, cls, n = bucket[kept], cls[kept], n[kept]
        size = size[shared]
        begin = np.cumsum(size) - size
        h = _mix(cls.view(np.uint64) + np.uint64(7))
        lowest = np.flatnonzero(h == np.repeat(np.minimum.reduceat(h, begin), size)) if len(h) else begin
        hubs = [np.repeat(at, size) for at in (begin, begin + size - 1, lowest[np.searchsorted(lowest, begin)])]
        hubs = [pa.StructArray.from_arrays([pa.array(cls[at]), pa.array(n[at])], names=["cls", "n"]) for at in hubs]
        return pa.table([pa.array(bucket), pa.array(cls), pa.array(n), pa.array(np.repeat(size, size)), *hubs], names=["bucket", "cls", "n", "size", "least", "most", "third"])

    return _packed_rows(texts, width, threshold, parts).groupBy("part").applyInArrow(meet, f"bucket long, cls long, n long, size long, least {hub}, most {hub}, third {hub}")


#: The band of a bucket.
AT = "cast(bucket & 1023 as int)"


def _similar(a: str, b: str, threshold: Fraction) -> Column:
    """Whether two classes' sizes and sketches allow a link, for which the band of the larger one is looked at."""
    p, q = threshold.numerator, threshold.denominator
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = F.aggregate(F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, v: s + v)
    return (F.greatest(f"{a}.band", f"{b}.band") == F.col(f"{a}.at")) & (q * F.least(n, m) >= p * F.greatest(n, m)) & (apart * (p + q) <= (n + m) * (q - p))


def _with_bucket(members: DataFrame, known: DataFrame) -> DataFrame:
    """members (bucket, cls, size, ..) with what is known of their buckets (bucket, size, ..), LOT or so of a bucket's members at a time."""
    lots = F.ceil(F.col("size") / LOT).cast("int")
    dealt = known.withColumn("lot", F.explode(F.sequence(F.lit(0), lots - 1))).drop("size")
    return members.withColumn("lot", F.pmod(F.xxhash64("cls"), lots).cast("int")).join(dealt, ["bucket", "lot"]).drop("lot")


def _print(*columns: str) -> list[Column]:
    """Aggregates that tell sets of classes apart: three sums of hashes."""
    return [F.sum(F.pmod(F.xxhash64("cls", F.lit(k)), F.lit(1 << 31))).alias(c) for k, c in enumerate(columns)]


def _one_of_equals(buckets: DataFrame) -> DataFrame:
    """bucket, size: one of the buckets (bucket, size, p, q, r) with the same members. Texts with a passage in common meet in one bucket
    for each of its words, which would all be compared alike."""
    return buckets.groupBy("size", "p", "q", "r").agg(F.min("bucket").alias("bucket")).select("bucket", "size")


def _hub_pairs(members: DataFrame, sketches: DataFrame, threshold: Fraction) -> DataFrame:
    """a, b: each member of a bucket with the bucket's three hubs, if their sizes and sketches allow a link.

    A pair is looked at in the band of the larger set only, where every link has a bucket.
    """
    p, q = threshold.numerator, threshold.denominator
    bands = Bands(threshold)
    lower = F.array(*[F.lit(bands.lower[k]) for k in range(bands.of(1 << 31) + 1)])
    each = members.select("bucket", "cls", "n", F.explode(F.array_distinct(F.array("least", "most", "third"))).alias("hub")).where("cls != hub.cls")
    low, high = F.least("n", "hub.n"), F.greatest("n", "hub.n")
    each = each.where((q * low >= p * high) & (high >= F.get(lower, F.expr(AT))))
    pairs = each.select(F.least("cls", "hub.cls").alias("a"), F.greatest("cls", "hub.cls").alias("b"), F.expr(AT).alias("met")).distinct()
    one = pairs.join(sketches.alias("x"), (F.col("a") == F.col("x.cls")) & (F.col("met") == F.col("x.at")))
    return one.join(sketches.alias("y"), (F.col("b") == F.col("y.cls")) & (F.col("met") == F.col("y.at"))).where(_similar("x", "y", threshold)).select("a", "b").distinct()


def _forest(pairs: list[tuple[int, int, int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """The pairs (distance, component, component, a, b), the nearest first, that join components which none before joined."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for pair in sorted(pairs):
        c, d = top(pair[1]), top(pair[2])
        if c != d:
            up[c] = d
            yield pair


def _tile_pairs(members: DataFrame, sketches: DataFrame, threshold: Fraction, *, forest: bool = False) -> DataFrame:
    """a, b: all pairs of different components in one bucket whose sketches allow a link, compared in tiles of two times TILE rows.
    With forest, only those of buckets with more than FOREST members, and of each tile's pairs no more than a forest of components.

    Tiles of buckets with the same smallest class share a lot, and a class's sketch comes to a lot once, however many of the lot's
    tiles it is in.
    """
    p, q = threshold.numerator, threshold.denominator
    left = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("component").alias("least"), F.max("component").alias("most"), F.max("size").alias("all"), F.min("cls").alias("head"), *_print("p", "q", "r")).where("least != most")
    if forest:
        left = left.where(F.col("size") > FOREST)
    sizes = _one_of_equals(left).withColumnRenamed("size", "left").join(left.select("bucket", "head", F.col("all").alias("size")), "bucket")
    open_ = _with_bucket(members, sizes).withColumn("tiles", F.ceil(F.col("left") / TILE).cast("int"))
    open_ = open_.withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    dealt = open_.select("bucket", "head", "cls", "component", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select("bucket", "head", "cls", "component", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        cls, component, n, band = (t.column(c).to_numpy() for c in ("cls", "component", "n", "band"))
        lists, places = t.column("sketch").combine_chunks(), t.column("tiles").combine_chunks()
        flat, begin, width = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(t)), places.value_lengths().to_numpy())
        bucket, i, j, tile = (places.flatten().field(c).to_numpy() for c in ("bucket", "i", "j", "tile"))
        order = np.lexsort((j, i, bucket))
        row, bucket, i, j, tile = (x[order] for x in (row, bucket, i, j, tile))
        out = [np.zeros((0, 2), dtype=np.int64)]
        cuts = [0, *(np.flatnonzero((bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), len(bucket)]
        for first, last in zip(cuts, cuts[1:], strict=False):
            if last - first < 2:
                continue
            own, at = row[first:last], int(bucket[first]) & 1023
            sketch = flat[begin[own][:, None] + np.arange(width[own[0]])]  # of one band, so of one length
            trees: list[tuple[int, int, int, int, int]] = []
            for block in range(0, last - first - 1, BLOCK):
                x, y = np.nonzero(np.arange(last - first) > np.arange(block, min(block + BLOCK, last - first))[:, None])
                x += block
                if i[first] != j[first]:
                    across = tile[first:last][x] != tile[first:last][y]
                    x, y = x[across], y[across]
                u, v = own[x], own[y]
                ok = (component[u] != component[v]) & (q * np.minimum(n[u], n[v]) >= p * np.maximum(n[u], n[v])) & (np.maximum(band[u], band[v]) == at)
                x, y, u, v = x[ok], y[ok], u[ok], v[ok]
                apart = np.zeros(len(x), dtype=np.int64)
                for k in range(0, len(x), 1 << 14):
                    part = slice(k, k + (1 << 14))
                    apart[part] = np.bitwise_count(sketch[x[part]] ^ sketch[y[part]]).sum(axis=1, dtype=np.int64)
                near = apart * (p + q) <= (n[u] + n[v]) * (q - p)
                u, v = u[near], v[near]
                a, b = np.minimum(cls[u], cls[v]), np.maximum(cls[u], cls[v])
                if forest:  # a forest of a forest and more pairs is one of them all
                    trees = list(_forest(trees + list(zip(*(x.tolist() for x in (apart[near], component[u], component[v], a, b)), strict=True))))
                else:
                    out.append(np.stack([a, b], axis=1))
            if trees:
                out.append(np.array(trees, dtype=np.int64)[:, 3:])
        a, b = np.unique(np.concatenate(out), axis=0).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    lots = max(1, dealt.count() // DEALT)  # small buckets share a lot
    lot = F.pmod(F.xxhash64("head", "i", "j"), F.lit(lots)).alias("lot")
    once = dealt.groupBy(lot, "cls", F.expr(AT).alias("at")).agg(F.first("component").alias("component"), F.collect_list(F.struct("bucket", "i", "j", "tile")).alias("tiles"))
    return once.join(sketches, ["cls", "at"]).groupBy("lot").applyInArrow(compare, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """The pairs of classes (a, b) whose whole sets are similar enough. texts: cls, text.

    Pairs are grouped by a, at most PAIRS or so of them in a group, with the text of a beside those of its b.
    """
    p, q = threshold.numerator, threshold.denominator
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("groups"))
    dealt = pairs.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"))
    needed = dealt.select("a", "part", "b").union(dealt.select("a", "part", F.col("a").alias("b")).distinct())
    lots = max(1, pairs.count() // 64)  # small groups share a lot
    lot = F.pmod(F.xxhash64("a", "part"), F.lit(lots)).alias("lot")
    full = needed.join(texts, F.col("b") == F.col("cls")).select("a", "part", "b", "text", lot)

    def verify(t: pa.Table) -> pa.Table:
        group = list(zip(t.column("a").to_pylist(), t.column("part").to_pylist(), strict=True))
        b, text = t.column("b").to_pylist(), t.column("text")
        hubs = {g: k for k, g in enumerate(group) if b[k] == g[0]}
        order = sorted(range(len(b)), key=group.__getitem__)
        kept, last, hub = [], None, None
        for k in order:
            if group[k] != last:
                last = group[k]
                hub = next(shingle_sets([text[hubs[last]].as_py()], width))
            if b[k] != last[0]:
                own = next(shingle_sets([text[k].as_py()], width))
                both = len(np.intersect1d(hub, own, assume_unique=True))
                if q * both >= p * (len(hub) + len(own) - both):
                    kept.append((last[0], b[k]))
        x, y = zip(*kept, strict=True) if kept else ((), ())
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return full.groupBy("lot").applyInArrow(verify, "a long, b long")


def similar_components(docs: DataFrame, *, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: the id, n_shingles, component_id (the smallest id reachable by links, its own included),
    text_hash (xxhash64 of the text), and representative: whether the row is its component's first by id and text.

    Texts without words, and null texts, have an empty set and are their own component. Rows with equal sets are linked; a row
    with a null id takes part, and its component_id is the smallest id there is in its component, or null.
    """
    share = Fraction(str(threshold))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashed = docs.withColumn("h", F.xxhash64("text"))
    # A pass over the texts for sizes and classes; the classes' texts make the buckets in a second one.
    rows = settle(hash_sets(hashed.select(F.struct("id", "h").alias("key"), "text"), width=width, id_col="key"), "sets")
    rows = rows.select(F.col("id.id").alias("id"), F.col("id.h").alias("h"), "n", F.col("cls").alias("set"))
    # Classes are numbered: numbers are smaller in shuffles than hashes. The same number follows a set everywhere.
    numbered = rows.where("n > 0").groupBy("set").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h")).alias("one"), F.count("*").alias("copies"), F.first("n").alias("n"))
    classes = settle(numbered.select("set", "one", "copies", "n", F.monotonically_increasing_id().alias("cls")), "classes")
    first = if_small(classes.select("cls", F.col("one.id").alias("__id"), F.col("one.h").alias("__h")))
    texts = hashed.join(first, F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))).select("cls", "text")
    # A band's sketches have at most so many words for each shingle, and a class two sketches.
    rate = Fraction(22, 5) * (1 - share) / (1 + share) / Bands(share).factor
    parts = int((classes.agg(F.sum("n")).first()[0] or 0) * rate / MET) + 1
    members = settle(_bucket_members(texts, width, share, parts), "members")
    involved = members.select("cls").distinct().join(classes, "cls")
    first = if_small(settle(involved.select("cls", F.col("one.id").alias("__id"), F.col("one.h").alias("__h")), "involved"))
    texts = settle(hashed.join(first, F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))).select("cls", "text"), "texts")
    sketches = settle(short_sketches(texts, width, share), "sketches")

    pairs = settle(_hub_pairs(members, sketches, share), "pairs")
    links = settle(_verified(pairs, texts, width, share), "verified")
    joined = components(links)
    # Up to three members are all held against each other by then.
    def open_(joined: DataFrame) -> DataFrame:
        more = members.where("size > 3").join(if_small(joined), F.col("cls") == F.col("node"), "left")
        return more.select("bucket", "cls", "size", F.coalesce("component", "cls").alias("component"))

    trees = settle(_tile_pairs(open_(joined), sketches, share, forest=True), "trees")
    if trees.count():
        before, links = links, settle(_verified(trees, texts, width, share).union(links), "verified")
        forget(before, joined)
        joined = components(links)
    forget(trees)
    last = settle(_tile_pairs(open_(joined), sketches, share), "pairs")
    forget(members, pairs)
    every = settle(_verified(last, texts, width, share).union(links), "verified")
    forget(last, links, joined, texts, sketches)
    joined = components(every)
    forget(every)
    of_set = classes.select("set", "cls", "one", "copies").join(if_small(joined), F.col("cls") == F.col("node"), "left").select("set", "one", "copies", F.coalesce("component", "cls").alias("component"))
    head = of_set.groupBy("component").agg(F.min("one").alias("head"), F.min("one.id").alias("least"))
    of_set = settle(of_set.join(head, "component").select("set", "copies", "head", "least"), "sets")
    hot = if_small(of_set.where(F.col("copies") > LOT).select("set", F.ceil(F.col("copies") / LOT).cast("int").alias("lots")))
    lot = F.pmod(F.xxhash64("id", "h"), F.coalesce("lots", F.lit(1))).cast("int")
    out = rows.select("id", "h", "n", "set").join(hot, "set", "left").withColumn("lot", lot).drop("lots")
    dealt = of_set.withColumn("lot", F.explode(F.sequence(F.lit(0), F.when(F.col("copies") > LOT, F.ceil(F.col("copies") / LOT)).otherwise(1).cast("int") - 1)))
    out = out.join(dealt, ["set", "lot"], "left")
    own = F.struct(F.col("id").isNull().alias("last"), "id", "h")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"), F.col("h").alias("text_hash"), F.when(F.col("n") > 0, own.eqNullSafe(F.col("head"))).otherwise(True).alias("representative"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_components(table(spark, sf_dir, "documents"), width=3, threshold=0.9)
    return found.select("doc_id", "n_shingles", "component_id")


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS p FROM d)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared.n >= 90 * (x.n + y.n - shared.n)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) LEFT JOIN sizes USING (doc_id)
"""

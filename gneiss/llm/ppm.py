"""Language-model scores by prediction by partial matching over bytes, beside an add-one unigram score over words.

The model is a trie of byte contexts up to `order`, counted over all training texts. A byte that its longest known context
has not seen is coded by escapes (method C) to shorter contexts, in which the symbols of the longer ones are excluded; at
the end every byte not yet excluded is equally likely. As the trie is fixed when texts are scored, exclusion depends on the
context alone, so what is left of a context after an escape is worked out once a context, and scoring is lookups.

Every context that the training texts have stays, with all its symbols. A byte's probability depends on the byte and the
`ORDER` before it alone, so it is worked out once for each distinct string of ORDER + 1 bytes. The strings are dealt by the
two bytes before the last: all that orders 2 and up say of a string then lies in its part, however large the corpus is, and
only the counts of orders 0 and 1 (at most 256 + 256 ** 2) are sent to every part.

Texts are dealt into blocks of `block_bytes`. What a block has is packed: for each part one row with the block's distinct
strings (or words) and one with their counts, so that neither costs a row a block. Packed rows of `SLOT_BLOCKS` blocks are merged,
what is merged is counted over the corpus and scored, and the results go back to merged blocks and from there, packed in the
order in which strings and words came, to the blocks.

A text's score is the probability of its bytes; the end of a text is not coded, so the scores are comparable between texts of
like lengths and the empty text's score is 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, settle, table

ORDER = 4
BLOCK_BYTES = 8 << 20
#: Positions worked through at a time.
PIECE = 1 << 20
#: Blocks merged before their strings and words are counted over the corpus.
SLOT_BLOCKS = 128
#: Bytes of text for which there is one part, and the most parts.
PART_BYTES, MOST_PARTS = 1 << 20, 4096
WORDS, GRAMS = 0, 1
#: Distinct byte strings a part, on average.
PART_GRAMS = 250_000
END = b""


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts after `ORDER` zero bytes each; where each text starts, and its length."""
    pad = bytes(ORDER)
    length = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.cumsum(length + ORDER) - length
    return np.frombuffer(pad + pad.join(texts) if texts else b"", dtype=np.uint8), start, length


def _grams(data: np.ndarray) -> np.ndarray:
    """At each position from ORDER on: the byte and the ORDER before it, as one number."""
    n = len(data) - ORDER
    key = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(ORDER + 1):
        key <<= np.uint64(8)
        key |= data[k : n + k]
    return key


def _pieces(texts: list[bytes], marks: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First position, number of positions, and each position's gram and mark (its text's, 0 between texts), PIECE at a time."""
    data, start, length = _buffer(texts)
    mark = np.zeros(max(len(data) - ORDER, 0), dtype=np.uint8)
    for s, n, m in zip((start - ORDER).tolist(), length.tolist(), marks.tolist(), strict=True):
        mark[s : s + n] = m
    for a in range(0, len(mark), PIECE):
        own = mark[a : a + PIECE]
        yield a, len(own), _grams(data[a : a + len(own) + ORDER]), own


def _part(grams: np.ndarray, parts: int) -> np.ndarray:
    """The part of each gram, by the two bytes before its last."""
    return ((grams >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(40503) % np.uint64(parts)


class Lookup:
    """Numbers to their place in an array, -1 for others: one flat table with linear probing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slot = np.full(1 << self.bits, -1, dtype=np.int32)
        self.keys = keys
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            kept = self.slot[at] == left
            left, at = left[~kept], (at[~kept] + 1) & (len(self.slot) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        found = self.slot[at]
        if not len(self.keys):
            return found
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.slot) - 1)
            found[wrong] = self.slot[at[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[found[wrong]] != keys[wrong])]
        return found


class Trie:
    """counts: for each order from 0 to ORDER, sorted (context and symbol) numbers and how often each occurs."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        self.grams = [Lookup(keys) for keys, _ in counts]
        self.n = [n.astype(np.float64) for _, n in counts]
        self.contexts, self.total, self.distinct, self.total_after, self.distinct_after = [], [], [], [], []
        for order, (keys, n) in enumerate(counts):
            context, first, inverse = np.unique(keys >> np.uint64(8), return_index=True, return_inverse=True)
            total, distinct = np.bincount(inverse, n, len(context)), np.bincount(inverse, minlength=len(context)).astype(float)
            self.contexts.append(Lookup(context))
            self.total.append(total)
            self.distinct.append(distinct)
            if order:
                shorter = self._mask(order)
                seen = self.n[order - 1][self.grams[order - 1].find(keys & shorter)]
                below = self.contexts[order - 1].find(context & (shorter >> np.uint64(8)))
                self.total_after.append(self.total[order - 1][below] - np.bincount(inverse, seen, len(context)))
                self.distinct_after.append(self.distinct[order - 1][below] - distinct)
            else:  # below order 0, each byte not seen at all once
                self.total_after.append(np.zeros(len(context)))
                self.distinct_after.append(256 - distinct)
        longest = self.contexts[-1].find(counts[-1][0] >> np.uint64(8))
        self.hit = np.log10(self.n[-1] / (self.total[-1][longest] + self.distinct[-1][longest]))

    @staticmethod
    def _mask(length: int) -> np.uint64:
        return np.uint64((1 << 8 * length) - 1)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each byte after its context."""
        at = self.grams[-1].find(grams)
        out = np.where(at >= 0, self.hit[at] if len(self.hit) else 0.0, 0.0)
        left = np.flatnonzero(at < 0)
        total, distinct = np.zeros(len(left)), np.zeros(len(left))
        escaped = np.zeros(len(left), dtype=bool)
        for order in range(ORDER, -1, -1):
            key = grams[left] & self._mask(order + 1)
            context = self.contexts[order].find(key >> np.uint64(8))
            known = context >= 0
            if len(self.total[order]):
                fresh = known & ~escaped
                total = np.where(fresh, self.total[order][context], total)
                distinct = np.where(fresh, self.distinct[order][context], distinct)
                if order < ORDER:
                    at = self.grams[order].find(key)
                    seen = at >= 0
                    out[left[seen]] += np.log10(self.n[order][at[seen]] / (total[seen] + distinct[seen]))
                    left, context, known, total, distinct, escaped = (x[~seen] for x in (left, context, known, total, distinct, escaped))
                leave = known & (distinct > 0)
                out[left[leave]] += np.log10(distinct[leave] / (total[leave] + distinct[leave]))
                total = np.where(known, self.total_after[order][context], total)
                distinct = np.where(known, self.distinct_after[order][context], distinct)
                escaped |= known
        out[left] -= np.log10(np.where(escaped, np.maximum(distinct, 1), 256))
        return out


def _texts(t: pa.Table, column: str) -> list[bytes]:
    return [x or b"" for x in t.column(column).to_pylist()]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all arrays in order, and the sum of each one's counts."""
    key, n = (np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in (keys, counts))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[first], np.add.reduceat(n, first, dtype=n.dtype) if len(first) else n


def _block_grams(texts: list[bytes], held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a block in order, and how often training texts have each."""
    keys, counts = [], []
    for _, _, grams, mark in _pieces(texts, 1 + held.astype(np.uint8)):
        for m in (1, 2):
            found, n = np.unique(grams[mark == m], return_counts=True)
            keys.append(found)
            counts.append(n.astype(np.uint32) * np.uint32(m == 1))
    return _summed(keys, counts)


def _block_words(texts: list[bytes], held: list[bool], parts: int) -> tuple[list[list[bytes]], Counter[bytes]]:
    """The distinct words of a block (the end is one) by part, in order, and their training counts (0 for those of held-out texts alone)."""
    words: Counter[bytes] = Counter({END: 0})
    for text, out in zip(texts, held, strict=True):
        own = text.lower().split()
        if out:
            for w in own:
                words.setdefault(w, 0)
        else:
            words.update(own)
            words[END] += 1
    dealt: list[list[bytes]] = [[] for _ in range(parts)]
    for w in sorted(words):
        dealt[zlib.crc32(w) % parts].append(w)
    return dealt, words


def _count_block(t: pa.Table, parts: int) -> pa.Table:
    """What a block has of each part: words, joined by spaces, and grams, each with their counts."""
    texts, held = _texts(t, "text"), t.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
    dealt, words = _block_words(texts, held.tolist(), parts)
    rows = [(WORDS, k, b" ".join(own), np.array([words[w] for w in own], dtype="<u4").tobytes()) for k, own in enumerate(dealt) if own]
    found, n = _block_grams(texts, held)
    for k, i in _by_part(found, parts):
        rows.append((GRAMS, k, found[i].tobytes(), n[i].tobytes()))
    kind, part, keys, counts = zip(*rows, strict=True)
    block = np.full(len(rows), t.column("block")[0].as_py(), dtype=np.int32)
    return pa.table({"block": pa.array(block), "kind": pa.array(kind, pa.int8()), "part": pa.array(part, pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})


def _by_part(found: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part with the places of its grams, in their order."""
    part = _part(found, parts)
    order = np.argsort(part, kind="stable")
    own, first = np.unique(part[order], return_index=True)
    yield from zip(own.tolist(), np.split(order, first[1:]), strict=True) if len(own) else ()


def _unpack(t: pa.Table, column: str, dtype: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=dtype) for x in t.column(column)]


def _words(raw: np.ndarray) -> pa.BinaryArray:
    """Words joined by single spaces, as an array."""
    ends = np.append(np.flatnonzero(raw == 32), len(raw)).astype(np.int32)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int32)
    size = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(size), pa.py_buffer(np.ascontiguousarray(raw[raw != 32]))])


def _merge_words(t: pa.Table) -> pa.Table:
    """part, slot, word, n: the words of one part in the blocks of one slot."""
    merged = pa.table({"word": pa.chunked_array([_words(x) for x in _unpack(t, "keys", "u1")]), "n": pa.chunked_array([pa.array(x.astype(np.int64)) for x in _unpack(t, "counts", "<u4")])})
    merged = merged.group_by("word").aggregate([("n", "sum")])
    part, slot = (pa.array(np.full(len(merged), t.column(c)[0].as_py(), dtype=np.int32)) for c in ("part", "slot"))
    return pa.table({"part": part, "slot": slot, "word": merged.column("word"), "n": merged.column("n_sum")})


def _merge_grams(t: pa.Table) -> pa.Table:
    """part, slot, gram, n: the grams of one part in the blocks of one slot."""
    found, n = _summed(_unpack(t, "keys", "<u8"), [x.astype(np.int64) for x in _unpack(t, "counts", "<u4")])
    part, slot = (pa.array(np.full(len(found), t.column(c)[0].as_py(), dtype=np.int32)) for c in ("part", "slot"))
    return pa.table({"part": part, "slot": slot, "gram": pa.array(found.astype(np.int64)), "n": pa.array(n.astype(np.int64))})


def _spread_words(blocks: pa.Table, counted: pa.Table) -> pa.Table:
    """block, kind, part, found: for each block of a slot, the training counts of its words of one part, in their order."""
    known = counted.column("word").combine_chunks()
    c = counted.column("c").to_numpy()
    found = [c[pc.index_in(_words(own), known).to_numpy()].astype("<i8").tobytes() for own in _unpack(blocks, "keys", "u1")]
    return pa.table({"block": blocks.column("block"), "kind": blocks.column("kind"), "part": blocks.column("part"), "found": pa.array(found, pa.binary())})


def _spread_grams(blocks: pa.Table, scored: pa.Table) -> pa.Table:
    """block, kind, part, found: for each block of a slot, the log10 of its grams of one part, in their order."""
    gram, log = scored.column("gram").to_numpy(), scored.column("log10").to_numpy()
    order = np.argsort(gram)
    gram, log = gram[order].astype(np.uint64), log[order]
    found = [log[np.searchsorted(gram, own)].tobytes() for own in _unpack(blocks, "keys", "<u8")]
    return pa.table({"block": blocks.column("block"), "kind": blocks.column("kind"), "part": blocks.column("part"), "found": pa.array(found, pa.binary())})


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of n of each."""
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.bincount(inverse, n, len(found)).astype(np.int64)


def gram_scores(grams: DataFrame, part_grams: int = PART_GRAMS) -> DataFrame:
    """gram, log10: the log10 probability of the last byte of each distinct gram of (gram, n) rows, under the model of all their counts."""
    totals = settle(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    pairs = totals.where("n > 0").groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(F.sum("n").alias("n")).toArrow()  # at most 256 ** 2 rows
    one = _sums(pairs.column("gram").to_numpy().astype(np.uint64), pairs.column("n").to_numpy())
    low = [_sums(one[0] & Trie._mask(1), one[1]), one]

    def score(batches):
        t = pa.Table.from_batches(batches, pa.schema([("gram", pa.int64()), ("n", pa.int64())]))
        if not t.num_rows:
            return
        asked, n = t.column("gram").to_numpy().astype(np.uint64), t.column("n").to_numpy()
        own, sizes = asked[n > 0], n[n > 0]
        trie = Trie(low + [_sums(own & Trie._mask(k + 1), sizes) for k in range(2, ORDER + 1)])
        yield from pa.table({"gram": t.column("gram"), "log10": trie.log10(asked)}).to_batches(max_chunksize=1 << 16)

    parts = max(1, ceil(totals.count() / part_grams))
    dealt = totals.repartition(parts, F.shiftright("gram", 8).bitwiseAND(0xFFFF))
    return dealt.mapInArrow(score, "gram long, log10 double")


def score_documents(docs: DataFrame, held_out, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, slot_blocks: int = SLOT_BLOCKS, part_grams: int = PART_GRAMS) -> DataFrame:
    """One row for each document (repeated rows each have theirs): held_out, n_tokens, n_known, train_tokens, base_score, score,
    n_bytes. `held_out` is a Boolean column over docs; documents where it isn't true are learnt from.

    A null text counts as empty: its one token is the end, its score 0 (no bytes). An empty table gives no rows. With no
    training text every byte costs log10(256).
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, parts = max(1, ceil(size / block_bytes)), min(MOST_PARTS, max(1, ceil(size / PART_BYTES)))
    own = own.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).cast("int"))
    counted = settle(own.groupBy("block").applyInArrow(lambda t: _count_block(t, parts), "block int, kind byte, part int, keys binary, counts binary"), "counts")
    counted = counted.withColumn("slot", F.floor(F.col("block") / slot_blocks).cast("int"))
    words, packed = counted.where(F.col("kind") == WORDS), counted.where(F.col("kind") == GRAMS)
    slots = settle(packed.select("part", "slot", "keys", "counts").groupBy("part", "slot").applyInArrow(_merge_grams, "part int, slot int, gram long, n long"), "slots")
    scores = slots.select("part", "slot", "gram").join(gram_scores(slots.select("gram", "n"), part_grams).hint("shuffle_hash"), "gram")
    back = "block int, kind byte, part int, found binary"
    known = packed.drop("counts").groupBy("part", "slot").cogroup(scores.groupBy("part", "slot")).applyInArrow(_spread_grams, back)

    slots = settle(words.select("part", "slot", "keys", "counts").groupBy("part", "slot").applyInArrow(_merge_words, "part int, slot int, word binary, n long"), "words")
    sums = settle(slots.groupBy("word").agg(F.sum("n").alias("c")), "sums")
    distinct, total = sums.agg(F.count_if(F.col("c") > 0), F.coalesce(F.sum("c"), F.lit(0))).first()
    counts = slots.select("part", "slot", "word").join(sums, "word")
    known = known.union(words.drop("counts").groupBy("part", "slot").cogroup(counts.groupBy("part", "slot")).applyInArrow(_spread_words, back))
    kind = docs.schema[id_col].dataType.simpleString()

    def score_block(docs_: pa.Table, known_: pa.Table) -> pa.Table:
        texts = _texts(docs_, "text")
        dealt, _ = _block_words(texts, [True] * len(texts), parts)
        found, _ = _block_grams(texts, np.zeros(len(texts), dtype=bool))
        places, log, costs, new = dict(_by_part(found, parts)), np.zeros(len(found)), {}, set()
        for what, part, raw in zip(known_.column("kind").to_pylist(), known_.column("part").to_pylist(), known_.column("found"), strict=True):
            if what == GRAMS:
                log[places[part]] = np.frombuffer(raw.as_buffer(), dtype="<f8")
            else:
                c = np.frombuffer(raw.as_buffer(), dtype="<i8")
                costs.update(zip(dealt[part], np.log10(c + 1.0).tolist(), strict=True))
                new.update(dealt[part][k] for k in np.flatnonzero(c == 0))
        rows = []
        for text in texts:
            tokens = [*text.lower().split(), END]
            rows.append((len(tokens), len(tokens) - (sum(map(new.__contains__, tokens)) if new else 0), sum(map(costs.__getitem__, tokens))))
        place = Lookup(found)
        length = np.array([len(x) for x in texts], dtype=np.int64)
        start = np.cumsum(length + ORDER) - length - ORDER
        score = np.zeros(len(texts))
        for a, n, grams, mark in _pieces(texts, np.ones(len(texts), dtype=np.uint8)):
            inside = mark > 0
            upto = np.zeros(n + 1)
            upto[1:][inside] = log[place.find(grams[inside])]
            upto = np.cumsum(upto)
            lo, hi = np.searchsorted(start + length, a, side="right"), np.searchsorted(start, a + n)
            score[lo:hi] += upto[np.minimum(start[lo:hi] + length[lo:hi] - a, n)] - upto[np.clip(start[lo:hi] - a, 0, n)]
        tokens, n_known, logs_ = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({
            "id": docs_.column("id"), "held_out": docs_.column("held_out"), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "logs": pa.array(logs_, pa.float64()), "score": pa.array(score), "n_bytes": pa.array(length),
        })

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double, n_bytes long"
    scored = own.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score_block, schema)
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fold("doc_id", 7) == 2)

"""Benchmark decontamination by a generalised suffix automaton over the words of the test items.

The items are normalised to words, and one automaton holds every run of words that occurs in any of them. Documents are
streamed through it: each word moves to the state of the longest run that ends there. A word is hit if it lies inside an
occurrence of a window, that is of `window` consecutive words of one item, or of a whole item that has fewer.

Benchmarks are small beside corpora: their size is checked before the automaton is sent to the executors (`max_item_words`),
and a larger one is refused, not cut.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 13
#: Every byte that no word has becomes a space, A-Z become a-z; bytes of other characters (from 0x80) stay.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class Automaton:
    """Suffix automaton of many word sequences.

    Transitions are one dict, {word number: next state} for each state; `span` is the longest run of a state, `up` its
    suffix link. After `close`, `whole[s]` lists the lengths of short items that end in state s or above, longest first.
    """

    def __init__(self, items: dict[object, list[bytes]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.span, self.up = [0], [-1]
        self.items: list[set] = [set()]
        ends: list[tuple[int, object, int]] = []
        for item, seq in items.items():
            last = 0
            for w in seq:
                last = self._extend(last, self.number.setdefault(w, len(self.number)))
                ends.append((last, item, 0))
            if 0 < len(seq) < window:
                ends[-1] = (last, item, len(seq))
        self._close(ends)

    def _extend(self, last: int, w: int) -> int:
        if (known := self.step[last].get(w)) is not None:
            return known if self.span[known] == self.span[last] + 1 else self._split(last, w, known)
        new = self._state(self.span[last] + 1, {})
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.up[p]
        if p >= 0:
            q = self.step[p][w]
            self.up[new] = q if self.span[q] == self.span[p] + 1 else self._split(p, w, q)
        else:
            self.up[new] = 0
        return new

    def _state(self, span: int, step: dict[int, int]) -> int:
        self.span.append(span)
        self.step.append(step)
        self.up.append(0)
        self.items.append(set())
        return len(self.span) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.span[p] + 1, dict(self.step[q]))
        self.up[clone], self.up[q] = self.up[q], clone
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.up[p]
        return clone

    def _close(self, ends: list[tuple[int, object, int]]) -> None:
        """Marks each state with the items that have its runs as (part of) a window, and the short items that end there."""
        short: list[dict[int, set]] = [{} for _ in self.span]
        for state, item, length in ends:
            self.items[state].add(item)
            if length:
                short[state].setdefault(length, set()).add(item)
        for s in sorted(range(1, len(self.span)), key=self.span.__getitem__, reverse=True):
            if self.up[s] > 0 and self.span[self.up[s]] >= self.window:
                self.items[self.up[s]] |= self.items[s]
        self.short: list[dict[int, set]] = [{}] * len(self.span)
        for s in sorted(range(1, len(self.span)), key=self.span.__getitem__):
            above = self.short[self.up[s]]
            self.short[s] = above | short[s] if short[s] else above

    def windows_at(self, state: int, length: int) -> list[tuple[int, set]]:
        """(window length, items) of every window that ends here, given the longest match; the longest windows first."""
        found = []
        if length >= self.window:
            s = state
            while self.span[self.up[s]] >= self.window:
                s = self.up[s]
            found.append((self.window, self.items[s]))
        return found + [(n, x) for n, x in sorted(self.short[state].items(), reverse=True) if n <= length]

    def scan(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged [start, end) spans of hit words, and the items with windows that occur."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        step, up, span, short, window = self.step, self.up, self.span, self.short, self.window
        s = length = 0
        for i, w in enumerate(map(self.number.get, seq)):
            if w is None:
                s = length = 0
                continue
            while s and w not in step[s]:
                s = up[s]
                length = span[s]
            s = step[s].get(w, 0)
            length = length + 1 if s else 0
            if length >= window or short[s]:
                for n, found in self.windows_at(s, length):
                    items |= found
                    start = i + 1 - n
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, items


def load_items(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", max_item_words: int = 20_000_000) -> dict[str, list[bytes]]:
    """Item id (as text) -> words. The size is checked first; items with null ids are named by the empty string, repeated ids keep all their texts."""
    size = benchmark.agg(F.sum(F.length(text_col))).first()[0] or 0
    if size > 6 * max_item_words:
        raise ValueError(f"the benchmark has {size} characters; an automaton takes at most {6 * max_item_words}")
    items: dict[str, list[bytes]] = {}
    for r in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).distinct().toLocalIterator():
        items.setdefault(r["i"], []).append(words(r["t"]))
    return {(i, k): seq for i, texts in items.items() for k, seq in enumerate(texts)}


def contamination(benchmark: DataFrame, *, window: int = WINDOW, min_coverage: float = 0.05, max_span: int | None = None, with_text: bool = False) -> Callable[[Column], Column]:
    """A function over text columns, for one row a document: a struct of n_words, n_hit, longest_span, n_items, items (their ids
    as sorted strings), spans (of words, [start, end)), contaminated (hit words are at least `min_coverage` of all, or a span has
    more than `max_span` words), and with `with_text` cleaned_text: the text without its hit words if contaminated, else as it was.

    A null or empty text has no words and is clean. An empty benchmark leaves every document clean.
    """
    shared = benchmark.sparkSession.sparkContext.broadcast(Automaton(load_items(benchmark), window))
    share = round(1 / min_coverage)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    fields = {"n_words": pa.int64(), "n_hit": pa.int64(), "longest_span": pa.int64(), "n_items": pa.int64(), "items": pa.list_(pa.string()), "spans": spans_type, "contaminated": pa.bool_(), "cleaned_text": pa.string()}

    @F.arrow_udf("n_words long, n_hit long, longest_span long, n_items long, items array<string>, spans array<struct<start:long,end:long>>, contaminated boolean, cleaned_text string")
    def scan(texts: pa.Array) -> pa.Array:
        automaton, rows = shared.value, []
        for text in texts:
            text = text.as_py()
            seq = words(text)
            spans, found = automaton.scan(seq)
            hit, longest = sum(b - a for a, b in spans), max((b - a for a, b in spans), default=0)
            ids = sorted({i for i, _ in found})
            bad = hit > 0 and (share * hit >= len(seq) or max_span is not None and longest > max_span)
            cleaned = without_words(text, spans) if bad and with_text else text if with_text else None
            rows.append((len(seq), hit, longest, len(ids), ids, [{"start": a, "end": b} for a, b in spans], bad, cleaned))
        columns = zip(*rows, strict=True) if rows else [()] * len(fields)
        return pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(columns, fields.values(), strict=True)], names=list(fields))

    return scan


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the words of the spans, and what stands between them, cut out."""
    raw = text.encode("utf-8", "surrogatepass")
    spaced = raw.translate(_WORD_BYTES)
    bounds, at = [], 0
    for w in spaced.split():
        at = spaced.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    kept, last = [], 0
    for a, b in spans:
        kept.append(raw[last : bounds[a][0]])
        last = bounds[b - 1][1]
    return b"".join([*kept, raw[last:]]).decode("utf-8", "surrogatepass")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = contamination(table(spark, sf_dir, "benchmark"))
    found = table(spark, sf_dir, "documents").select("doc_id", scan("text").alias("found")).select("doc_id", "found.*")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), items AS (
  SELECT item_id, w, least(13, len(w)) AS size
  FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS k FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM items)
), places AS (
  SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS k
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT size FROM items))
), found AS (
  SELECT doc_id, item_id, p, size FROM places JOIN windows USING (size, k)
), hits AS (
  SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS word FROM (SELECT DISTINCT doc_id, p, size FROM found)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

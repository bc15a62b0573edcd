"""Matches of several patterns with their places, and which of them hide which.

Patterns are over folded text; every match keeps its folded and its raw place. Patterns may hide others: a match that lies inside
one of a hiding pattern is dropped. Hiding is decided by one window over a text's matches, whatever their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignment import fold_with_offsets, raw_span

#: Characters before a match that `not_after` is looked for in.
REACH = 24
COLUMNS = "place int, pattern string, start int, end int, raw_start int, raw_end int, matched string, raw string, groups map<string,string>, suffix string"


@dataclass(frozen=True)
class Pattern:
    """regex: over folded text. hides: names of patterns whose matches inside one of these are dropped. not_after: no match that
    this ends right before."""

    name: str
    regex: str
    hides: tuple[str, ...] = ()
    not_after: str | None = None


def find_spans(rows: DataFrame, key: list[str], text: str, patterns: list[Pattern], *, after: str | None = None, suffix: int = 700, until: str = ".") -> DataFrame:
    """key, place (the pattern's), pattern, start, end (in folded text), raw_start, raw_end, matched (folded), raw (as it stands in the
    text), groups (named, met), suffix (what follows in the folded text, up to `until` or `suffix` characters).

    With `after`, matching starts behind its first occurrence, if there is one. A null text has no matches; a null key stays null.
    """
    kinds = [rows.schema[k] for k in key]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + [COLUMNS])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(i, p, re.compile(p.regex), re.compile(p.not_after + r"\Z") if p.not_after else None) for i, p in enumerate(patterns)]
        for batch in batches:
            at: list[int] = []
            found: list[tuple] = []
            for row, value in enumerate(batch.column(len(key)).to_pylist()):
                folded, offsets = fold_with_offsets(value)
                begin = folded.find(after) if after else -1
                begin = begin + len(after) if begin >= 0 else 0
                begin += folded[begin : begin + 1] == " "
                for i, p, regex, guard in compiled:
                    for m in regex.finditer(folded, begin):
                        start, end = m.span()
                        if start == end or guard and guard.search(folded[max(begin, start - REACH) : start]):
                            continue
                        raw = raw_span(offsets, start, end)
                        groups = [(k, v) for k, v in m.groupdict().items() if v is not None]
                        at.append(row)
                        found.append((i, p.name, start, end, *raw, m.group(), value[raw[0] : raw[1]], groups, folded[end : end + suffix].split(until, 1)[0]))
            columns = zip(*found, strict=True) if found else [()] * 10
            types = [pa.int32(), pa.string(), *[pa.int32()] * 4, pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
            own = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(key))]
            names = [*key, "place", "pattern", "start", "end", "raw_start", "raw_end", "matched", "raw", "groups", "suffix"]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return rows.select(*key, text).mapInArrow(work, schema)


def drop_hidden(spans: DataFrame, key: list[str], patterns: list[Pattern]) -> DataFrame:
    """spans without those that lie inside a match of a pattern that hides theirs. A hidden match still hides others."""
    upto = Window.partitionBy(*key).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    hidden = F.lit(False)
    out, helpers = spans, []
    for p in patterns:
        if p.hides:
            helpers.append(f"__reach_{p.name}")
            out = out.withColumn(helpers[-1], F.max(F.when(F.col("pattern") == p.name, F.col("end"))).over(upto))
            hidden |= F.col("pattern").isin(*p.hides) & F.coalesce(F.col(helpers[-1]) >= F.col("end"), F.lit(False))
    return out.where(~hidden).drop(*helpers)

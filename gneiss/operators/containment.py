"""Which passages occur whole in which texts: one pass over each text, by an automaton of all passages."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contained(texts: DataFrame, passages: DataFrame, key: str, passage_key: str, *, text: str = "text", passage: str = "text", most_chars: int = 50_000_000) -> DataFrame:
    """passage_key, key: distinct pairs in which the text holds the whole passage. Empty passages occur nowhere.

    The passages' size is checked before they go to the executors; more than `most_chars` characters are refused.
    """
    size = passages.agg(F.sum(F.length(passage))).first()[0] or 0
    if size > most_chars:
        raise ValueError(f"passages of {size} characters; at most {most_chars}")
    held: dict[str, list[int]] = {}
    for r in passages.where(F.length(passage) > 0).select(F.col(passage_key).alias("i"), F.col(passage).alias("p")).toLocalIterator():
        held.setdefault(r["p"], []).append(r["i"])
    shared = texts.sparkSession.sparkContext.broadcast(held)
    built: list[ahocorasick.Automaton] = []

    @F.arrow_udf("array<long>")
    def find(column: pa.Array) -> pa.Array:
        if not built:
            a = ahocorasick.Automaton()
            for p, ids in shared.value.items():
                a.add_word(p, ids)
            a.make_automaton()
            built.append(a)
        return pa.array([sorted({i for _, ids in built[0].iter(t) for i in ids}) if t and held_any else [] for t in column.to_pylist()], pa.list_(pa.int64()))

    held_any = bool(held)
    return texts.select(key, F.explode(find(F.col(text))).alias(passage_key)).select(passage_key, key).distinct()

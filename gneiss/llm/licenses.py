"""License scans by diagonal voting, in DataFrame functions only.

Every run of K words of every document is hashed and joined to the runs of the license templates. A match at document word i
and template word j votes for the diagonal i - j. Diagonals of one template that lie next to each other (a word put in or left
out) are merged, and a merged span is accepted if the matched runs cover enough of the template's words. Templates are a small
fixed table, so they are what is broadcast. Phrases are templates of their own that must match whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, table

K = 3
#: Short phrases and the labels that they stand for.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Sentences of public licences' notices and the labels that they stand for.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
)


def words(text: str | Column) -> Column:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def template_runs(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """template, label, base, n_words, at, w0, w1, w2 (null in a phrase of two words) and the run's hash."""
    rows, seen = [], 0
    for base, group in ((True, phrases), (False, notices)):
        for text, label in group:
            own = text.split()
            k = min(K, len(own))
            rows += [(seen, label, base, len(own), at, *own[at : at + k], *[None] * (K - k)) for at in range(len(own) - k + 1)]
            seen += 1
    runs = spark.createDataFrame(rows, "template int, label string, base boolean, n_words int, at int, w0 string, w1 string, w2 string")
    return runs.withColumn("run", F.when(F.col("w2").isNull(), F.xxhash64("w0", "w1")).otherwise(F.xxhash64("w0", "w1", "w2")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and key: what tells documents apart; rows with the same id and text are the same document."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), words(text_col).alias("words"))


def votes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """A row for each place where a document's words are a template's run: id, key, pos, and the run's row."""
    runs = template_runs(docs.sparkSession, phrases, notices)
    at = _keyed(docs, id_col, text_col).select("id", "key", "words", F.posexplode("words").alias("pos", "d0"))
    at = at.select("id", "key", "pos", "d0", F.get("words", F.col("pos") + 1).alias("d1"), F.get("words", F.col("pos") + 2).alias("d2"))
    pair = sorted({t.split()[0] for t, _ in (*phrases, *notices) if len(t.split()) == 2})
    long = F.xxhash64("d0", "d1", "d2")
    keys = F.when(F.col("d0").isin(pair), F.array(long, F.xxhash64("d0", "d1"))).otherwise(F.array(long)) if pair else F.array(long)
    at = at.withColumn("run", F.explode(keys))
    same = (F.col("d0") == F.col("w0")) & (F.col("d1") == F.col("w1")) & (F.col("w2").isNull() | (F.col("d2") == F.col("w2")))
    return at.join(F.broadcast(runs), "run").where(same).drop("run", "d0", "d1", "d2", "w0", "w1", "w2")


def find_spans(voted: DataFrame, *, min_coverage: float = 0.75, max_shift: int = 3) -> DataFrame:
    """Accepted spans: id, key, template, label, base, start, end (words), coverage.

    Diagonals at most `max_shift` apart whose matches follow each other within as many words are one span.
    """
    one = ["id", "key", "template"]
    diagonal = (F.col("pos") - F.col("at")).alias("diagonal")
    each = voted.select(*one, "label", "base", "n_words", "pos", "at", diagonal).groupBy(*one, "label", "base", "n_words", "diagonal").agg(F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = Window.partitionBy(*one).orderBy("first", "diagonal")
    far = F.coalesce((F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > max_shift) | (F.col("first") - F.lag("last").over(order) > K + max_shift) | F.col("base"), F.lit(True))
    grouped = each.withColumn("far", far.cast("int")).withColumn("span", F.sum("far").over(order))
    merged = grouped.groupBy(*one, "label", "base", "n_words", "span").agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("first").alias("start"), F.max("last").alias("last"))
    run = F.least(F.lit(K), F.col("n_words"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + run - 1)))))
    spans = merged.withColumns({"coverage": covered / F.col("n_words"), "end": F.col("last") + run})
    return spans.where(F.col("coverage") >= F.when(F.col("base"), 1.0).otherwise(min_coverage)).drop("ats", "last", "span", "n_words")


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES, min_coverage: float = 0.75) -> DataFrame:
    """One row for each document (repeated rows each have theirs): id, n_words, spans (array of start, end, label, base,
    coverage, sorted) and score, the best span's coverage (0 without one). Null and empty texts have no words and no spans."""
    spans = find_spans(votes(docs, id_col=id_col, text_col=text_col, phrases=phrases, notices=notices), min_coverage=min_coverage)
    found = spans.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "base", "coverage"))).alias("spans"), F.max("coverage").alias("best"))
    all_ = _keyed(docs, id_col, text_col).select("id", "key", F.size("words").cast("long").alias("n_words")).alias("d")
    found = found.alias("f")
    joined = all_.join(found, F.col("d.id").eqNullSafe(F.col("f.id")) & F.col("d.key").eqNullSafe(F.col("f.key")), "left")
    none = F.array().cast("array<struct<start:int,end:int,label:string,base:boolean,coverage:double>>")
    return joined.select(F.col("d.id").alias(id_col), "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("best", F.lit(0.0)).alias("score"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"].cast("long"))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels("spans").alias("labels"), "score")

"""Cross-site boilerplate removal by line.

Each line's spread is the number of distinct sites (sources) that have it. Lines are hashed once. Those with at least `min_sites`
occurrences are aggregated by hash into a HyperLogLog sketch of their sites, merged before the shuffle, so a line on a third of all
documents costs a row a task. The estimate decides for lines far from the threshold; the sites of lines within `NEAR` of it are
counted exactly. At 2 ** LG_K registers the relative standard error is 2.3 %, so a line outside that range is on the wrong
side only if the estimate is off by more than 20 of these. Of a line that spreads over `min_sites` sites its first place is kept
(smallest id, then smallest position), so that no text is lost altogether; its other places are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, fresh, if_small, settle, table

MIN_SITES = 5
NEAR = 0.5
LG_K = 11
#: Places of one line that meet what is known of it in one lot.
LOT = 4096


def _lines(docs: DataFrame) -> DataFrame:
    """id, key, site, pos, and the line's hashes (two of 64 bits), for every line that isn't blank."""
    line = docs.select("id", "key", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = line.withColumn("line", F.trim(F.translate("line", "\t\r", "  "))).where("line != ''")
    return line.select("id", "key", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"))


def _prepared(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col, site_col).alias("key"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.col(text_col).alias("text"))


def _with_line(lines: DataFrame, known: DataFrame, *columns: str) -> DataFrame:
    """lines with what is known of them (h1, h2, n: occurrences, and columns), LOT or so places of a line at a time."""
    lots = F.ceil(F.col("n") / LOT).cast("int")
    hot = if_small(known.where(F.col("n") > LOT).select("h1", "h2", lots.alias("lots")))
    dealt = known.select("h1", "h2", *columns, F.explode(F.sequence(F.lit(0), lots - 1)).alias("lot"))
    lot = F.pmod(F.xxhash64("key", "pos"), F.coalesce("lots", F.lit(1))).cast("int")
    return lines.join(hot, ["h1", "h2"], "left").withColumn("lot", lot).drop("lots").join(dealt, ["h1", "h2", "lot"]).drop("lot")


def boilerplate(lines: DataFrame, *, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """h1, h2, n (occurrences), first (the place that stays: id, pos, key) of the lines on at least `min_sites` sites."""
    often = settle(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites), "often")
    found = _with_line(lines, often, "n").groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(F.struct("id", "pos", "key")).alias("first"), F.max("n").alias("n"))
    spread = settle(found.select("h1", "h2", "n", "first", F.hll_sketch_estimate("sketch").alias("sites")), "spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + near))
    close = spread.where(F.col("sites").between(min_sites * (1 - near), min_sites * (1 + near)))
    sites = _with_line(lines, close).groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
    exact = sites.groupBy("h1", "h2").agg(F.count("*").alias("exact")).where(F.col("exact") >= min_sites)
    out = settle(sure.select("h1", "h2", "n", "first").union(close.join(exact, ["h1", "h2"]).select("h1", "h2", "n", "first")), "boilerplate")
    forget(often, spread)
    return out


def without_lines(text: Column, removed: Column) -> Column:
    """text without the lines at the places in `removed` (sorted, from 0), in time linear in the text."""
    starts, ends = F.concat(F.array(F.lit(0)), F.transform(removed, lambda x: x + 1)), lambda p: F.concat(removed, F.array(F.size(p)))
    kept = F.transform(F.array(F.split(text, "\n")), lambda p: F.flatten(F.zip_with(starts, ends(p), lambda a, b: F.slice(p, a + 1, b - a))))
    return F.array_join(kept[0], "\n")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """All columns of docs, with the text without its boilerplate lines, and __n_lines and __n_removed (of the text's lines; columns
    of docs with these names are replaced).

    Lines are parts between line feeds; they are compared without spaces, tabs and carriage returns at their ends, and blank
    ones are never removed. A null text stays null and has no lines; a null site counts as one site of its own. Rows with the same
    id, text and site are one document here: they keep or lose the same lines. Rows without a removed line stay as they are.
    """
    own = _prepared(docs, id_col, text_col, site_col)
    lines = settle(_lines(own.where("text is not null")), "lines")
    spread = boilerplate(lines, min_sites=min_sites)
    hit = _with_line(lines, spread, "first").where(~F.struct("id", "pos", "key").eqNullSafe(F.col("first")))
    names = {c: fresh(docs, f"__{c}") for c in ("id", "key", "removed")}
    removed = hit.groupBy("id", "key").agg(F.array_sort(F.collect_set("pos")).alias("removed")).withColumnsRenamed(names)
    text, gone = F.col(text_col), F.col(names["removed"])
    joined = docs.join(removed, F.col(id_col).eqNullSafe(F.col(names["id"])) & (F.xxhash64(text_col, site_col) == F.col(names["key"])), "left")
    n: Column = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    out = [F.when(gone.isNotNull(), without_lines(text, gone)).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("__n_lines", "__n_removed")]
    return joined.select(*out, n.alias("__n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("__n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, source, unnest(range(len(parts))) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)
), named AS (
  SELECT doc_id, coalesce(source, '') AS source, pos, line, trim(translate(line, chr(9) || chr(13), '  ')) AS k FROM lines
), spread AS (
  SELECT k, min(struct_pack(d := doc_id, p := pos)) AS first FROM named WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 5
), marked AS (
  SELECT n.*, s.k IS NOT NULL AND struct_pack(d := n.doc_id, p := n.pos) <> s.first AS gone FROM named n LEFT JOIN spread s USING (k)
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(k.text) END AS text_md5
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

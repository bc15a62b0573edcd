"""Cases' rows are dealt out once, and texts are folded once."""

import pytest
from pyspark.sql import functions as F

from gneiss.functions.text import ACCENTED, BASE, fold
from gneiss.operators import compound as P
from gneiss.plans import compound_queries


@pytest.mark.parametrize("name", sorted(compound_queries.QUERIES))
def test_rows_are_dealt_out_by_case_alone(spark, sf, name):
    plan = compound_queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    by = {line.split("hashpartitioning(")[1].split(",")[0].split("#")[0] for line in plan.splitlines() if "hashpartitioning(" in line}
    assert "l_orderkey" in by and not any(x in line for line in plan.splitlines() if "hashpartitioning(" in line for x in ("l_linenumber", "citation", "field"))


def test_family_folds_its_text_once(spark):
    plan = spark.createDataFrame([("x",)], "c string").select(P.family(F.col("c"), compound_queries.FAMILIES).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 1


def test_folding_is_as_it_was(spark):
    texts = ["Điều 5", " a\t b\n\nc ", "éa ́ x", "ÀẤỆ  đĐ", "", None, " a  b", "\t"]
    c = F.col("c")
    before = F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.translate(c, ACCENTED, BASE), "[\\u0300-\\u036f]", "")), r"\s+", " "))
    bare = F.trim(F.regexp_replace(before, "[^a-z0-9]+", " "))
    rows = spark.createDataFrame([(t,) for t in texts], "c string").select(before.alias("b"), fold(c).alias("f"), bare.alias("w"), P._words(fold(c)).alias("x")).collect()
    assert [(r["b"], r["w"]) for r in rows] == [(r["f"], r["x"]) for r in rows]

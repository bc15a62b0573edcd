"""A function that takes a second argument gets an element's place in F.transform."""

from pyspark.sql import functions as F

from gneiss.functions.text import sentences
from gneiss.plans.structure_queries import chunk_pack


def test_lines_are_trimmed_of_spaces_and_keep_their_last_digit(spark, tmp_path):
    spark.createDataFrame([(1, "s", "  call 555-8630\nnext 1 \n code 12"), (2, "s", " \n  ")], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    whole = "call 555-8630\nnext 1\ncode 12"
    wanted = spark.createDataFrame([(whole,)], "t string").select(F.md5(F.col("t").cast("binary"))).first()[0]
    assert [tuple(r) for r in chunk_pack(spark, str(tmp_path)).collect()] == [(1, 0, len(whole), wanted)]


def test_sentences_keep_their_last_digit(spark):
    df = spark.createDataFrame([("Line 10; line 21.  Is it 2",)], "t string")
    assert df.select(sentences(F.col("t"))).first()[0] == ["Line 10;", "line 21.", "Is it 2"]

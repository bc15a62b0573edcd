"""Where rows come from and go to: Parquet tables, whole text files, JSON lines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean, fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the folder that driver and executors share (spark.checkpoint.dir; a temporary one in local mode, where
    that is unset) and reads it again: plans that use it several times stay short, and lost executors cost nothing twice."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="gneiss-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """source_file, page_number, text: each whole file as one cleaned page."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_file"), F.col("value").alias("text"))
    return raw.select("source_file", F.lit(1).alias("page_number"), clean(F.col("text")).alias("text"))


def pick_sources(candidates: DataFrame) -> DataFrame:
    """candidates: path, title, text. One row for each title key: whole files before extracts (a title in brackets or with
    'extract'), then the longest text, then the path."""
    key = fold(F.regexp_replace("title", r"\(.*?\)", ""))
    partial = F.lower("title").contains("extract") | F.lower("path").contains("extract")
    best = Window.partitionBy("key").orderBy("partial", F.desc(F.length("text")), "path")
    ranked = candidates.withColumns({"key": key, "partial": partial}).withColumn("place", F.row_number().over(best))
    return ranked.where("place = 1").drop("place")


def missing_files(spark: SparkSession, found: DataFrame, expected: list[str]) -> DataFrame:
    """The expected names that no row of `found` (name) has."""
    return spark.createDataFrame([(x,) for x in expected], "name string").join(found.select("name"), "name", "left_anti")


def write_records(rows: DataFrame, path: str) -> None:
    """JSON lines, one object a row."""
    rows.write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; bad lines fail rather than turn null."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)

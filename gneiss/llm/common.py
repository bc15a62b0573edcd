"""What the corpus operators share: tables, the shared folder, id folds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one, in local mode (tests) only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gneiss-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: lineage is cut and lost executors cost nothing twice."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*settled: DataFrame) -> None:
    """Deletes tables that `settle` has returned and that nothing reads any more."""
    for df in settled:
        jvm = df.sparkSession._jvm
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, or with underscores at its end if df has a column of that name (in whatever case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % modulus


def lower_ascii(text: str | Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows up to which a settled table of a few numbers a row is broadcast.
SMALL = 250_000


def shuffled(df: DataFrame) -> DataFrame:
    """df, to be joined by shuffles. Spark takes a settled table's compressed bytes for its size, and would broadcast tables of
    a million rows, which the driver has to hold many times as large."""
    return df.hint("merge")


def if_small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows (counted, so give settled tables); a larger one is joined by shuffles."""
    return F.broadcast(df) if df.count() <= most else df

"""Token counts of the documents in flat token files, by a separator scan.

A flat file is a row of token ids without an index; documents end with a separator id. The file is read in blocks of equal
size that know nothing of documents. Each block is searched for the separator in one vectorised comparison; a prefix scan over
the blocks then gives each block's first position in its file, the number of separators before it, and where the last one
stood, which is what a document cut by block borders needs. The scan has two levels (runs of blocks, then blocks in a run), so
a file of any length meets in no one task.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import VOCABULARY, encoder
from .common import settle, shared_dir, table

BLOCK_TOKENS = 1 << 18
RUN = 256
SEPARATOR = 50256
WRITE_BYTES = 1 << 20


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme, or with file:, is a folder's on all machines."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def blocks_of(files: DataFrame, *, token_bytes: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, tokens of flat files of little-endian ids, listed as (file, length in bytes). Only the list is shuffled: tasks
    read the byte ranges that they are dealt. A file's last block may be shorter; a file of no bytes has no block; one whose length
    is no multiple of an id's, or that ends before its listed length, fails."""
    size = block_tokens * token_bytes
    odd = F.raise_error(F.concat(F.lit("not a whole number of ids: "), "file")).cast("long")
    length = F.when(F.col("length") % token_bytes == 0, F.col("length")).otherwise(odd)
    listed = files.select("file", length.alias("length")).where("length > 0")
    at = listed.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block"))
    at = at.select("file", "block", F.least(F.lit(size), F.col("length") - F.col("block") * size).alias("n_bytes")).repartition("file", "block")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                where, path = _at(row["file"])
                with where.open_input_file(path) as f:
                    raw = f.read_at(row["n_bytes"], row["block"] * size)
                if len(raw) != row["n_bytes"]:
                    raise ValueError(f"{row['file']} ends before its listed length")
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]]), pa.array([row["block"]], pa.int64()), pa.array([raw], pa.binary())], names=["file", "block", "tokens"])

    return at.mapInArrow(work, "file string, block long, tokens binary")


def read_token_files(spark: SparkSession, path: str, *, token_bytes: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """blocks_of the files that Spark finds at a path; they may have any length, and are only listed here."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    return blocks_of(files, token_bytes=token_bytes, block_tokens=block_tokens)


def write_token_files(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR, token_bytes: int = 2, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokenises documents into flat files of little-endian ids in a shared folder, each document followed by the separator.

    Returns (file, length, ordinal, id): for each file one row with its length in bytes, and one row for each document with its
    place in the file. A task writes one file, under a name of its own for each attempt, so that only files of attempts whose rows
    were kept are listed. A null text is empty. The separator's string in a text is ordinary text here, so that it ends no
    document. An id that does not fit token_bytes fails.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    dtype, most = f"<u{token_bytes}", 1 << (8 * token_bytes)
    if separator >= most:
        raise ValueError(f"separator {separator} does not fit {token_bytes} bytes")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.array([separator], dtype=dtype).tobytes()
        file = posixpath.join(folder, f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}.tokens")
        where, path = _at(file)
        where.create_dir(posixpath.dirname(path), recursive=True)
        length, ordinal, id_type = 0, 0, None
        with where.open_output_stream(path) as out:
            for batch in batches:
                held, id_type, n = bytearray(), batch.column(0).type, batch.num_rows
                for text in batch.column(1):
                    text = text.as_py()
                    if text:
                        ids = np.frombuffer(enc.ids(text), dtype="<u4")
                        if len(ids) and ids.max() >= most:
                            raise ValueError(f"id {ids.max()} does not fit {token_bytes} bytes")
                        held += ids.astype(dtype).tobytes()
                    held += end
                    if len(held) >= WRITE_BYTES:
                        out.write(bytes(held))
                        length += len(held)
                        held.clear()
                out.write(bytes(held))
                length += len(held)
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.nulls(n, pa.int64()), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column(0)], names=["file", "length", "ordinal", "id"])
                ordinal += n
        if ordinal:
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([length], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, id_type)], names=["file", "length", "ordinal", "id"])
        else:
            where.delete_file(path)

    return settle(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(work, f"file string, length long, ordinal long, id {kind}"), "tokens")


def scan_blocks(blocks: DataFrame, *, separator: int = SEPARATOR, token_bytes: int = 2) -> DataFrame:
    """file, block, n (tokens), ends: the separators' positions in the block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ends = [], []
            for raw in b.column(2):
                ids = np.frombuffer(raw.as_buffer(), dtype=f"<u{token_bytes}")
                n.append(len(ids))
                ends.append(np.flatnonzero(ids == separator))
            lists = pa.array(ends, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), lists], names=["file", "block", "n", "ends"])

    return blocks.select("file", "block", "tokens").mapInArrow(work, "file string, block long, n long, ends array<long>")


def stitch(scanned: DataFrame) -> DataFrame:
    """file, ordinal, start, n_tokens (without the separator), complete: the documents of scanned blocks, whichever borders cut
    them. What follows a file's last separator is a document that isn't complete, if it has tokens."""
    each = scanned.withColumns({"run": F.floor(F.col("block") / RUN), "n_ends": F.size("ends").cast("long"), "last": F.array_max("ends")})
    in_run = Window.partitionBy("file", "run").orderBy("block")
    before = in_run.rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({"at": F.coalesce(F.sum("n").over(before), F.lit(0)), "ordinal": F.coalesce(F.sum("n_ends").over(before), F.lit(0))})
    each = each.withColumn("since", F.max(F.col("at") + F.col("last")).over(before))
    runs = each.groupBy("file", "run").agg(F.sum("n").alias("run_n"), F.sum("n_ends").alias("run_ends"), F.max(F.col("at") + F.col("last")).alias("run_last"))
    of_file = Window.partitionBy("file").orderBy("run")
    earlier = of_file.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"run_at": F.coalesce(F.sum("run_n").over(earlier), F.lit(0)), "run_ordinal": F.coalesce(F.sum("run_ends").over(earlier), F.lit(0))})
    runs = runs.withColumn("run_since", F.max(F.col("run_at") + F.col("run_last")).over(earlier)).select("file", "run", "run_at", "run_ordinal", "run_since", F.lead("run").over(of_file).isNull().alias("final"))
    full = each.join(runs, ["file", "run"])
    full = full.select("file", "block", "n", "ends", F.col("run_at").alias("base"), (F.col("run_at") + F.col("at")).alias("at"), (F.col("run_ordinal") + F.col("ordinal")).alias("ordinal"), F.coalesce(F.col("run_at") + F.col("since"), F.col("run_since"), F.lit(-1)).alias("since"), (F.col("final") & F.lead("block").over(in_run).isNull()).alias("final"))
    ended = full.select("file", "at", "ordinal", "since", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("since") + 1).otherwise(F.col("at") + F.get("ends", F.col("i") - 1) + 1)
    whole = ended.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("at") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("complete"))
    tail_start = F.coalesce(F.col("at") + F.array_max("ends"), F.col("since")) + 1
    tail = full.where("final").select("file", (F.col("ordinal") + F.size("ends")).alias("ordinal"), tail_start.alias("start"), (F.col("at") + F.col("n") - tail_start).alias("n_tokens"), F.lit(False).alias("complete")).where("n_tokens > 0")
    return whole.union(tail)


def count_tokens(blocks: DataFrame, *, separator: int = SEPARATOR, token_bytes: int = 2) -> DataFrame:
    """The documents of flat token files, given as blocks (file, block, tokens): see stitch. Empty input gives no rows; a
    separator right after another one, or first in a file, ends a document of no tokens."""
    return stitch(settle(scan_blocks(blocks, separator=separator, token_bytes=token_bytes), "separators"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes documents as flat token files, forgets where they end, and counts them by their separators. A document that the
    files don't have fails."""
    written = write_token_files(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/flat-{uuid.uuid4().hex}")
    found = count_tokens(blocks_of(written.where("ordinal is null")))
    lost = F.raise_error(F.concat(F.lit("no document at "), "file", F.lit(" "), F.col("ordinal").cast("string"))).cast("long")
    return written.where("ordinal is not null").join(found, ["file", "ordinal"], "left").select(F.col("id").alias("doc_id"), F.coalesce("n_tokens", lost).alias("n_tokens"))

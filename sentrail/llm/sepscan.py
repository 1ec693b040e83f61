"""Token counts from flat, unindexed token files.

A token file is nothing but 16-bit little-endian ids, document after document, each closed by the separator id.
The files are cut into blocks of equal size, which are scanned independently: one vectorised comparison gives the
positions of the separators of a block. Documents that cross block borders are stitched by a prefix scan: the last
separator before a block (running maximum) and the number of separators before it (running sum). The scan has two
levels, blocks within a run of ``RUN`` blocks and runs within a file, so even a single huge file is spread.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from sentrail.llm._text import chunks, shared_dir, tidily, written
from sentrail.llm._tokens import SEPARATOR, encoder, vocabulary

BLOCK = 1 << 20  # tokens
RUN = 1024  # blocks
FILE = StructType([StructField("path", StringType()), StructField("bytes", LongType())])
_BLOCK = StructType([StructField(c, LongType()) for c in ("block", "tokens", "n")] + [StructField("at", ArrayType(LongType())), StructField("path", StringType())])


def write_token_files(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", path: str | None = None, separator: int = SEPARATOR, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Encodes all texts and writes one flat file for each task into the shared folder.

    Returns the files (path and bytes) and the order of the documents in them (path, doc_no, doc_id). A null or
    empty text is a separator alone; the separator's own string in a text is encoded as ordinary text, so no document
    can hold its id. A file is named after the attempt of its task, and only those of the attempts that Spark
    accepted are in the tables: repeated and lost attempts clash with nothing and are never read.
    """
    spark = docs.sparkSession
    path = path or vocabulary()
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"

    def run(batches):
        from pyarrow import fs

        where = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{where.partitionId():06d}-{where.taskAttemptId()}.bin"
        size, count, enc, end = 0, 0, encoder(path, None), np.uint16(separator).tobytes()

        def rows(ids, size=None):
            n = len(ids)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * n), pa.array([size] * n, pa.int64()), pa.array(range(count, count + n), pa.int64()), ids], names=["path", "bytes", "doc_no", "doc_id"])

        with store.open_output_stream(f"{base}/{name}") as out:
            for batch in batches:
                for part in chunks(batch, "text"):
                    raw = b"".join(x for value in part.column(1).to_pylist() for x in (enc.raw(value) if value else b"", end))
                    out.write(raw)
                    size += len(raw)
                    yield rows(part.column(0))
                    count += part.num_rows
                kind = batch.schema.field(0).type
        if count:
            yield rows(pa.nulls(1, kind), size)

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    both = written(source.mapInArrow(tidily(run), f"path string, bytes long, doc_no long, doc_id {kind}"))
    return both.where("bytes is not null").select("path", "bytes"), both.where("bytes is null").select("path", "doc_no", "doc_id")


def _scan(block: int, separator: int):
    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    f.seek(2 * block * k)
                    ids = np.frombuffer(f.read(2 * block), dtype="<u2")
                at = np.flatnonzero(ids == separator) + block * k
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([at], pa.list_(pa.int64())), pa.array([path], pa.string())], names=_BLOCK.names)

    return run


def scan_token_files(files: DataFrame, *, separator: int = SEPARATOR, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """Documents of token files (rows of ``path`` and ``bytes``), found by their separators alone.

    Returns one row for each document: file (last part of the path), doc_no (from 0), start (first token in the
    file), n_tokens (without the separator), closed (false for tokens after the last separator of a file).

    An empty file has no documents; an empty document has n_tokens 0. Files with an odd number of bytes are an error.
    Rows with a null path are left out; a path that is given twice is scanned once.
    """
    files = files.where("path is not null").select("path", F.when(F.col("bytes") % 2 == 0, F.col("bytes")).otherwise(F.raise_error("a token file has an odd size")).alias("bytes")).distinct()
    blocks = files.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("bytes") - 1) / (2 * block)).cast("long"))).alias("block"))
    found = written(blocks.repartition("path", "block").mapInArrow(tidily(_scan(block, separator)), _BLOCK))
    heads = found.select("path", "block", (F.col("block") / run).cast("long").alias("run"), "n", F.try_element_at("at", F.lit(-1)).alias("last"))
    runs = heads.groupBy("path", "run").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    up = Window.partitionBy("path").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("path", "run", F.sum("n").over(up).alias("run_n"), F.max("last").over(up).alias("run_last"))
    within = Window.partitionBy("path", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("path", "run", "block", F.sum("n").over(within).alias("n_before"), F.max("last").over(within).alias("last_before"))
    none = F.lit(-1).cast("long")
    carry = heads.join(runs, ["path", "run"]).select(
        "path", "block", (F.coalesce("n_before", F.lit(0)) + F.coalesce("run_n", F.lit(0))).alias("doc_base"), F.coalesce("last_before", "run_last", none).alias("carry")
    )
    at = found.join(carry, ["path", "block"])
    starts = F.concat(F.array("carry"), F.col("at"))
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    closed = at.select(name, "doc_base", F.posexplode(F.arrays_zip(starts.alias("a"), F.col("at").alias("b")))).where("col.b is not null")
    closed = closed.select("file", (F.col("doc_base") + F.col("pos")).alias("doc_no"), (F.col("col.a") + 1).alias("start"), (F.col("col.b") - F.col("col.a") - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    final = files.select("path", "bytes", ((F.col("bytes") - 1) / (2 * block)).cast("long").alias("block"))
    total = final.where("bytes > 0").join(at, ["path", "block"])
    last = F.coalesce(F.try_element_at("at", F.lit(-1)), F.col("carry"))
    end = (F.col("bytes") / 2).cast("long")
    open_ = total.select(name, (F.col("doc_base") + F.col("n")).alias("doc_no"), (last + 1).alias("start"), (end - last - 1).alias("n_tokens"), F.lit(False).alias("closed")).where("n_tokens > 0")
    return closed.unionByName(open_)


def count_tokens(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """Writes the documents as token files and counts their tokens by scanning the files.

    Returns what ``scan_token_files`` does, with the doc_id of each document. The table may be empty, texts null or
    empty, ids null or repeated (one row for each row); other columns are not read. Files are read in blocks by all
    tasks.
    """
    files, order = write_token_files(docs, text=text, doc_id=doc_id, path=path)
    order = order.select(F.element_at(F.split("path", "/"), -1).alias("file"), "doc_no", F.col("doc_id").alias("id"))
    return scan_token_files(files).join(order, ["file", "doc_no"]).select(F.col("id").alias(doc_id), "file", "doc_no", "start", "n_tokens", "closed")

"""The folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, in local mode alone, a folder of our own where it is unset."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"/tmp/checkpoints/{uuid.uuid4().hex}")
        set_to = spark.sparkContext.getCheckpointDir()
    return set_to.rstrip("/")


#: Tables of a few numbers shrink to some bytes a row, so sizes in bytes give a task far too many of their rows.
NARROW = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m", "spark.sql.files.maxPartitionBytes": "16m"}
PARTITIONS, ROWS_A_PARTITION = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", 1_000_000


@contextmanager
def settings(spark: SparkSession, given: dict[str, str]) -> Iterator[None]:
    """Settings that hold for what runs inside, and are as before after it."""
    was = {k: spark.conf.get(k, None) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, path: str | None = None, narrow: int | None = None, piece: int | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here and lost executors cost nothing.

    ``narrow``: about how many rows of a few numbers are shuffled; tasks then take few bytes, so that the rows of a task
    don't grow with the table. ``piece``: into how many bytes files can be split when they are read.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    given = {CLEANUP: "true"}  # shuffles of this write serve nothing else; their files go when it ends
    if narrow is not None:
        given |= NARROW | {PARTITIONS: str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), narrow // ROWS_A_PARTITION))}
    with settings(spark, given):
        (df.write if piece is None else df.write.option("parquet.block.size", piece)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Named tables of one job in the shared folder; a table that nothing reads any more can be dropped before the job ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/job-{uuid.uuid4().hex}"

    def keep(self, name: str, pieces: list[DataFrame]) -> DataFrame:
        """Writes the pieces of a table one after another, so that their shuffles never take up disk together."""
        for k, piece in enumerate(pieces):
            written(piece, f"{self.folder}/{name}/{k}")
        return self.spark.read.schema(pieces[0].schema).parquet(*[f"{self.folder}/{name}/{k}" for k in range(len(pieces))])

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

"""Centroid clustering over integer vectors with an incremental distance matrix.

Every vector keeps its exact dot products with all centroids. When centroids move, only the components of a centroid
that changed are multiplied again: ``x . c' = x . c + sum over changed j of x[j] * (c'[j] - c[j])``. A centroid that did
not move costs nothing, and squared distances follow as ``|x|^2 - 2 x . c + |c|^2``. The matrix lives in a table in the
shared folder, rewritten by every round; the driver sees one row for each centroid and nothing for each vector.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from sentrail.llm._text import numbered, tidily
from sentrail.sources.shared import Scratch

K, ROUNDS, DIMS, SCALE, SALT = 40, 5, 64, 256, "2:"
#: Larger components could take a squared distance past 64 bits at 64 components.
LARGEST = 1 << 27
BATCH = 4096  # rows at a time in a task


def integers(vec: Column, dims: int, scale: int) -> Column:
    """The vector as integers floor(scale * x); null unless it has ``dims`` components, all of them finite numbers."""
    wide = F.transform(vec, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fits = lambda x: F.when(F.abs(x * scale) < LARGEST, F.floor(x * scale).cast("int")).otherwise(F.raise_error("a component is too large for 64-bit distances").cast("int"))
    return F.when((F.size(vec) == dims) & ~bad, F.transform(wide, fits))


def _advance(change: np.ndarray, squares: np.ndarray, fields: StructType):
    """A function over batches that adds the centroids' changes to the dot products and assigns every vector again."""
    moved = [(k, np.flatnonzero(row), row[np.flatnonzero(row)]) for k, row in enumerate(change) if row.any()]
    k_all, dims = change.shape

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                n = batch.num_rows
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dims).astype(np.int64)
                old = batch.column(2).flatten().to_numpy(zero_copy_only=False)
                dots = old.reshape(n, k_all).copy() if len(old) else np.zeros((n, k_all), np.int64)
                for k, at, by in moved:
                    dots[:, k] += x[:, at] @ by
                distance = (x * x).sum(axis=1)[:, None] - 2 * dots + squares
                best = distance.argmin(axis=1)  # the first of equals
                offsets = lambda width: pa.array(np.arange(0, (n + 1) * width, width), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(offsets(dims), pa.array(x.ravel(), pa.int32())), pa.ListArray.from_arrays(offsets(k_all), pa.array(dots.ravel())), pa.array(best, pa.int32()), pa.array(distance[np.arange(n), best])],
                    names=fields.names,
                )

    return tidily(run)


def _floor_means(rows: list, dims: int) -> dict[int, list[int]]:
    return {r.cluster: [r[f"s{j}"] // r.n for j in range(dims)] for r in rows}


def cluster(vectors: DataFrame, *, vec: str = "embedding", vec_id: str = "vec_id", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """Assigns every kept vector to one of at most ``k`` centroids after ``rounds`` rounds, in exact integers.

    Kept are vectors with exactly ``dims`` components, none of them null or not finite; a null vector is not kept.
    The centroids start as the kept vectors with the smallest SHA-256 of ``salt`` and the id; a null id comes after all
    others, repeated ids in the order of their vectors. Each round assigns all vectors (squared distance; ties take the
    smaller number) and moves every centroid that has vectors to the floor of their means. A last assignment follows.

    Returns vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for each kept row; repeated rows
    stay rows, other columns are not read, and an empty table gives none. With fewer kept vectors than ``k`` all of
    them are centroids. Components of 2**27 and more after scaling are an error, as their distances pass 64 bits.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows, (the_vec, the_id) = numbered(vectors, vec, vec_id)
    kept = rows.select(F.col(the_id).alias("id"), integers(F.col(the_vec), dims, scale).alias("x")).where("x is not null")
    state = scratch.keep("kept", [kept.withColumn("dots", F.array().cast("array<long>"))])
    key = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    centre = np.array([r.x for r in state.select("x", key.alias("key")).orderBy(F.asc_nulls_last("key"), "x").limit(k).collect()], dtype=np.int64).reshape(-1, dims)
    schema = StructType([state.schema["id"], StructField("x", ArrayType(IntegerType())), StructField("dots", ArrayType(LongType())), StructField("cluster", IntegerType()), StructField("distance", LongType())])
    if not len(centre):
        return _result(spark.createDataFrame([], schema), [], vec_id)
    before, held = np.zeros_like(centre), "kept"
    for turn in range(rounds + 1):
        assigned = state.select("id", "x", "dots").mapInArrow(_advance(centre - before, (centre * centre).sum(axis=1), schema), schema)
        state = scratch.keep(f"round{turn}", [assigned])
        scratch.drop(held)
        held, before = f"round{turn}", centre
        if turn < rounds:
            sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("x")[j]).alias(f"s{j}") for j in range(dims)]).collect()
            means = _floor_means(sums, dims)
            centre = np.array([means.get(c, old) for c, old in enumerate(centre.tolist())], dtype=np.int64)
    return _result(state, centre.tolist(), vec_id)


def _result(state: DataFrame, centres: list[list[int]], vec_id: str) -> DataFrame:
    """Joins the assignment with the few rows that tell of the clusters."""
    inertia = {r.cluster: r.s for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(inertia.values())
    told = [(c, inertia[c], total, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centres) if c in inertia]
    clusters = state.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = state.select("id", "cluster", "distance").join(F.broadcast(clusters), "cluster")  # one row for each centroid
    return found.select(F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

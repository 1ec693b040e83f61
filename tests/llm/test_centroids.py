"""Centroid clustering against plain integers."""

import hashlib
import math
import random

import pytest

from sentrail.llm import centroids


def brute(rows, k, rounds, dims, scale, salt):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centre = [x for _, x in sorted(kept, key=key)[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x: min((far(x, c), n) for n, c in enumerate(centre))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in kept]
        for n in range(len(centre)):
            mine = [x for (_, x), o in zip(kept, of, strict=True) if o == n]
            if mine:
                centre[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    inertia = lambda n: sum(d for _, o, d in found if o == n)
    total = sum(d for _, _, d in found)
    return [(i, n, d, inertia(n), total, hashlib.sha256(",".join(map(str, centre[n])).encode()).hexdigest()) for i, n, d in found]


ORDER = lambda r: tuple((x is None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize(("k", "rounds"), [(5, 0), (5, 4), (90, 2)])
def test_against_plain(spark, k, rounds):
    """Bad vectors go; null and repeated ids, ties and more centroids than vectors are as defined."""
    rng = random.Random(k)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.0, rng.uniform(-1, 1)]) for _ in range(4)]) for i in range(60)]
    rows += [(7, rows[7][1])] * 3 + [(7, [0.1, 0.2, 0.3, 0.4]), (None, [0.1] * 4), (None, [0.3] * 4), (100, None), (101, []), (102, [0.1] * 3), (103, [0.1] * 5)]
    rows += [(104, [0.1, None, 0.2, 0.3]), (105, [math.nan, 0.0, 0.0, 0.0]), (106, [math.inf, 0.0, 0.0, 0.0]), (107, [-math.inf] * 4)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, `x.y` string")
    as_float = [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()]
    got = [tuple(r) for r in centroids.cluster(table, k=k, rounds=rounds, dims=4).collect()]
    assert sorted(got, key=ORDER) == sorted(brute(as_float, k, rounds, 4, 256, "2:"), key=ORDER)


def test_empty(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        got = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), dims=4)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0


def test_only_changes_are_multiplied():
    """A centroid that stays adds nothing, and a step adds what a full product would."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField, StructType

    fields = StructType([StructField(c, LongType()) for c in ("id", "x", "dots", "cluster", "distance")])
    rng = np.random.default_rng(0)
    x, old = rng.integers(-9, 9, (7, 3)), rng.integers(-9, 9, (2, 3))
    new = old.copy()
    new[1, 2] += 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(x.tolist()), pa.array((x @ old.T).tolist())], names=["id", "x", "dots"])
    (out,) = list(centroids._advance(new - old, (new * new).sum(axis=1), fields)([batch]))
    assert out.column(2).to_pylist() == (x @ new.T).tolist()
    assert out.column(4).to_pylist() == [min(((r - c) ** 2).sum() for c in new) for r in x]


def test_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 4)], "vec_id long, embedding array<float>"), dims=4).collect()

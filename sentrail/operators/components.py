"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrail.sources.shared import written


#: A key is hot if it has more rows than one in HOT of all, so there are no more hot keys than that, and more than LARGE.
HOT, LARGE = 2000, 500_000


def with_hot(rows: DataFrame, of_key: DataFrame, key: str, count: str) -> DataFrame:
    """Joins ``of_key`` (one row for each key, ``count`` the rows that it has) to all ``rows``.

    Hot keys are broadcast and their rows stay where they are; the others are joined by key. So a key that most rows
    have, like the smallest node of a large component, is in no single task.
    """
    total, most = of_key.agg(F.sum(count), F.max(count)).first()
    limit = max(LARGE, (total or 0) // HOT)
    if (most or 0) <= limit:
        return rows.join(of_key.drop(count), key)
    hot = of_key.where(F.col(count) > limit)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(of_key.where(F.col(count) <= limit), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest).drop(count)


def _star(edges: DataFrame, large: bool, hot: bool, size: int | None) -> DataFrame:
    """Links the neighbours of every node to the smallest of them.

    Neighbours are never gathered: the minimum is an aggregate that is joined back, by a broadcast for nodes of many
    neighbours, so a node of any degree is spread over tasks.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")).select("a", F.least("a", "m").alias("m"), "_n")
    if hot:
        least = written(least, narrow=size)
    linked = with_hot(both, least, "a", "_n") if hot else both.join(least.drop("_n"), "a")
    if large:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    down = linked.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, hot: bool = False) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); the component is its smallest node.

    Loops, repeated and reversed edges are allowed; edges with a null end are left out. ``hot``: nodes of
    very many neighbours are joined by a broadcast, for large components, and tasks are cut by their rows; ``edges``
    are then counted first, so they should be a table.
    """
    size, seen = 2 * edges.count() if hot else None, None  # the rows of a step at most
    now = written(edges.where("a != b").select("a", "b").distinct(), narrow=size)
    while True:
        now = written(_star(_star(now, True, hot, size), False, hot, size), narrow=size)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
    return written(found, narrow=size) if hot else found

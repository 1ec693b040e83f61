"""Positions and running totals of rows in the order of their group, and as-of joins, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrail.sources.shared import written


def ranked(df: DataFrame, key: str, order: list[str], name: str = "n") -> DataFrame:
    """Adds the place (from 1) of every row in its group by ``order``, and the size of the group as ``{name}_of``.

    Rows are dealt by ranges of (key, order) and numbered within their range; what the ranges before hold is added from
    one total for each range and key. So a group of any size is spread over tasks.
    """
    dealt = written(df.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order))
    total = dealt.groupBy(key, "_range").agg(F.count("*").alias("_rows"))
    of_key = Window.partitionBy(key)
    before = F.sum("_rows").over(of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    base = total.select(F.col(key).alias("_key"), F.col("_range").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(of_key).alias(f"{name}_of"))
    found = dealt.withColumn("_within", within).join(base, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of")))
    return found.withColumn(name, F.col("_before") + F.col("_within")).drop("_range", "_within", "_key", "_of", "_before")


def before(df: DataFrame, key: str, order: list[str], most: int, also: list[str]) -> DataFrame:
    """Adds ``before``: of the ``most`` rows (at most) before a row in its group by ``order``, these and columns ``also``.

    The last rows of a group in a range are laid into the next range that has rows of it, so a group of any size is
    spread over tasks and nothing is joined but the few groups that go on from range to range. ``order`` must end with an
    id; null keys are left out.
    """
    dealt = written(df.where(F.col(key).isNotNull()).repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))
    spans = written(dealt.groupBy(key, "_range").agg(F.count("*").alias("_rows")).withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n > 1").select(key, "_range"))  # two for each border of ranges at most
    down = [F.desc(c) for c in order]
    last = Window.partitionBy(key, "_range").orderBy(*down)
    ends = dealt.join(F.broadcast(spans), [key, "_range"]).withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= most).drop("_n")
    later = spans.select(key, F.col("_range").alias("_to"))
    carried_on = ends.join(F.broadcast(later), key).where("_range < _to").withColumn("_n", F.row_number().over(Window.partitionBy(key, "_to").orderBy(*down))).where(F.col("_n") <= most)
    laid = carried_on.drop("_n", "_range").withColumnRenamed("_to", "_range").withColumn("_laid", F.lit(True))
    rows = Window.partitionBy(key, "_range").orderBy(*order).rowsBetween(-most, -1)
    both = dealt.withColumn("_laid", F.lit(False)).unionByName(laid)
    return both.withColumn("before", F.collect_list(F.struct(*order, *also)).over(rows)).where("NOT _laid").drop("_laid", "_range")


def carried(df: DataFrame, key: str, order: list[str], sums: dict[str, Column], maxima: dict[str, Column] | None = None) -> DataFrame:
    """Adds, for every row, sums and maxima over the rows of its key that come before it by ``order``.

    Rows are dealt by ranges of (key, order). Each range adds up its own rows; what earlier ranges hold of a key is
    carried in from one total for each range and key, so a key of any size is spread over tasks. Rows that are equal in
    ``order`` come in any order: end it with an id. A sum of no rows is 0, a maximum of none null, and so for null keys.
    """
    maxima = maxima or {}
    parts = {f"_s_{c}": x for c, x in sums.items()} | {f"_m_{c}": x for c, x in maxima.items()}
    dealt = written(df.withColumns(parts).repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))
    rows = Window.partitionBy(key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    total = dealt.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_of")).agg(*[F.sum(f"_s_{c}").alias(f"_t_{c}") for c in sums], *[F.max(f"_m_{c}").alias(f"_u_{c}") for c in maxima])
    base = total.select("_key", "_of", *[F.sum(f"_t_{c}").over(ranges).alias(f"_b_{c}") for c in sums], *[F.max(f"_u_{c}").over(ranges).alias(f"_c_{c}") for c in maxima])
    own = dealt.withColumns({f"_p_{c}": F.sum(f"_s_{c}").over(rows) for c in sums} | {f"_q_{c}": F.max(f"_m_{c}").over(rows) for c in maxima})
    found = own.join(base, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of")))
    sums_of = {c: F.coalesce(f"_p_{c}", F.lit(0)) + F.coalesce(f"_b_{c}", F.lit(0)) for c in sums}
    maxima_of = {c: F.greatest(f"_q_{c}", f"_c_{c}") for c in maxima}
    return found.select(*df.columns, *[x.alias(c) for c, x in {**sums_of, **maxima_of}.items()])


def asof(queries: DataFrame, events: DataFrame, key: str, order: list[str], sums: dict[str, str], maxima: dict[str, str] | None = None) -> DataFrame:
    """As-of join: for each row of ``queries``, totals over the rows of ``events`` of its key that come before it.

    Both tables have ``key`` and ``order``; an event with the very same order as a query does not count. ``sums`` and
    ``maxima`` name new columns by columns of ``events``. Both tables are laid out as one and totals are carried along,
    so neither a group nor a window has to fit one task.
    """
    maxima = maxima or {}
    names = queries.columns
    asked = queries.select(F.struct(*names).alias("_row"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate([key, *order])], F.lit(0).alias("_kind"))
    told = events.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate([key, *order])], F.lit(1).alias("_kind"), *[F.col(c).alias(f"_v_{c}") for c in {*sums.values(), *maxima.values()}])
    both = asked.unionByName(told, allowMissingColumns=True)
    places = [f"_o{i}" for i in range(1, len(order) + 1)]
    done = carried(both, "_o0", [*places, "_kind"], {f"_n_{n}": F.coalesce(f"_v_{c}", F.lit(0)) for n, c in sums.items()}, {f"_n_{n}": F.col(f"_v_{c}") for n, c in maxima.items()})
    return done.where("_kind = 0").select("_row.*", *[F.col(f"_n_{n}").alias(n) for n in [*sums, *maxima]])

"""Streaming jobs; every transformation takes a streaming or a batch table alike unless it says otherwise.

Watermarks bound the state: rows later than ``late`` are dropped by the engine where an event time is aggregated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sentrail.operators import correlate as C
from sentrail.sources.shared import written

LATE = "2 days"


def registry_updates(sightings: DataFrame, late: str = LATE) -> DataFrame:
    """Sightings (indicator, ts, approved) by indicator and day, for update mode; ``merge_into`` adds them up."""
    day = F.window("ts", "1 day")
    return sightings.withWatermark("ts", late).groupBy(day, "indicator").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("sighting_count"), F.count_if("approved").alias("report_count"))


def merge_into(path: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that keeps a registry by day and indicator under ``path``, one folder a batch.

    A batch that is run again writes its own folder again, so nothing is counted twice; ``read_registry`` takes the
    newest row of each day.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.select("indicator", F.col("window.start").alias("day"), "first_seen", "last_seen", "sighting_count", "report_count")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def read_registry(spark, path: str) -> DataFrame:
    """The registry that ``merge_into`` has kept: the columns of ``correlate.registry``."""
    rows = spark.read.parquet(path)
    value = F.struct("first_seen", "last_seen", "sighting_count", "report_count")
    days = rows.groupBy("indicator", "day").agg(F.max_by(value, "batch").alias("v")).select("indicator", "v.*")
    return C.merge_registry(days, days.limit(0))


def daily_volume(reports: DataFrame, late: str = LATE) -> DataFrame:
    """Reports by day (tumbling windows), for append mode: a day comes out once it is past the watermark."""
    return reports.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day").alias("w"), "category").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "category", "n")


def pulse(reports: DataFrame, span: str = "14 days", step: str = "1 day", late: str = LATE) -> DataFrame:
    """Reports in every trailing window (sliding windows)."""
    return reports.withWatermark("created_at", late).groupBy(F.window("created_at", span, step).alias("w"), "category").agg(F.count("*").alias("n")).select(F.col("w.end").alias("until"), "category", "n")


def first_of_template(messages: DataFrame, late: str = LATE) -> DataFrame:
    """Messages (fingerprint, created_at, ...) without repeats of a fingerprint within the watermark."""
    return messages.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["fingerprint"])


def enriched(messages: DataFrame, threats: DataFrame) -> DataFrame:
    """Messages (domain, ...) with the category of a static threat list; others keep a null."""
    return messages.join(F.broadcast(threats.select("domain", "category")), "domain", "left")  # a fixed list


def _accept(times: list[float], accepted: list[float], limit: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Which requests are accepted; only those are remembered, and one of exactly ``seconds`` ago still counts."""
    out = []
    for t in times:
        accepted = [a for a in accepted if t - a <= seconds]
        out.append(len(accepted) < limit)
        if out[-1]:
            accepted.append(t)
    return out, accepted


def _seconds(ts: pd.Series) -> list[float]:
    return (ts - pd.Timestamp(0)).dt.total_seconds().tolist()


def rate_limited(requests: DataFrame, limit: int, seconds: float, late: str = "1 minute") -> DataFrame:
    """Requests (client, bucket, ts, event_id) with ``accepted``, for a stream.

    The times that are remembered are the state, at most ``limit`` for each client and bucket. A state ends when the
    watermark has passed its last request by ``seconds``, so idle clients leave none.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])  # of one trigger, in order of time
        times = _seconds(rows["ts"])
        ok, accepted = _accept(times, accepted, limit, seconds)
        state.update((accepted,))
        last = int(max([*times, *accepted]) * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + int(seconds * 1000) + 1)
        yield pd.DataFrame({"client": key[0], "bucket": key[1], "event_id": rows["event_id"], "accepted": ok})

    grouped = requests.withWatermark("ts", late).groupBy("client", "bucket")
    return grouped.applyInPandasWithState(run, "client string, bucket string, event_id long, accepted boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


COMPACT = 20  # batches after which the links of all campaigns are written as one table


def campaign_links(spark: SparkSession, path: str, batches: int, compact: int = COMPACT) -> DataFrame | None:
    """(indicator, campaign) as it is after so many batches, null before the first: the last whole table and what changed since."""
    if not batches:
        return None
    base = (batches - 1) // compact * compact
    rows = spark.read.parquet(f"{path}/changes").where(F.col("batch").between(base, batches - 1)).select("indicator", "campaign", "batch")
    if base:  # batch ``base`` is in the whole table that was written after it
        rows = rows.where(F.col("batch") > base).unionByName(spark.read.parquet(f"{path}/whole/batch={base}").withColumn("batch", F.lit(base)))
    return rows.groupBy("indicator").agg(F.max_by("campaign", "batch").alias("campaign"))


def assign_batch(path: str, compact: int = COMPACT) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: mentions (report_id, indicator) of a batch join the campaigns kept under ``path``.

    A component is kept as links of its indicators to its name, the smallest report. Only components that share an
    indicator with the batch are merged with it, and only their links are written, so what is written follows the batch;
    after every ``compact`` batches all links are written as one table. Tables, one folder a batch: ``changes``
    (indicator, campaign), ``reports`` (report_id, campaign) of the batch, and ``merges`` (campaign, into) of names
    that ended. A batch that is run again writes the same folders again.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = written(batch.select("report_id", "indicator").distinct())
        old = campaign_links(spark, path, number, compact)
        both = new
        if old is not None:
            old = written(old)
            touched = old.join(new.select("indicator").distinct(), "indicator", "left_semi").select("campaign").distinct()
            moved = written(old.join(touched, "campaign", "left_semi"))
            both = new.unionByName(moved.select(F.col("campaign").alias("report_id"), "indicator"))
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        named = written(C.campaigns(both))
        links = named.join(both, "report_id").select("indicator", "campaign").distinct()
        put(named.join(new.select("report_id").distinct(), "report_id", "left_semi"), "reports")
        if old is not None:
            ended = named.join(moved.select(F.col("campaign").alias("report_id")).distinct(), "report_id", "left_semi").where("report_id != campaign")
            put(ended.select(F.col("report_id").alias("campaign"), F.col("campaign").alias("into")), "merges")
            links = written(links.join(moved, ["indicator", "campaign"], "left_anti"))
        put(links, "changes")
        if number and number % compact == 0:
            put(old.join(links.select("indicator"), "indicator", "left_anti").unionByName(links), "whole")

    return run

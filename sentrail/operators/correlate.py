"""Indicators, campaigns and their graph, as joins and aggregates over report and mention tables.

reports: report_id, created_at, category, status, channel, locality, reporter. mentions: report_id, indicator. What is
made of campaigns joins all their rows; these joins are written by tasks cut by the counted rows (``written``), whatever
the number of partitions is set to, so mentions and campaigns should be tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrail.operators.components import components, with_hot
from sentrail.operators.ranks import asof, before, carried, ranked
from sentrail.sources.shared import written

_APART = 1 << 62  # between the nodes of reports and those of indicators
APPROVED = ("approved", "merged")


def indicator_hash(kind: Column, value: Column) -> Column:
    """The join key of an indicator, without its value."""
    return F.substring(F.sha2(F.concat(kind, F.lit(":"), F.lower(F.trim(value))), 256), 1, 32)


def registry(reports: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row for each indicator: first and last sighting, sightings and reports.

    An approved report is seen twice, when it comes in and when it is approved, and counts as a report once.
    """
    approved = F.col("status").isin(*APPROVED)
    return (
        mentions.join(reports.select("report_id", "created_at", "status"), "report_id")
        .groupBy("indicator")
        .agg(
            F.min("created_at").alias("first_seen"),
            F.max("created_at").alias("last_seen"),
            F.sum(F.when(approved, 2).otherwise(1)).alias("sighting_count"),
            F.count_if(approved).alias("report_count"),
        )
    )


def merge_registry(old: DataFrame, new: DataFrame) -> DataFrame:
    """Adds a batch to a registry; both have the columns of ``registry``."""
    return old.unionByName(new).groupBy("indicator").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("sighting_count").alias("sighting_count"), F.sum("report_count").alias("report_count"))


def reputation(found: DataFrame) -> DataFrame:
    """Indicators that were reported, or seen more than once, with their points."""
    weight = F.least(F.lit(10.0), 3.0 + 2.5 * F.least(F.lit(3), F.col("report_count")))
    return found.where("report_count > 0 OR sighting_count > 1").withColumn("weight", weight.cast("double"))


def asof_counts(sightings: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """For each sighting, the earlier sightings of its key and when the last of them was."""
    return carried(sightings, key, [at, order], {"prior": F.lit(1).cast("long")}, {"prior_last": F.col(at)})


def reputation_before(mentions: DataFrame, approved: DataFrame) -> DataFrame:
    """What was known of each indicator of a message before the message itself was stored.

    mentions: msg_id, hash, at; approved: msg_id of the messages whose reports were approved. A message is a sighting,
    and with an approved report another sighting and a report. Messages of one moment come in order of their ids.
    Returns msg_id, hash, sighting_count, report_count and weight where ``reputation`` keeps the counts.
    """
    rows = mentions.select("msg_id", "hash", "at").distinct()
    told = rows.join(approved.select("msg_id").distinct().withColumn("_yes", F.lit(1)), "msg_id", "left").select("msg_id", "hash", "at", F.coalesce("_yes", F.lit(0)).cast("long").alias("reports"))
    events = told.withColumn("sightings", F.col("reports") + 1)
    return reputation(asof(rows, events, "hash", ["at", "msg_id"], {"sighting_count": "sightings", "report_count": "reports"})).drop("at")


def campaigns(mentions: DataFrame) -> DataFrame:
    """(report_id, campaign): components of the report-indicator graph, named by their smallest report.

    Both ids are whole numbers of less than 2**61, of any sign. ``mentions`` are read twice and should be a table.
    """
    # Reports come before all indicators, so the smallest node of a component is its smallest report.
    edges = mentions.select((F.col("report_id") - _APART).alias("a"), F.col("indicator").cast("long").alias("b"))
    found = components(edges, hot=True).where(F.col("node") < -(_APART // 2))
    return found.select((F.col("node") + _APART).alias("report_id"), (F.col("component") + _APART).alias("campaign"))


def loose_campaigns(mentions: DataFrame) -> DataFrame:
    """``campaigns`` of reports that mostly have one indicator, each row of ``mentions`` once; indicators as there.

    A report of one indicator ties nothing together, so components are those of indicators, by the reports of several;
    each report then has the campaign of its smallest indicator.
    """
    size = mentions.count()
    own = written(mentions.groupBy("report_id").agg(F.min("indicator").alias("lead"), F.collect_set("indicator").alias("own")), narrow=size)
    edges = written(own.where(F.size("own") > 1).select(F.col("lead").alias("a"), F.explode("own").alias("b")).where("a != b").distinct(), narrow=size)
    tied = components(edges, hot=True).select(F.col("node").alias("lead"), "component")
    leads = own.groupBy("lead").agg(F.min("report_id").alias("first"), F.count("*").alias("n")).join(tied, "lead", "left")
    leads = written(leads.withColumn("component", F.coalesce("component", "lead")), narrow=size)
    named = leads.groupBy("component").agg(F.min("first").alias("campaign"))
    of_lead = written(leads.join(named, "component").select("lead", "campaign", "n"), narrow=size)
    return with_hot(own.select("report_id", "lead"), of_lead, "lead", "n").select("report_id", "campaign")


def campaign_stats(of_report: DataFrame, reports: DataFrame) -> DataFrame:
    n = F.count("*")
    found = (
        of_report.join(reports.select("report_id", "category", "created_at"), "report_id")
        .groupBy("campaign")
        .agg(
            n.alias("report_count"),
            F.least(F.lit(100), 25 + 15 * n).cast("long").alias("score"),
            F.when(n >= 3, "active").otherwise("monitoring").alias("status"),
            F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
            F.min("created_at").alias("first_seen"),
            F.max("created_at").alias("last_seen"),
        )
    )
    return written(found, narrow=of_report.count())


def timeline(of_report: DataFrame, reports: DataFrame) -> DataFrame:
    """(campaign, month, n): reports of each campaign by month."""
    dated = of_report.join(reports.select("report_id", "created_at"), "report_id")
    return written(dated.groupBy("campaign", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n")), narrow=of_report.count())


def activation(of_report: DataFrame, reports: DataFrame, size: int = 3) -> DataFrame:
    """When each campaign got its third report; places are counted over ranges, so a campaign may have any size."""
    placed = ranked(of_report.join(reports.select("report_id", "created_at"), "report_id"), "campaign", ["created_at", "report_id"])
    return placed.where(F.col("n") == size).select("campaign", F.col("created_at").alias("activated_at"), "report_id")


def shared_indicators(of_report: DataFrame, mentions: DataFrame) -> DataFrame:
    """(campaign, indicator, shared): the reports of a campaign that have an indicator."""
    return written(of_report.join(mentions, "report_id").groupBy("campaign", "indicator").agg(F.count_distinct("report_id").alias("shared")), narrow=mentions.count())


def nodes(of_report: DataFrame, mentions: DataFrame) -> DataFrame:
    """Reports and indicators of the campaign graph; an indicator grows with the reports that share it."""
    shared = shared_indicators(of_report, mentions)
    size = (10 + 4 * F.least(F.lit(5), F.col("shared"))).cast("int")
    of_indicator = shared.select("campaign", F.concat(F.lit("i"), F.col("indicator")).alias("node"), F.lit("indicator").alias("kind"), size.alias("size"))
    return of_indicator.unionByName(of_report.select("campaign", F.concat(F.lit("r"), F.col("report_id")).alias("node"), F.lit("report").alias("kind"), F.lit(14).alias("size")))


def edges(of_report: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions, called same_indicator where several reports of the campaign have the indicator."""
    size = mentions.count()
    linked = written(of_report.join(mentions, "report_id"), narrow=size)
    shared = written(linked.groupBy("campaign", "indicator").agg(F.count_distinct("report_id").alias("shared")), narrow=size)
    relation = F.when(F.col("shared") > 1, "same_indicator").otherwise("mentions")
    told = written(linked.join(shared, ["campaign", "indicator"]).select("campaign", "report_id", "indicator", "shared"), narrow=size)
    return told.select("campaign", F.concat(F.lit("r"), F.col("report_id")).alias("source"), F.concat(F.lit("i"), F.col("indicator")).alias("target"), relation.alias("relation"))


def rotation(of_report: DataFrame, mentions: DataFrame) -> DataFrame:
    """Campaigns that use more than one indicator."""
    found = of_report.join(mentions, "report_id").groupBy("campaign").agg(F.count_distinct("indicator").alias("n_indicators")).where("n_indicators > 1")
    return written(found, narrow=mentions.count())


def duplicate_candidates(reports: DataFrame, mentions: DataFrame, fingerprints: DataFrame, latest: int = 5) -> DataFrame:
    """At most ``latest`` earlier reports for each report: newer, older, reason (template, template+indicator, indicator).

    First come the latest earlier ones of its fingerprint, then the latest earlier ones that share an indicator, as far
    as there is room. fingerprints: report_id, fingerprint; a null fingerprint matches nothing. A row sees the rows before
    it in the order of its fingerprint or indicator (``ranks.before``), so pairs are never joined. Of an indicator the
    ``latest`` before are enough: a report with k template matches has room for that many less k, and k of them at most
    are template matches. Only reports that have room, and their indicators, are asked at all. A report's own indicators
    travel as an array, as they come from one text.
    """
    moments = reports.select("report_id", "created_at")
    seen = mentions.where("indicator is not null").select("report_id", "indicator").distinct()
    own = seen.groupBy("report_id").agg(F.collect_list("indicator").alias("own"))
    of = fingerprints.where("fingerprint is not null").distinct().join(moments, "report_id").join(own, "report_id", "left")
    order = ["created_at", "report_id"]
    told = written(before(of, "fingerprint", order, latest, ["own"]).select("report_id", "own", F.explode("before").alias("b")).select(
        F.col("report_id").alias("newer"), F.col("b.report_id").alias("older"), F.col("b.created_at").alias("at"),
        F.when(F.coalesce(F.arrays_overlap("own", "b.own"), F.lit(False)), "template+indicator").otherwise("template").alias("reason"),
    ), narrow=0)
    # A report of several fingerprints can have one match by each of them.
    told = told.distinct()
    full = told.groupBy("newer").agg(F.count("*").alias("k")).where(F.col("k") >= latest)
    asking = written(seen.join(full.select(F.col("newer").alias("report_id")), "report_id", "left_anti"), narrow=0)
    held = seen.join(asking.select("indicator").distinct(), "indicator", "left_semi").join(asking.select("report_id").distinct().withColumn("asks", F.lit(True)), "report_id", "left")
    found = before(held.join(moments, "report_id"), "indicator", order, latest, []).where("asks")
    by_indicator = found.select(F.col("report_id").alias("newer"), F.explode("before").alias("b")).select("newer", F.col("b.report_id").alias("older"), F.col("b.created_at").alias("at")).distinct()
    by_indicator = by_indicator.join(told, ["newer", "older"], "left_anti").withColumn("reason", F.lit("indicator"))
    place = Window.partitionBy("newer").orderBy(F.startswith("reason", F.lit("template")).desc(), F.desc("at"), F.desc("older"))
    return told.unionByName(by_indicator).withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= latest).select("newer", "older", "reason")

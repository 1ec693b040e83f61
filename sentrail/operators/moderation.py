"""Moderation of reports: approvals, rejections and merges, with their audit, campaign counts and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAMPAIGN_STATES = ["active", "monitoring", "closed"]


def valid_actions(reports: DataFrame, actions: DataFrame) -> DataFrame:
    """The actions that take effect: on a report that exists, merges into one that exists; with the target's campaign.

    reports: report_id, status, campaign. actions: action_id, report_id, action (approve, reject, merge), acted (a time), reason,
    into. The campaign of a target is that of the table, not one that the same batch of actions would give it.
    """
    target = reports.select(F.col("report_id").alias("into"), F.col("campaign").alias("target_campaign"), F.lit(True).alias("found")).distinct()
    known = actions.join(reports.select("report_id").distinct(), "report_id", "left_semi").where(F.col("action").isin("approve", "reject", "merge"))
    return known.join(target, "into", "left").where("action != 'merge' OR found").drop("found")


def moderate(reports: DataFrame, actions: DataFrame) -> DataFrame:
    """Reports after all actions: status, duplicate_of and campaign by the last action or merge, and the audit fields.

    Actions are ordered by time, then action_id; each kind leaves its last time, reason or target. They are aggregated
    for each report before the join, so a report with any number of actions costs one row.
    """
    order = F.struct("acted", "action_id")
    last = lambda value, kind: F.max_by(value, F.when(F.col("action") == kind, order))
    status = F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected").otherwise("merged")
    state = valid_actions(reports, actions).groupBy("report_id").agg(
        F.max_by(status, order).alias("new_status"), last("acted", "approve").alias("approved_at"), last("acted", "reject").alias("rejected_at"), last("reason", "reject").alias("reason"),
        last("acted", "merge").alias("merged_at"), last("into", "merge").alias("duplicate_of"), last("target_campaign", "merge").alias("of_target"),
    )
    campaign = F.when(F.col("merged_at").isNotNull(), F.col("of_target")).otherwise(F.col("campaign"))
    return reports.join(state, "report_id", "left").select("report_id", F.coalesce("new_status", "status").alias("status"), campaign.alias("campaign"), "duplicate_of", "approved_at", "rejected_at", "reason", "merged_at")


def merged_sightings(reports: DataFrame, actions: DataFrame) -> DataFrame:
    """(campaign, sightings, last_seen): what merges add to the campaigns of their targets."""
    merges = valid_actions(reports, actions).where("action = 'merge' AND target_campaign IS NOT NULL")
    return merges.groupBy(F.col("target_campaign").alias("campaign")).agg(F.count("*").alias("sightings"), F.max("acted").alias("last_seen"))


def merge_edges(reports: DataFrame, actions: DataFrame) -> DataFrame:
    """(source, relation, target): a similar_to edge for each pair of merged reports."""
    merges = valid_actions(reports, actions).where("action = 'merge'")
    return merges.select(F.col("report_id").alias("source"), F.lit("similar_to").alias("relation"), F.col("into").alias("target")).distinct()


def campaign_states(campaigns: DataFrame, changes: DataFrame) -> DataFrame:
    """(campaign, state) after the last change to a known state. campaigns: campaign, state; changes: change_id, campaign, state, acted."""
    known = changes.where(F.col("state").isin(CAMPAIGN_STATES)).groupBy("campaign").agg(F.max_by("state", F.struct("acted", "change_id")).alias("new_state"))
    return campaigns.join(known, "campaign", "left").select("campaign", F.coalesce("new_state", "state").alias("state"))

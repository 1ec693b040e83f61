"""Queries over intake and moderation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrail.operators import intake as N
from sentrail.operators import moderation as M
from sentrail.sources.tables import read

ACTIONS_SQL = """
SELECT event_id AS action_id, event_id * 7 % 20000 AS report_id, ts AS acted, CASE event_type WHEN 'click' THEN 'approve' WHEN 'view' THEN 'reject' WHEN 'error' THEN 'close' ELSE 'merge' END AS action,
 'reason ' || CAST(user_id AS STRING) AS reason, CASE WHEN event_type IN ('click', 'view', 'error') THEN NULL ELSE event_id * 11 % 20000 END AS into_report
FROM events
"""
CASES_SQL = "SELECT o_orderkey AS report_id, CASE o_orderstatus WHEN 'F' THEN 'approved' ELSE 'pending' END AS status, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 50 END AS campaign FROM orders"
CHANGES_SQL = "SELECT event_id AS change_id, user_id % 60 AS campaign, CASE event_type WHEN 'click' THEN 'active' WHEN 'view' THEN 'monitoring' WHEN 'error' THEN 'archived' ELSE 'closed' END AS state, ts AS acted FROM events"


def _actions(spark, sf):
    return spark.sql(ACTIONS_SQL.replace("FROM events", "FROM {e}"), e=read(spark, sf, "events")).withColumnRenamed("into_report", "into")


def _cases(spark, sf):
    return spark.sql(CASES_SQL.replace("FROM orders", "FROM {o}"), o=read(spark, sf, "orders"))


def moderation_state(spark, sf):
    return M.moderate(_cases(spark, sf), _actions(spark, sf))


def moderation_sightings(spark, sf):
    return M.merged_sightings(_cases(spark, sf), _actions(spark, sf))


def moderation_edges(spark, sf):
    return M.merge_edges(_cases(spark, sf), _actions(spark, sf))


def campaign_status(spark, sf):
    changes = spark.sql(CHANGES_SQL.replace("FROM events", "FROM {e}"), e=read(spark, sf, "events"))
    campaigns = _cases(spark, sf).where("campaign is not null").select("campaign", F.lit("active").alias("state")).distinct()
    return M.campaign_states(campaigns, changes)


def intake_quarantine(spark, sf):
    """Refused urls of pages and texts of documents, with the reason."""
    pages = read(spark, sf, "pages").select(F.lit("url").alias("kind"), F.col("page_id").alias("id"), F.expr("CASE WHEN page_id % 5 = 0 THEN replace(url, '://', ':') WHEN page_id % 5 = 1 THEN 'data:' || url ELSE url END").alias("value"))
    docs = read(spark, sf, "documents").select(F.lit("text").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("value"))
    refused = [N.checked(pages, N.url_reason(F.col("value")))[1], N.checked(docs, N.text_reason(F.col("value")))[1]]
    return refused[0].unionByName(refused[1]).select("kind", "id", "reason")


def unified_input(spark, sf):
    """Documents as texts, pages as urls and codes, turns of conversations as images, some corrected, some unreadable."""
    texts = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    pages = read(spark, sf, "pages")
    urls = pages.select(F.col("page_id").alias("id"), "url", F.expr("CASE WHEN page_id % 2 = 0 THEN ' seen on ' END").alias("context"))
    codes = pages.select(F.col("page_id").alias("id"), F.expr("CASE page_id % 3 WHEN 0 THEN array(url, 'upi://pay?pa=a@ybl') WHEN 1 THEN array(url, url) END").alias("payloads"))
    turns = read(spark, sf, "conversations")
    images = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.expr("CASE WHEN role = 'user' THEN text ELSE '' END").alias("ocr"), F.expr("CASE WHEN turn % 3 = 0 THEN text ELSE ' ' END").alias("override"), F.expr("CASE WHEN turn % 5 = 1 THEN array('http://a.example/x') END").alias("payloads"))
    done = N.unified(texts, urls, images, codes)
    return done.select("id", "input_type", F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars"), F.size("extra_urls").alias("n_urls"), "corrected", "needs_input")


def payload_kinds(spark, sf):
    codes = read(spark, sf, "pages").select(F.expr("CASE page_id % 3 WHEN 0 THEN 'UPI://pay?pa=' || url WHEN 1 THEN url ELSE 'code ' || url END").alias("payload"))
    return codes.groupBy(N.payload_kind(F.col("payload")).alias("kind")).agg(F.count("*").alias("n"))


_STRIP = lambda c: f"regexp_replace({c}, '{N.BLANK}', '', 'g')"
_FILLED = lambda c: f"nullif({_STRIP(c)}, '')"
_VALID = f"""WITH cases AS ({CASES_SQL}), acts AS ({ACTIONS_SQL}),
va AS (SELECT a.*, t.campaign AS of_target FROM acts a JOIN cases c USING (report_id) LEFT JOIN cases t ON t.report_id = a.into_report WHERE a.action IN ('approve', 'reject') OR (a.action = 'merge' AND t.report_id IS NOT NULL))"""
_LAST = lambda value, kind: f"(list({value} ORDER BY acted DESC, action_id DESC) FILTER (action = '{kind}'))[1]"
_HOST = "lower(split_part(regexp_replace(regexp_extract(regexp_replace(v, '(?i)^[a-z][a-z0-9+.-]*://', ''), '^[^/?#]*'), '^.*@', ''), ':', 1))"

QUERIES = {f.__name__: f for f in (moderation_state, moderation_sightings, moderation_edges, campaign_status, intake_quarantine, unified_input, payload_kinds)}

ORACLE_SQL = {
    "moderation_state": f"""{_VALID}, st AS (SELECT report_id, (list(action ORDER BY acted DESC, action_id DESC))[1] AS act, {_LAST('acted', 'approve')} AS approved_at, {_LAST('acted', 'reject')} AS rejected_at, {_LAST('reason', 'reject')} AS reason,
 {_LAST('acted', 'merge')} AS merged_at, {_LAST('into_report', 'merge')} AS duplicate_of, {_LAST('of_target', 'merge')} AS of_target FROM va GROUP BY report_id)
SELECT c.report_id, CASE act WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'merge' THEN 'merged' ELSE status END AS status, CASE WHEN merged_at IS NOT NULL THEN of_target ELSE campaign END AS campaign, duplicate_of, approved_at, rejected_at, reason, merged_at
FROM cases c LEFT JOIN st USING (report_id)""",
    "moderation_sightings": f"{_VALID} SELECT of_target AS campaign, count(*) AS sightings, max(acted) AS last_seen FROM va WHERE action = 'merge' AND of_target IS NOT NULL GROUP BY 1",
    "moderation_edges": f"{_VALID} SELECT DISTINCT report_id AS source, 'similar_to' AS relation, into_report AS target FROM va WHERE action = 'merge'",
    "campaign_status": f"""WITH ch AS ({CHANGES_SQL}), k AS (SELECT campaign, (list(state ORDER BY acted DESC, change_id DESC))[1] AS state FROM ch WHERE state <> 'archived' GROUP BY 1)
SELECT c.campaign, coalesce(k.state, 'active') AS state FROM (SELECT DISTINCT campaign FROM ({CASES_SQL}) WHERE campaign IS NOT NULL) c LEFT JOIN k USING (campaign)""",
    "intake_quarantine": f"""WITH p AS (SELECT page_id AS id, CASE WHEN page_id % 5 = 0 THEN replace(url, '://', ':') WHEN page_id % 5 = 1 THEN 'data:' || url ELSE url END AS value FROM pages), b AS (SELECT *, {_STRIP('value')} AS v FROM p),
u AS (SELECT id, CASE WHEN value IS NULL OR length(value) < {N.LEAST_URL} THEN 'too short' WHEN length(value) > {N.MOST_URL} THEN 'too long' WHEN regexp_matches(lower(v), '^({'|'.join(N.REFUSED_SCHEMES)})') THEN 'unsupported scheme' WHEN NOT contains({_HOST}, '.') THEN 'no host' END AS reason FROM b)
SELECT 'url' AS kind, id, reason FROM u WHERE reason IS NOT NULL
UNION ALL SELECT 'text', doc_id, CASE WHEN text IS NULL OR {_STRIP('text')} = '' THEN 'empty' ELSE 'too long' END FROM documents WHERE text IS NULL OR {_STRIP('text')} = '' OR length(text) > {N.MOST_TEXT}""",
    "unified_input": f"""WITH a AS (
SELECT doc_id AS id, 'text' AS input_type, {_FILLED('text')} AS text, 0 AS n_urls, false AS corrected FROM documents
UNION ALL SELECT page_id, 'url', nullif(concat_ws(chr(10), CASE WHEN page_id % 2 = 0 THEN 'seen on' END, {_FILLED('url')}), ''), CASE WHEN {_FILLED('url')} IS NULL THEN 0 ELSE 1 END, false FROM pages
UNION ALL SELECT page_id, 'qr', CASE page_id % 3 WHEN 0 THEN concat_ws(chr(10), url, 'upi://pay?pa=a@ybl') WHEN 1 THEN nullif(concat_ws(chr(10), url, url), '') END, CASE WHEN page_id % 3 < 2 AND regexp_matches(lower(url), '^(https?://|www\\.)') THEN 1 ELSE 0 END, false FROM pages
UNION ALL SELECT conv_id * 100 + turn, 'image', coalesce(CASE WHEN turn % 3 = 0 THEN {_FILLED('text')} END, CASE WHEN role = 'user' THEN nullif(text, '') END, CASE WHEN turn % 5 = 1 THEN 'http://a.example/x' END), CASE WHEN turn % 5 = 1 THEN 1 ELSE 0 END, turn % 3 = 0 AND {_FILLED('text')} IS NOT NULL FROM conversations)
SELECT id, input_type, CAST(coalesce(length(text), 0) AS INT) AS n_chars, n_urls, corrected, text IS NULL AS needs_input FROM a""",
    "payload_kinds": "SELECT CASE page_id % 3 WHEN 0 THEN CASE WHEN url IS NULL THEN NULL ELSE 'upi' END WHEN 1 THEN CASE WHEN regexp_matches(lower(url), '^(https?://|www\\.)') THEN 'url' WHEN lower(url) LIKE 'upi://%' THEN 'upi' WHEN url IS NOT NULL THEN 'text' END ELSE CASE WHEN url IS NOT NULL THEN 'text' END END AS kind, count(*) AS n FROM pages GROUP BY 1",
}

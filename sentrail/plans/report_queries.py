"""Queries over reports, indicators and campaigns, and their SQL.

Reports are made from orders, customers and nations; mentions from all line items.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrail.operators import correlate as C
from sentrail.operators import text as T
from sentrail.operators.ranks import ranked
from sentrail.sources.shared import written
from sentrail.sources.tables import messages, read
from sentrail.sources.tables import MSG_SQL

AS_OF, DAYS = "2001-08-01", 90

REPORTS_SQL = """
SELECT o_orderkey AS report_id, o_orderdate AS created_at, o_orderpriority AS category,
  CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'merged' END AS status,
  c_mktsegment AS channel, n_name AS locality, c_custkey AS reporter, o_totalprice AS amount, c_name AS name
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""
MENTIONS_SQL = "SELECT DISTINCT l_orderkey AS report_id, l_partkey AS indicator FROM lineitem"
_R = f"r AS ({REPORTS_SQL})"
_M = f"m AS ({MENTIONS_SQL})"
_RM = f"WITH RECURSIVE {_R}, {_M}"


def reports(spark, sf):
    o, c, n = (read(spark, sf, t) for t in ("orders", "customer", "nation"))
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "pending").otherwise("merged")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("category"), status.alias("status"),
        F.col("c_mktsegment").alias("channel"), F.col("n_name").alias("locality"), F.col("c_custkey").alias("reporter"), F.col("o_totalprice").alias("amount"), F.col("c_name").alias("name"),
    )


def mentions(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_partkey").alias("indicator")).distinct()


def _told(spark, sf):
    """Mentions as a table, for what reads them several times; its tasks are cut by the line items."""
    return written(mentions(spark, sf), narrow=read(spark, sf, "lineitem").count())


def recent(df):
    """The trailing window before the day of reference, which is a parameter and never the clock."""
    return df.where((F.col("created_at") >= F.expr(f"timestamp '{AS_OF}' - interval {DAYS} days")) & (F.col("created_at") <= F.expr(f"timestamp '{AS_OF}'")))


_RECENT = f"created_at >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY AND created_at <= TIMESTAMP '{AS_OF}'"


def pulse_dims(spark, sf):
    cols = ["category", "status", "channel", "locality"]
    sets = recent(reports(spark, sf)).groupingSets([[c] for c in cols], *cols).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return sets.select(F.when(F.col("g") == 7, "category").when(F.col("g") == 11, "status").when(F.col("g") == 13, "channel").otherwise("locality").alias("dim"), F.coalesce(*cols).alias("value"), "n")


def pulse_daily(spark, sf):
    return recent(reports(spark, sf)).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def pulse_totals(spark, sf):
    r = recent(reports(spark, sf))
    return r.agg(F.count("*").alias("reports"), F.count_if(F.col("status").isin("approved", "merged")).alias("approved"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_distinct("reporter").alias("reporters"))


def pulse_localities(spark, sf):
    return recent(reports(spark, sf)).groupBy("locality").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "locality").limit(8)


def entity_registry(spark, sf):
    return C.registry(reports(spark, sf), mentions(spark, sf))


def reputation(spark, sf):
    return C.reputation(C.registry(reports(spark, sf), mentions(spark, sf))).select("indicator", "report_count", "sighting_count", "weight")


def registry_merge(spark, sf):
    r, m = reports(spark, sf), mentions(spark, sf)
    old = C.registry(r.where("created_at < '1998-01-01'"), m)
    return C.merge_registry(old, C.registry(r.where("created_at >= '1998-01-01'"), m))


def asof_reputation(spark, sf):
    e = read(spark, sf, "events").select("event_id", "ts", "user_id")
    return C.asof_counts(e, "user_id", "ts", "event_id").select("event_id", "prior", "prior_last")


def top_indicators(spark, sf):
    return C.registry(reports(spark, sf), mentions(spark, sf)).orderBy(F.desc("report_count"), F.desc("last_seen"), "indicator").limit(12).select("indicator", "report_count", "last_seen")


def emerging(spark, sf):
    r = recent(reports(spark, sf))
    return C.registry(r, mentions(spark, sf)).orderBy(F.desc("report_count"), F.desc("last_seen"), "indicator").limit(6).select("indicator", "report_count", "last_seen")


def indicator_search(spark, sf):
    found = C.registry(reports(spark, sf), mentions(spark, sf)).join(read(spark, sf, "part").select(F.col("p_partkey").alias("indicator"), F.col("p_name").alias("display")), "indicator")
    return found.where(F.col("display").ilike("%gear%")).orderBy(F.desc("report_count"), F.desc("last_seen"), "indicator").limit(50).select("indicator", "display", "report_count")


def indicator_lookup(spark, sf):
    found = mentions(spark, sf).select("indicator", C.indicator_hash(F.lit("domain"), F.col("indicator").cast("string")).alias("hash")).distinct()
    return found.where("substring(hash, 1, 1) = 'a' OR indicator = 7").select("indicator", "hash")


def indicator_reports(spark, sf):
    approved = reports(spark, sf).where(F.col("status").isin(*C.APPROVED)).select("report_id", "category", "locality")
    return mentions(spark, sf).join(approved, "report_id").select("indicator", "report_id", "category", "locality")


def mod_queue(spark, sf):
    return reports(spark, sf).where("status = 'pending'").orderBy(F.desc("created_at"), F.desc("report_id")).limit(200).select("report_id", "created_at", "category", "channel")


def public_feed(spark, sf):
    r = reports(spark, sf).where(F.col("status").isin(*C.APPROVED) & (F.col("channel") != "BUILDING"))
    preview = T.redact(F.concat(F.lit("Call 98765"), F.lpad(F.col("reporter").cast("string"), 5, "0"), F.lit(" or write to user"), F.col("reporter"), F.lit("@mail.example now")))
    return r.orderBy(F.desc("created_at"), F.desc("report_id")).limit(100).select("report_id", "category", "locality", preview.alias("preview"))


def report_intake(spark, sf):
    r = reports(spark, sf)
    channel = F.lower("channel")
    public = (F.col("reporter") % 2 == 0) & (F.col("reporter") % 3 == 0)
    return r.select("report_id", F.when(channel.isin("machinery", "household", "building"), channel).otherwise("other").alias("channel"), F.when(public, "public").otherwise("private").alias("visibility"), F.when(F.trim("category") == "", "unknown").otherwise(F.lower(F.substring("category", 1, 4000))).alias("category"))


def moderation_apply(spark, sf):
    """Events as moderation actions on their users; the last one counts."""
    action = F.when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "view", "reject").otherwise("set_status")
    e = read(spark, sf, "events").select("user_id", "ts", "event_id", action.alias("action"))
    order = F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(F.max_by("action", order).alias("last_action"), F.count("*").alias("n_actions"), F.min_by("ts", F.when(F.col("action") == "approve", order)).alias("first_approved"))


def campaign_components(spark, sf):
    return C.campaigns(_told(spark, sf))


def campaign_stats(spark, sf):
    return C.campaign_stats(C.campaigns(_told(spark, sf)), reports(spark, sf))


def campaign_list(spark, sf):
    return C.campaign_stats(C.campaigns(_told(spark, sf)), reports(spark, sf)).orderBy(F.desc("last_seen"), "campaign").limit(100).select("campaign", "status", "report_count", "last_seen")


def activation_time(spark, sf):
    return C.activation(C.campaigns(_told(spark, sf)), reports(spark, sf))


def campaign_nodes(spark, sf):
    m = _told(spark, sf)
    return C.nodes(C.campaigns(m), m)


def campaign_edges(spark, sf):
    m = _told(spark, sf)
    return C.edges(C.campaigns(m), m)


def campaign_rotation(spark, sf):
    m = _told(spark, sf)
    return C.rotation(C.campaigns(m), m)


def campaign_timeline(spark, sf):
    return C.timeline(C.campaigns(_told(spark, sf)), reports(spark, sf))


def dup_candidates(spark, sf):
    prints = messages(spark, sf).select(F.col("msg_id").alias("report_id"), T.fingerprint(F.col("text")).alias("fingerprint"))
    return C.duplicate_candidates(reports(spark, sf), mentions(spark, sf), prints)


def template_links(spark, sf):
    """Each message and the template's first message, with the template's size."""
    p = messages(spark, sf).select("msg_id", "created_at", T.fingerprint(F.col("text")).alias("fingerprint"))
    first = p.groupBy("fingerprint").agg(F.min_by("msg_id", F.struct("created_at", "msg_id")).alias("first_id"), F.count("*").alias("n"))
    return p.join(first, "fingerprint").where("msg_id != first_id").select("msg_id", "first_id", "n")


def first_reports(spark, sf):
    first = F.min(F.struct("created_at", "report_id", "category")).alias("first")
    return reports(spark, sf).groupBy("reporter").agg(first).select("reporter", "first.report_id", "first.category")


def campaign_links(spark, sf):
    """Strength of the link of a report to a campaign: half a point for each indicator that the campaign shares."""
    m = _told(spark, sf)
    of_indicator = C.shared_indicators(C.campaigns(m), m).where("shared > 1")
    found = m.join(of_indicator, "indicator").groupBy("report_id", "campaign").agg(F.least(F.lit(1.0), F.sum(F.lit(0.5))).alias("strength"), F.array_join(F.transform(F.array_sort(F.collect_list("indicator")), lambda x: x.cast("string")), ",").alias("reasons"))
    return written(found, narrow=m.count())


def evidence_bundle(spark, sf):
    m = mentions(spark, sf).groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("indicator")), lambda x: x.cast("string")), ",").alias("indicators"))
    lines = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("report_id")).agg(F.count("*").alias("n_evidence"), F.max("l_shipdate").alias("last_evidence"))
    return reports(spark, sf).select("report_id", "status", "locality").join(m, "report_id", "left").join(lines, "report_id", "left").select("report_id", "status", "locality", "indicators", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), "last_evidence")


def distinct_counts(spark, sf):
    m, r = mentions(spark, sf), reports(spark, sf)
    return m.join(r, "report_id").groupBy("category").agg(F.count_distinct("indicator").alias("indicators"), F.count_distinct("reporter").alias("reporters"), F.count_distinct("report_id").alias("reports"))


def latency_pctl(spark, sf):
    e = ranked(read(spark, sf, "events").select("event_type", "value", "event_id").where("value is not null"), "event_type", ["value", "event_id"])
    at = lambda k: F.when(F.col("n") - 1 == F.floor(k), F.col("value"))
    last = F.col("n_of") - 1
    middle = F.avg(F.when((F.col("n") - 1 == F.floor(last / 2)) | (F.col("n") - 1 == F.ceil(last / 2)), F.col("value")))
    return e.groupBy("event_type").agg(F.round(middle, 6).alias("p50"), F.max(at(0.95 * last)).alias("p95"), F.max("value").alias("most"))


def latency_approx(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.approx_percentile("value", 0.95, 10000).alias("p95_approx"), F.approx_count_distinct("user_id").alias("users_approx"))


def _judged(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id").withColumns({"truth": F.col("quality") == 1, "guess": F.col("n_chars") >= 800})


_JUDGED = "j AS (SELECT d.doc_id, lang, source, quality = 1 AS truth, n_chars >= 800 AS guess FROM documents d JOIN labels USING (doc_id))"


def eval_prf(spark, sf):
    n = lambda t, g: F.count_if((F.col("truth") == t) & (F.col("guess") == g))
    c = _judged(spark, sf).agg(n(True, True).alias("tp"), n(False, True).alias("fp"), n(False, False).alias("tn"), n(True, False).alias("fn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = c.withColumns({"precision": F.round(safe(F.col("tp"), F.col("tp") + F.col("fp")), 6), "recall": F.round(safe(F.col("tp"), F.col("tp") + F.col("fn")), 6), "fpr": F.round(safe(F.col("fp"), F.col("fp") + F.col("tn")), 6)})
    return c.withColumn("f1", F.round(safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


def eval_breakdown(spark, sf):
    hit = F.round(F.avg(F.when(F.col("truth") == F.col("guess"), 1.0).otherwise(0.0)), 6)
    return _judged(spark, sf).groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"), hit.alias("accuracy"))


def worst_cases(spark, sf):
    return _judged(spark, sf).where("truth != guess").orderBy("doc_id").limit(15).select("doc_id", "lang", "truth", "guess")


_CAMPAIGN = f"""{_RM}, lab(report_id, l, k) AS (SELECT DISTINCT report_id, report_id, 0 FROM m UNION ALL SELECT m.report_id, min(n.l), any_value(n.k) + 1
  FROM (SELECT indicator, min(l) AS l, any_value(k) AS k FROM lab JOIN m USING (report_id) WHERE k < 40 GROUP BY indicator) n JOIN m USING (indicator) GROUP BY m.report_id),
c AS (SELECT report_id, min(l) AS campaign FROM lab GROUP BY report_id),
st AS (SELECT campaign, count(*) AS report_count, CAST(least(100, 25 + 15 * count(*)) AS BIGINT) AS score, CASE WHEN count(*) >= 3 THEN 'active' ELSE 'monitoring' END AS status,
  array_to_string(list_sort(list(DISTINCT category)), ',') AS categories, min(created_at) AS first_seen, max(created_at) AS last_seen FROM c JOIN r USING (report_id) GROUP BY campaign),
sh AS (SELECT campaign, indicator, count(DISTINCT report_id) AS shared FROM c JOIN m USING (report_id) GROUP BY ALL)"""
_REG = """reg AS (SELECT indicator, min(created_at) AS first_seen, max(created_at) AS last_seen, CAST(sum(CASE WHEN status = 'pending' THEN 1 ELSE 2 END) AS BIGINT) AS sighting_count,
  count(*) FILTER (status <> 'pending') AS report_count FROM m JOIN r USING (report_id) %s GROUP BY indicator)"""
_FP = r"""p AS (SELECT o_orderkey AS report_id, fp AS fingerprint FROM (SELECT msg_id AS o_orderkey, created_at, substr(sha256(array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(lower(text), '\d+|https?://\S+|www\.\S+', ' ', 'gi'), '[a-z\x{0B80}-\x{0BFF}]{3,}'))), ' ')), 1, 32) AS fp FROM msg))"""

QUERIES = {
    f.__name__: f
    for f in (
        pulse_dims, pulse_daily, pulse_totals, pulse_localities, entity_registry, reputation, registry_merge, asof_reputation, top_indicators, emerging, indicator_search, indicator_lookup,
        indicator_reports, mod_queue, public_feed, report_intake, moderation_apply, campaign_components, campaign_stats, campaign_list, activation_time, campaign_nodes, campaign_edges,
        campaign_rotation, campaign_timeline, dup_candidates, template_links, first_reports, campaign_links, evidence_bundle, distinct_counts, latency_pctl, latency_approx, eval_prf,
        eval_breakdown, worst_cases,
    )
}

ORACLE_SQL = {
    "pulse_dims": f"WITH {_R}, w AS (SELECT * FROM r WHERE {_RECENT}) SELECT 'category' AS dim, category AS value, count(*) AS n FROM w GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'channel', channel, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'locality', locality, count(*) FROM w GROUP BY 2",
    "pulse_daily": f"WITH {_R} SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM r WHERE {_RECENT} GROUP BY 1",
    "pulse_totals": f"WITH {_R} SELECT count(*) AS reports, count(*) FILTER (status IN ('approved', 'merged')) AS approved, count(*) FILTER (status = 'pending') AS pending, count(DISTINCT reporter) AS reporters FROM r WHERE {_RECENT}",
    "pulse_localities": f"WITH {_R} SELECT locality, count(*) AS n FROM r WHERE {_RECENT} GROUP BY 1 ORDER BY n DESC, locality LIMIT 8",
    "entity_registry": f"{_RM}, {_REG % ''} SELECT * FROM reg",
    "registry_merge": f"{_RM}, {_REG % ''} SELECT * FROM reg",
    "reputation": f"{_RM}, {_REG % ''} SELECT indicator, report_count, sighting_count, CAST(least(10, 3 + 2.5 * least(3, report_count)) AS DOUBLE) AS weight FROM reg WHERE report_count > 0 OR sighting_count > 1",
    "asof_reputation": "SELECT event_id, count(*) OVER w AS prior, max(ts) OVER w AS prior_last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "top_indicators": f"{_RM}, {_REG % ''} SELECT indicator, report_count, last_seen FROM reg ORDER BY report_count DESC, last_seen DESC, indicator LIMIT 12",
    "emerging": f"{_RM}, {_REG % ('WHERE ' + _RECENT)} SELECT indicator, report_count, last_seen FROM reg ORDER BY report_count DESC, last_seen DESC, indicator LIMIT 6",
    "indicator_search": f"{_RM}, {_REG % ''} SELECT indicator, p_name AS display, report_count FROM reg JOIN part ON p_partkey = indicator WHERE p_name ILIKE '%gear%' ORDER BY report_count DESC, last_seen DESC, indicator LIMIT 50",
    "indicator_lookup": f"{_RM}, h AS (SELECT DISTINCT indicator, substr(sha256('domain:' || indicator), 1, 32) AS hash FROM m) SELECT * FROM h WHERE hash LIKE 'a%' OR indicator = 7",
    "indicator_reports": f"{_RM} SELECT indicator, report_id, category, locality FROM m JOIN r USING (report_id) WHERE status <> 'pending'",
    "mod_queue": f"WITH {_R} SELECT report_id, created_at, category, channel FROM r WHERE status = 'pending' ORDER BY created_at DESC, report_id DESC LIMIT 200",
    "public_feed": f"WITH {_R} SELECT report_id, category, locality, regexp_replace(regexp_replace('Call 98765' || lpad(CAST(reporter AS VARCHAR), 5, '0') || ' or write to user' || reporter || '@mail.example now', '\\b([6-9]\\d{{2}})\\d{{5}}(\\d{{2}})\\b', '\\1*****\\2', 'g'), '\\b([A-Za-z0-9._%+-]{{2}})[A-Za-z0-9._%+-]*@', '\\1***@', 'g') AS preview FROM r WHERE status <> 'pending' AND channel <> 'BUILDING' ORDER BY created_at DESC, report_id DESC LIMIT 100",
    "report_intake": f"WITH {_R} SELECT report_id, CASE WHEN lower(channel) IN ('machinery', 'household', 'building') THEN lower(channel) ELSE 'other' END AS channel, CASE WHEN reporter % 6 = 0 THEN 'public' ELSE 'private' END AS visibility, lower(category) AS category FROM r",
    "moderation_apply": "WITH a AS (SELECT *, CASE event_type WHEN 'click' THEN 'approve' WHEN 'view' THEN 'reject' ELSE 'set_status' END AS action FROM events) SELECT user_id, arg_max(action, (ts, event_id)) AS last_action, count(*) AS n_actions, min(ts) FILTER (action = 'approve') AS first_approved FROM a GROUP BY user_id",
    "campaign_components": f"{_CAMPAIGN} SELECT * FROM c",
    "campaign_stats": f"{_CAMPAIGN} SELECT * FROM st",
    "campaign_list": f"{_CAMPAIGN} SELECT campaign, status, report_count, last_seen FROM st ORDER BY last_seen DESC, campaign LIMIT 100",
    "activation_time": f"{_CAMPAIGN} SELECT campaign, created_at AS activated_at, report_id FROM (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY created_at, report_id) AS n FROM c JOIN r USING (report_id)) WHERE n = 3",
    "campaign_nodes": f"{_CAMPAIGN} SELECT campaign, 'i' || indicator AS node, 'indicator' AS kind, CAST(10 + 4 * least(5, shared) AS INT) AS size FROM sh UNION ALL SELECT campaign, 'r' || report_id, 'report', 14 FROM c",
    "campaign_edges": f"{_CAMPAIGN} SELECT campaign, 'r' || report_id AS source, 'i' || indicator AS target, CASE WHEN shared > 1 THEN 'same_indicator' ELSE 'mentions' END AS relation FROM c JOIN m USING (report_id) JOIN sh USING (campaign, indicator)",
    "campaign_rotation": f"{_CAMPAIGN} SELECT campaign, count(*) AS n_indicators FROM sh GROUP BY 1 HAVING count(*) > 1",
    "campaign_timeline": f"{_CAMPAIGN} SELECT campaign, strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM c JOIN r USING (report_id) GROUP BY ALL",
    "campaign_links": f"{_CAMPAIGN} SELECT report_id, campaign, CAST(least(1.0, 0.5 * count(*)) AS DOUBLE) AS strength, array_to_string(list_sort(list(indicator)), ',') AS reasons FROM m JOIN sh USING (indicator) WHERE shared > 1 GROUP BY ALL",
    "dup_candidates": f"""WITH RECURSIVE msg AS ({MSG_SQL}), {_R}, {_M}, {_FP},
f AS (SELECT fingerprint, report_id, row_number() OVER (PARTITION BY fingerprint ORDER BY created_at, report_id) AS n FROM p JOIN r USING (report_id)),
i AS (SELECT indicator, report_id, row_number() OVER (PARTITION BY indicator ORDER BY created_at, report_id) AS n FROM m JOIN r USING (report_id)),
t AS (SELECT a.report_id AS newer, b.report_id AS older, b.n AS n FROM f a JOIN f b ON a.fingerprint = b.fingerprint AND b.n BETWEEN a.n - 5 AND a.n - 1),
k AS (SELECT DISTINCT a.report_id AS newer, b.report_id AS older FROM i a JOIN i b ON a.indicator = b.indicator AND b.n < a.n),
d AS (SELECT newer, older, CASE WHEN k.older IS NULL THEN 'template' ELSE 'template+indicator' END AS reason, 0 AS o FROM t LEFT JOIN k USING (newer, older)
  UNION ALL SELECT newer, older, 'indicator', 1 FROM k ANTI JOIN t USING (newer, older))
SELECT newer, older, reason FROM d JOIN r ON r.report_id = older QUALIFY row_number() OVER (PARTITION BY newer ORDER BY o, created_at DESC, older DESC) <= 5""",
    "template_links": f"WITH msg AS ({MSG_SQL}), {_FP}, q AS (SELECT report_id, fingerprint, o_orderdate AS created_at FROM p JOIN orders ON o_orderkey = report_id), g AS (SELECT fingerprint, arg_min(report_id, (created_at, report_id)) AS first_id, count(*) AS n FROM q GROUP BY 1) SELECT report_id AS msg_id, first_id, n FROM q JOIN g USING (fingerprint) WHERE report_id <> first_id",
    "first_reports": f"WITH {_R} SELECT reporter, report_id, category FROM (SELECT *, row_number() OVER (PARTITION BY reporter ORDER BY created_at, report_id) AS n FROM r) WHERE n = 1",
    "evidence_bundle": f"{_RM}, i AS (SELECT report_id, array_to_string(list_sort(list(indicator)), ',') AS indicators FROM m GROUP BY 1), l AS (SELECT l_orderkey AS report_id, count(*) AS n_evidence, max(l_shipdate) AS last_evidence FROM lineitem GROUP BY 1) SELECT report_id, status, locality, indicators, coalesce(n_evidence, 0) AS n_evidence, last_evidence FROM r LEFT JOIN i USING (report_id) LEFT JOIN l USING (report_id)",
    "distinct_counts": f"{_RM} SELECT category, count(DISTINCT indicator) AS indicators, count(DISTINCT reporter) AS reporters, count(DISTINCT report_id) AS reports FROM m JOIN r USING (report_id) GROUP BY 1",
    "latency_pctl": "WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(median(value), 6) AS p50, max(value) FILTER (i = CAST(floor(0.95 * (n - 1)) AS BIGINT)) AS p95, max(value) AS most FROM e GROUP BY 1",
    "eval_prf": f"WITH {_JUDGED}, c AS (SELECT count(*) FILTER (truth AND guess) AS tp, count(*) FILTER (NOT truth AND guess) AS fp, count(*) FILTER (NOT truth AND NOT guess) AS tn, count(*) FILTER (truth AND NOT guess) AS fn FROM j) SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS fpr, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c",
    "eval_breakdown": f"WITH {_JUDGED} SELECT lang, source, count(*) AS n, round(avg(CASE WHEN truth = guess THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM j GROUP BY GROUPING SETS ((lang), (source), ())",
    "worst_cases": f"WITH {_JUDGED} SELECT doc_id, lang, truth, guess FROM j WHERE truth <> guess ORDER BY doc_id LIMIT 15",
}

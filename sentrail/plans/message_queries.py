"""Queries over entities, intents and message scores, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrail.functions import fixed
from sentrail.operators import entities as E
from sentrail.operators import intent as I
from sentrail.operators import text as T
from sentrail.plans.text_queries import _Q, _TAMIL_SQL, _TANGLISH_SQL, MSG
from sentrail.sources.shared import written
from sentrail.sources.tables import messages, read, spread


#: Senders made from customers; the same SQL runs in Spark and in DuckDB.
SENDER = "CASE cust % 3 WHEN 0 THEN '+919' || lpad(CAST(cust AS STRING), 9, '0') WHEN 1 THEN 'VK-SBIINB' END"
#: Types that DuckDB's regular expressions, which have no lookarounds, can express.
PATTERNS = {"upi": E.UPI, "email": E.EMAIL, "url": E.URL, "domain": E.URL, "amount": E.AMOUNT, "txn_id": E.TXN, "ifsc": E.IFSC, "date": E.DATE}


def entities_all(spark, sf):
    found = E.extract(messages(spark, sf).withColumn("sender", F.expr(SENDER)), sender="sender")
    return found.select("msg_id", "type", "raw", "canonical", "hash", "confidence", "display", "start", "stop", "place")


def entity_patterns(spark, sf):
    found = E.extract(messages(spark, sf), kinds=[*PATTERNS, "locality"])
    return found.select("msg_id", "type", "raw", "canonical", "hash", "start", "stop")


def sender_entities(spark, sf):
    found = E.extract(messages(spark, sf).withColumn("sender", F.expr(SENDER)), sender="sender")  # a number in the text may be the sender's
    return found.where("start = -1").select("msg_id", "type", "raw", "canonical", "confidence")


def brand_first_mention(spark, sf):
    return E.extract(messages(spark, sf), kinds=["brand"]).select("msg_id", "canonical", "display", "start")


def entities_by_type_counts(spark, sf):
    return E.extract(messages(spark, sf)).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("canonical").alias("n_distinct"))


def entities_documents(spark, sf):
    return E.extract(spread(read(spark, sf, "documents").select("doc_id", "text")), "doc_id").select("doc_id", "type", "canonical")


def brand_domain_conflict(spark, sf):
    return E.brand_conflicts(written(E.extract(messages(spark, sf), kinds=["brand", "domain"])))


def indicator_sightings(spark, sf):
    """Hard indicators of messages: how often and when they were seen."""
    hard = E.hard_indicators(E.extract(messages(spark, sf), kinds=["domain", "phone", "upi", "email", "ifsc"]))
    return hard.join(messages(spark, sf).select("msg_id", F.date_format("created_at", "yyyy-MM-dd").alias("day")), "msg_id").groupBy("type", "hash").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def _folded(spark, sf):
    return messages(spark, sf).select("msg_id", T.fold(F.col("text")).alias("folded"))


def fold_messages(spark, sf):
    return _folded(spark, sf)


def intent_hits(spark, sf):
    return I.families(_folded(spark, sf)).select("msg_id", *[f"n_{f}" for f in fixed.INTENTS])


def benign_hits(spark, sf):
    return I.families(_folded(spark, sf)).select("msg_id", "n_benign")


def scam_class(spark, sf):
    return I.scam_class(I.families(_folded(spark, sf))).select("msg_id", "scam_category", "top_score")


def rf_intent(spark, sf):
    return I.message_points(I.scam_class(I.families(_folded(spark, sf)))).select("msg_id", "intent_points", "benign_credit")


def risk_band(spark, sf):
    df = I.message_points(I.scam_class(I.families(_folded(spark, sf))))
    return df.groupBy("band", "scam_category").agg(F.count("*").alias("n"), F.max("message_score").alias("most"))


_PROT = "|".join(T.PROTECTED)
_FOLD = _TAMIL_SQL.replace("text", "@@", 1).replace("@@", _TANGLISH_SQL.replace("lower(text)", "lower(masked)")) if _TAMIL_SQL.count("text") == 1 else None
_FOLDED = rf"""{MSG}, mk AS (SELECT msg_id, regexp_replace(text, {_Q(_PROT)}, chr(1), 'gi') AS masked, regexp_extract_all(text, {_Q('(?i)' + _PROT)}) AS spans FROM msg),
fd AS (SELECT msg_id, string_split({_FOLD}, chr(1)) AS ps, spans FROM mk),
fo AS (SELECT msg_id, trim(regexp_replace(array_to_string(list_transform(range(1, len(ps) + 1), lambda i: ps[i] || coalesce(spans[i], '')), ''), '\s{{2,}}', ' ', 'g')) AS folded FROM fd)"""
_N = lambda ps: " + ".join(f"CAST(regexp_matches(folded, {_Q(p.replace('(?=', '(?:'))}, 'i') AS INT)" for p in ps)
_FAMILIES = f"{_FOLDED}, fa AS (SELECT msg_id, folded, {', '.join(f'{_N(ps)} AS n_{k}' for k, ps in fixed.INTENTS.items())}, {_N(fixed.BENIGN)} AS n_benign FROM fo)"
_SCORES = ", ".join(
    f"{{'s': CASE WHEN {_N(fixed.SCAM_CLASSES[k]['patterns'])} > 0 THEN CAST({_N(fixed.SCAM_CLASSES[k]['patterns'])} AS DOUBLE) + {' + '.join([f'CASE WHEN n_{f} > 0 THEN 0.75 ELSE 0 END' for f in fixed.SCAM_CLASSES[k]['intents']] or ['0'])} END, 'i': {i}, 'k': '{k}'}}"
    for i, k in enumerate(I.CLASSES)
)
_CLASS = f"{_FAMILIES}, sc AS (SELECT *, list_sort(list_transform(list_filter([{_SCORES}], lambda x: x.s IS NOT NULL), lambda x: {{'a': -x.s, 'b': x.i, 'c': x.k}}))[1] AS best FROM fa), cl AS (SELECT *, coalesce(best.c, 'legitimate') AS scam_category, CAST(coalesce(-best.a, 0) AS DOUBLE) AS top_score FROM sc)"
_POINTS = f"""{_CLASS}, po AS (SELECT *, CAST(least(25.0, {' + '.join(f'round(CASE WHEN n_{k} > 0 THEN {w} * (1 + 0.25 * least(2, n_{k} - 1)) ELSE 0 END, 2)' for k, w in fixed.INTENT_WEIGHTS.items())}
 + CASE WHEN top_score > 0 THEN round(least(11.0, 4.5 + 1.8 * top_score), 2) ELSE 0 END) AS DOUBLE) AS intent_points, CAST(least(10.0, 4.0 * n_benign) AS DOUBLE) AS benign_credit FROM cl),
pb AS (SELECT *, CAST(greatest(0, least(100, round_even(intent_points - benign_credit, 0))) AS INT) AS message_score FROM po)"""

_LEN = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
_NUMBER = f"CAST(replace(regexp_extract(raw, {_Q(E.AMOUNT)}, 1), ',', '') AS DOUBLE)"
_UNIT = f"CASE lower(regexp_extract(raw, {_Q(E.AMOUNT)}, 2)) WHEN 'lakh' THEN 1e5 WHEN 'lakhs' THEN 1e5 WHEN 'crore' THEN 1e7 WHEN 'crores' THEN 1e7 WHEN 'k' THEN 1e3 ELSE 1.0 END"
_SUFFIXES = ", ".join(_Q(t) for t in E.TWO_LABELS)
_SPANS = f"""{MSG}, sp AS ({' UNION ALL '.join(f"SELECT msg_id, {_Q(k)} AS type, regexp_extract_all(text, {_Q(p)}) AS ms, string_split_regex(text, {_Q(p)}) AS gs, regexp_extract_all(text, {_Q(p)}, {int(k == 'txn_id')}) AS vs FROM msg" for k, p in PATTERNS.items())}),
mt AS (SELECT msg_id, type, ms, gs, vs, unnest(range(1, len(ms) + 1)) AS i FROM sp),
pl AS (SELECT msg_id, type, ms[i] AS m, vs[i] AS v, {_LEN('gs[1:i]')} + {_LEN('ms[1:i-1]')} AS start FROM mt),
tr AS (SELECT msg_id, type, v, start, CASE WHEN type IN ('url', 'domain') THEN regexp_replace(m, {_Q(E.TAIL)}, '') ELSE m END AS raw FROM pl),
ho AS (SELECT *, start + length(raw) AS stop, lower(split_part(regexp_replace(regexp_extract(regexp_replace(raw, '(?i)^[a-z][a-z0-9+.-]*://', ''), '^[^/?#]*'), '^.*@', ''), ':', 1)) AS host FROM tr),
lb AS (SELECT *, string_split(regexp_replace(host, '^www\\.', ''), '.') AS parts FROM ho WHERE type NOT IN ('url', 'domain') OR contains(host, '.')),
ca AS (SELECT msg_id, type, CASE WHEN type = 'domain' THEN host ELSE raw END AS raw, start, stop, lower(trim(CASE type WHEN 'amount' THEN 'inr:' || CAST(CAST(round_even({_NUMBER} * {_UNIT}, 0) AS DECIMAL(30, 0)) AS STRING) WHEN 'txn_id' THEN v
 WHEN 'url' THEN CASE WHEN regexp_matches(raw, '(?i)^https?://') THEN raw ELSE 'http://' || raw END
 WHEN 'domain' THEN array_to_string(parts[CASE WHEN array_to_string(parts[-2:], '.') IN ({_SUFFIXES}) THEN -3 ELSE -2 END:], '.') ELSE raw END)) AS canonical FROM lb
 UNION ALL SELECT msg_id, 'locality', substr(text, CAST(instr(lower(text), p) AS BIGINT), length(p)), instr(lower(text), p) - 1, instr(lower(text), p) - 1 + length(p), p FROM msg, (SELECT unnest([{', '.join(_Q(x) for x in fixed.LOCALITIES)}]) AS p) WHERE contains(lower(text), p)),
fi AS (SELECT msg_id, type, canonical, arg_min(raw, start) AS raw, CAST(min(start) AS INT) AS start, CAST(arg_min(stop, start) AS INT) AS stop
 FROM ca WHERE type <> 'email' OR NOT EXISTS (SELECT 1 FROM ca u WHERE u.msg_id = ca.msg_id AND u.type = 'upi' AND u.start <= ca.start AND u.stop >= ca.stop) GROUP BY ALL)"""
# The earliest mention of each brand, and brands of messages that link elsewhere.
_NAMES = ", ".join(f"({_Q(k)}, {_Q(n)}, {_Q(v['display'])})" for k, v in fixed.BRANDS.items() for n in [k, *v["aliases"]])
_MENTION = f"""nm(brand, spelling, display) AS (VALUES {_NAMES}),
hb AS (SELECT msg_id, lower(text) AS low, brand, display, '(^|[^a-z0-9])' || regexp_escape(spelling) || '([^a-z0-9]|$)' AS pat FROM msg JOIN nm ON contains(lower(msg.text), spelling)),
br AS (SELECT msg_id, brand, any_value(display) AS display, CAST(min(length(string_split_regex(low, pat)[1]) + length(regexp_extract(low, pat, 1))) AS INT) AS start FROM hb WHERE regexp_matches(low, pat) GROUP BY ALL)"""
_OWN = ", ".join(f"({_Q(k)}, {_Q(d)})" for k, v in fixed.BRANDS.items() for d in v["domains"])
_CONFLICT = f"""ow(brand, official) AS (VALUES {_OWN}), do_ AS (SELECT msg_id, raw AS host, canonical, start FROM fi WHERE type = 'domain'),
co AS (SELECT msg_id, brand, linked_domain FROM br JOIN (SELECT msg_id, arg_min(canonical, start) AS linked_domain FROM do_ GROUP BY 1) USING (msg_id)
 WHERE NOT EXISTS (SELECT 1 FROM do_ JOIN ow ON host = official OR ends_with(host, '.' || official) WHERE do_.msg_id = br.msg_id AND ow.brand = br.brand))"""
_SENDERS = f"{MSG}, se AS (SELECT msg_id, {SENDER} AS raw FROM msg)"

QUERIES = {f.__name__: f for f in (entity_patterns, sender_entities, brand_first_mention, entities_all, entities_by_type_counts, entities_documents, brand_domain_conflict, indicator_sightings, fold_messages, intent_hits, benign_hits, scam_class, rf_intent, risk_band)}

ORACLE_SQL = {
    "brand_first_mention": f"{MSG}, {_MENTION} SELECT msg_id, brand AS canonical, display, start FROM br",
    "brand_domain_conflict": f"{_SPANS}, {_MENTION}, {_CONFLICT} SELECT msg_id, brand, linked_domain, substr(text, start + 1, greatest(1, length(brand))) AS evidence FROM co JOIN br USING (msg_id, brand) JOIN msg USING (msg_id)",
    "entity_patterns": f"{_SPANS} SELECT msg_id, type, raw, canonical, substr(sha256(type || ':' || canonical), 1, 32) AS hash, start, stop FROM fi",
    "sender_entities": f"{_SENDERS} SELECT msg_id, CASE WHEN raw LIKE '+91%' THEN 'phone' ELSE 'sender_id' END AS type, raw, CASE WHEN raw LIKE '+91%' THEN raw ELSE lower(raw) END AS canonical, CAST(CASE WHEN raw LIKE '+91%' THEN 0.95 ELSE 0.9 END AS DOUBLE) AS confidence FROM se WHERE raw IS NOT NULL",
    "fold_messages": f"{_FOLDED} SELECT msg_id, folded FROM fo",
    "intent_hits": f"{_FAMILIES} SELECT msg_id, {', '.join(f'n_{k}' for k in fixed.INTENTS)} FROM fa",
    "benign_hits": f"{_FAMILIES} SELECT msg_id, n_benign FROM fa",
    "scam_class": f"{_CLASS} SELECT msg_id, scam_category, top_score FROM cl",
    "rf_intent": f"{_POINTS} SELECT msg_id, intent_points, benign_credit FROM po",
    "risk_band": f"{_POINTS} SELECT CASE WHEN message_score < 25 THEN 'LOW' WHEN message_score < 50 THEN 'CAUTION' WHEN message_score < 75 THEN 'HIGH' ELSE 'CRITICAL' END AS band, scam_category, count(*) AS n, max(message_score) AS most FROM pb GROUP BY ALL",
}

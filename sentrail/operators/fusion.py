"""The fused risk score: weighted factors of five evidence families, capped and summed for each message.

Inputs are tables: messages (msg_id, text, folded, sender), entities of them, scored urls, reputation of indicators
and campaign links. A missing table or a null means no evidence of that kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrail.functions import fixed
from sentrail.operators import entities as E
from sentrail.operators import intent as I

# Points and limits of the factors.
FEED_POINTS, SHORTENER_POINTS = 8.0, 6.0
CONFLICT_POINTS, PERSONAL_SENDER_POINTS, HANDLE_POINTS, CALLBACK_POINTS = 7.0, 6.0, 6.0, 5.0
PRESSURE = ["threat", "urgency", "authority_impersonation", "payment_request", "reward_bait"]
CALLBACK = ["payment_request", "reward_bait", "authority_impersonation", "remote_access"]
MOST_URLS, MOST_CONFLICTS, MOST_LINKS, MOST_FLAGS = 5, 3, 3, 12
FACTOR = "msg_id long, family string, name string, weight double, observed string, evidence string, source string, seq int"
# What a factor is called among the red flags; others are no flags. Links weigh nothing there.
FLAGS = {label: label for label in fixed.INTENT_LABELS.values()} | {
    "Shortened link conceals the destination": "Shortened link hides its destination", "Brand / domain mismatch": "Brand does not match the link",
    "Bank/brand message from a personal number": "Institutional message from a personal mobile number", "Payment handle inside a pressure message": "Pay-to-a-stranger UPI handle",
    "Callback number is the only channel offered": "Asks you to call a number from the message", "Matches a tracked campaign": "Resembles a known campaign",
}
REPORTED, WEIGHTLESS = "Previously reported ", "Shortened link conceals the destination"
LEADS = ["No strong scam signals were found, but stay careful.", "Some suspicious signals are present — verify before acting.", "Treat this as unsafe until verified independently.", "Do not act on this message."]
UNCERTAIN = {
    "no_link": "No link was present, so technical URL signals could not contribute.", "no_report": "No prior community reports matched these indicators.",
    "tanglish": "Tanglish was normalized before analysis; review the original wording.",
}
LOW_OCR = 60


def sender_role(sender: Column) -> Column:
    """phone for a personal number, header for a registered sender id, null for none."""
    bare = F.regexp_replace(F.trim(sender), r"[\s\-]", "")
    return F.when(bare.rlike(r"^(?:\+?91)?[6-9]\d{9}$"), "phone").when(F.trim(sender) != "", "header")


def _factor(df: DataFrame, family: str, name: str | Column, weight: Column, observed: Column, evidence: Column, source: str, seq: int) -> DataFrame:
    """One factor row for each row of ``df``; ``seq`` orders the kinds of factors of a message. Weights of 0 are no factors."""
    name = F.lit(name) if isinstance(name, str) else name
    rows = df.select("msg_id", F.lit(family).alias("family"), name.alias("name"), F.round(weight.cast("double"), 2).alias("weight"), observed.cast("string").alias("observed"), F.coalesce(evidence.cast("string"), F.lit("")).alias("evidence"), F.lit(source).alias("source"), F.lit(seq).alias("seq"))
    return rows.where("weight > 0")


def _first(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of every group; groups are the parts of one message."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def worst_urls(messages: DataFrame, scored: DataFrame) -> DataFrame:
    """(msg_id, url, url_score, domain, in_feed, shortened) of the worst of the first urls of a message.

    scored: one row for each distinct url, with url, risk_score, domain, in_feed and shortened. Of equal scores the
    first url counts.
    """
    links = F.array_distinct(F.filter(E.urls_of(F.col("text")), lambda u: F.contains(E.host_of(u), F.lit("."))))
    found = messages.where("text is not null").select("msg_id", F.posexplode(F.slice(links, 1, MOST_URLS)).alias("place", "url"))
    joined = found.join(scored.select("url", F.col("risk_score").alias("url_score"), "domain", "in_feed", "shortened"), "url")
    return _first(joined, ["msg_id"], [F.desc("url_score"), F.col("place")], 1).drop("place")


def url_factors(worst: DataFrame) -> DataFrame:
    share = fixed.FAMILY_CAPS["url_technical"] * F.col("url_score") / 100
    parts = [
        _factor(worst, "url_technical", "URL structural risk", share, F.col("url_score"), F.col("url"), "engine:url", 20),
        _factor(worst.where("in_feed"), "url_technical", "Domain in threat list", F.lit(FEED_POINTS), F.col("domain"), F.col("url"), "threat_feed", 21),
        _factor(worst.where("shortened"), "url_technical", "Shortened link conceals the destination", F.lit(SHORTENER_POINTS), F.col("domain"), F.col("url"), "rule:url", 22),
    ]
    return reduce(DataFrame.unionByName, parts)


def context_factors(judged: DataFrame, entities: DataFrame) -> DataFrame:
    """Contradictions between the parts of a message. judged: msg_id, sender and the counts of ``intent.families``."""
    conflicts = _first(E.brand_conflicts(entities), ["msg_id"], [F.col("brand")], MOST_CONFLICTS)
    one = lambda kind: entities.where(F.col("type") == kind).groupBy("msg_id").agg(F.min("raw").alias(kind))
    df = judged.select("msg_id", "sender", *[f"n_{f}" for f in {*PRESSURE, *CALLBACK}])
    for kind in ("brand", "upi", "phone", "url"):
        df = df.join(one(kind), "msg_id", "left")
    some = lambda names: reduce(lambda a, b: a | b, [F.col(f"n_{f}") > 0 for f in names])
    personal = df.where(F.col("brand").isNotNull() & (sender_role(F.col("sender")) == "phone"))
    handle = df.where(F.col("upi").isNotNull() & some(PRESSURE))
    callback = df.where(F.col("phone").isNotNull() & F.col("url").isNull() & some(CALLBACK))
    parts = [
        _factor(conflicts, "context_anomaly", "Brand / domain mismatch", F.lit(CONFLICT_POINTS), F.concat(F.lit("Mentions "), F.col("brand"), F.lit(" but links to "), F.col("linked_domain")), F.col("evidence"), "rule:context", 30),
        _factor(personal, "context_anomaly", "Bank/brand message from a personal number", F.lit(PERSONAL_SENDER_POINTS), F.col("brand"), F.col("sender"), "rule:context", 31),
        _factor(handle, "context_anomaly", "Payment handle inside a pressure message", F.lit(HANDLE_POINTS), F.col("upi"), F.col("upi"), "rule:context", 32),
        _factor(callback, "context_anomaly", "Callback number is the only channel offered", F.lit(CALLBACK_POINTS), F.col("phone"), F.col("phone"), "rule:context", 33),
    ]
    return reduce(DataFrame.unionByName, parts)


def reputation_factors(entities: DataFrame, reputation: DataFrame) -> DataFrame:
    """Entities with a history: reported before, or seen more than once. reputation: hash, report_count, weight, and
    msg_id where it is that of a moment."""
    seen = entities.join(reputation, ["msg_id", "hash"] if "msg_id" in reputation.columns else "hash")
    return _factor(seen, "entity_reputation", F.concat(F.lit(REPORTED), F.col("type")), F.col("weight"), F.col("report_count"), F.col("raw"), "community_db", 40)


def campaign_factors(links: DataFrame) -> DataFrame:
    """The strongest campaigns that a message is linked with. links: msg_id, campaign, strength, reasons."""
    top = _first(links, ["msg_id"], [F.desc("strength"), F.col("campaign")], MOST_LINKS)
    return _factor(top, "campaign_similarity", "Matches a tracked campaign", fixed.FAMILY_CAPS["campaign_similarity"] * F.col("strength"), F.col("campaign"), F.col("reasons"), "campaign_graph", 50)


def intent_factors(judged: DataFrame) -> DataFrame:
    """One factor for each intent family, one for the scam template, and one for a model's class.

    judged: the columns of ``intent.families`` and ``intent.scam_class``, and of ``intent.promote`` where a model was
    asked. Evidence of a family is its first signal, that of the template the first of all. Markers of a legitimate
    message weigh nothing, so they are no factor; they count as the benign credit.
    """
    rows = judged.select("msg_id", F.lit("message_intent").alias("family"), F.inline(intent_structs(judged)))
    return rows.select(*[x.split()[0] for x in FACTOR.split(", ")]).where("weight > 0")


def intent_structs(judged: DataFrame) -> Column:
    """The factors of ``intent_factors`` as an array in the row of their message, without their family."""
    parts = []
    for i, family in enumerate(fixed.INTENTS):
        n = F.col(f"n_{family}")
        first = _first_evidence(family)
        parts.append(_struct(n > 0, fixed.INTENT_LABELS[family], I.family_weight(family), F.concat(n.cast("string"), F.lit(" matching phrase(s)")), first, "rule:intent", i))
    label = F.create_map(*[F.lit(x) for k in I.CLASSES for x in (k, fixed.SCAM_CLASSES[k]["label"])])[F.col("scam_category")]
    observed = F.concat(F.size("class_scores").cast("string"), F.lit(" candidate class(es); strongest: "), label)
    named = F.concat(F.lit("Matches a known "), F.replace("scam_category", F.lit("_"), F.lit(" ")), F.lit(" pattern"))
    any_signal = F.try_element_at(F.filter("signals", lambda s: s["family"] != "benign"), F.lit(1))["evidence"]
    parts.append(_struct(F.col("top_score") > 0, named, I.template_weight(), observed, any_signal, "rule:scam_template", 10))
    if "model_label" in judged.columns:
        sure = (F.col("model_confidence") >= I.MODEL_FROM) & (F.col("model_label") != "legitimate")
        told = F.concat(F.lit("Model suggests "), F.replace("model_label", F.lit("_"), F.lit(" ")))
        parts.append(_struct(sure, told, F.round(I.MODEL_POINTS * F.col("model_confidence"), 2), F.format_string("classifier confidence %.2f", "model_confidence"), F.lit(""), "model:text", 11))
    return F.array_compact(F.array(*parts))


def _first_evidence(family: str) -> Column:
    return F.try_element_at(F.filter("signals", lambda s: s["family"] == family), F.lit(1))["evidence"]


def _struct(holds: Column, name: str | Column, weight: Column, observed: Column, evidence: Column, source: str, seq: int) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.when(holds, F.struct(name.alias("name"), weight.cast("double").alias("weight"), observed.alias("observed"), F.coalesce(evidence, F.lit("")).alias("evidence"), F.lit(source).alias("source"), F.lit(seq).alias("seq")))


def breakdown(factors: DataFrame) -> DataFrame:
    """(msg_id, family, points, cap, n_factors): the sum of each family, capped."""
    cap = F.create_map(*[F.lit(x) for e in fixed.FAMILY_CAPS.items() for x in e])[F.col("family")]
    summed = factors.groupBy("msg_id", "family").agg(F.sum("weight").alias("points"), F.count_if(F.col("weight") > 0).alias("n_factors"))
    return summed.select("msg_id", "family", F.least("points", cap).alias("points"), cap.alias("cap"), "n_factors")


def fuse(judged: DataFrame, by_family: DataFrame, *, checks_missing: int = 0) -> DataFrame:
    """One row for each message: risk_score, band, confidence and scam_category.

    judged: msg_id, language, benign_credit, scam_category, top_score. ``checks_missing`` inputs, or the column
    n_degraded of judged, lower the confidence.
    """
    total = by_family.groupBy("msg_id").agg(F.sum("points").alias("raw"), F.count_if(F.col("points") > 0).alias("families"), F.sum("n_factors").alias("n_factors"))
    missing = F.coalesce("n_degraded", F.lit(0)) if "n_degraded" in judged.columns else F.lit(checks_missing)
    df = judged.select("msg_id", "language", "benign_credit", "scam_category", "top_score", missing.alias("_missing")).join(total, "msg_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.coalesce("raw", F.lit(0.0)) - F.col("benign_credit")))).cast("int")
    sure = F.least(F.lit(0.95), 0.35 + 0.12 * zero("families") + 0.03 * F.least(F.lit(6), zero("n_factors")))
    sure = sure - F.when(F.col("language") == "und", 0.1).otherwise(0.0) - 0.05 * F.least(F.lit(3), F.col("_missing"))
    df = df.withColumns({"risk_score": score, "confidence": F.bround(F.greatest(F.lit(0.2), sure), 2)})
    category = F.when((F.col("risk_score") >= 25) | (F.col("top_score") > 0), F.col("scam_category")).otherwise("legitimate")
    return df.select("msg_id", "risk_score", I.band(F.col("risk_score")).alias("band"), "confidence", category.alias("scam_category"))


def red_flags(factors: DataFrame, most: int = MOST_FLAGS) -> DataFrame:
    """(msg_id, place, family, title, weight, evidence): the heaviest flags of each message, equals in order of their kinds.

    Templates, a model's word and the structure of a link are factors but no flags of their own.
    """
    known = F.create_map(*[F.lit(x) for e in FLAGS.items() for x in e])[F.col("name")]
    kind = F.substring("name", len(REPORTED) + 1, 40)
    title = F.when(F.startswith("name", F.lit(REPORTED)), F.concat(F.lit("This "), kind, F.lit(" has been reported before"))).otherwise(known)
    weight = F.when(F.col("name") == WEIGHTLESS, F.lit(0.0)).otherwise(F.round("weight", 1))
    flags = factors.select("msg_id", "family", title.alias("title"), weight.alias("weight"), "evidence", "seq").where("title is not null")
    order = Window.partitionBy("msg_id").orderBy(F.desc("weight"), "seq", "evidence")
    placed = flags.withColumn("place", F.row_number().over(order))  # a message has a handful of factors
    return placed.where(F.col("place") <= most).select("msg_id", "place", "family", "title", "weight", "evidence")


def degraded(judged: DataFrame) -> DataFrame:
    """(msg_id, check, status): checks that could not be made, of the columns that are there.

    model_label null: no model; n_urls over 0 and n_scored 0: no link could be parsed; ocr_confidence under 60: reading
    is in doubt. A message without such rows had all its checks.
    """
    rows = []
    if "model_label" in judged.columns:
        rows.append(F.when(F.col("model_label").isNull(), F.struct(F.lit("ml_classifier").alias("check"), F.lit("unavailable").alias("status"))))
    if {"n_urls", "n_scored"} <= {*judged.columns}:
        rows.append(F.when((F.col("n_urls") > 0) & (F.coalesce("n_scored", F.lit(0)) == 0), F.struct(F.lit("url_engine").alias("check"), F.lit("no_result").alias("status"))))
    if "ocr_confidence" in judged.columns:
        rows.append(F.when(F.col("ocr_confidence") < LOW_OCR, F.struct(F.lit("ocr_confidence").alias("check"), F.lit("low").alias("status"))))
    none = F.array().cast("array<struct<check: string, status: string>>")
    return judged.select("msg_id", F.inline(F.array_compact(F.array(*rows)) if rows else none))


def explain(fused: DataFrame, judged: DataFrame, flags: DataFrame, worst: DataFrame, links: DataFrame, reputation: DataFrame) -> DataFrame:
    """(msg_id, summary, uncertainties): a few sentences for each message and what could not be known.

    fused: of ``fuse``; judged: msg_id, language, language_label; flags: of ``red_flags``; worst: of ``worst_urls``; links:
    msg_id, campaign, strength; reputation: msg_id of messages whose indicators have a history.
    """
    two = flags.where("place <= 2").groupBy("msg_id").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda s: s["title"]), "; ")).alias("_reasons"))
    best = links.groupBy("msg_id").agg(F.max_by("campaign", F.struct("strength", -F.col("campaign"))).alias("_campaign"))
    known = reputation.select("msg_id").distinct().withColumn("_known", F.lit(True))
    df = fused.join(judged.select("msg_id", "language", "language_label"), "msg_id").join(two, "msg_id", "left").join(best, "msg_id", "left").join(known, "msg_id", "left")
    df = df.join(worst.select("msg_id", F.col("url_score").alias("_url_score"), F.col("domain").alias("_domain")), "msg_id", "left")
    score = F.col("risk_score")
    lead = F.when(score >= 75, LEADS[3]).when(score >= 50, LEADS[2]).when(score >= 25, LEADS[1]).otherwise(LEADS[0])
    label = F.lower(F.create_map(*[F.lit(x) for k in I.CLASSES for x in (k, fixed.SCAM_CLASSES[k]["label"])])[F.col("scam_category")])
    bits = [
        lead, F.when(score >= 25, F.concat(F.lit("The pattern resembles a "), label, F.lit("."))), F.concat(F.lit("Main reasons: "), F.col("_reasons"), F.lit(".")),
        F.when(F.col("_url_score") >= 50, F.concat(F.lit("The link "), F.col("_domain"), F.lit(" scored "), F.col("_url_score").cast("int").cast("string"), F.lit("/100 on structural checks."))),
        F.concat(F.lit("It also matches a tracked campaign: "), F.col("_campaign").cast("string"), F.lit(".")), F.concat(F.lit("Detected language: "), F.col("language_label"), F.lit(".")),
    ]
    doubts = [F.when(F.col("_url_score").isNull(), UNCERTAIN["no_link"]), F.when(F.col("_known").isNull(), UNCERTAIN["no_report"]), F.when(F.col("language") == "ta-en", UNCERTAIN["tanglish"])]
    return df.select("msg_id", F.concat_ws(" ", *bits).alias("summary"), F.array_join(F.array_compact(F.array(*doubts)), " ").alias("uncertainties"))


def actions(fused: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds what to do, by band and by what the message holds, as one text."""
    has = entities.groupBy("msg_id").agg(*[F.max(F.col("type") == k).alias(f"has_{k}") for k in ("url", "upi", "phone")])
    df = fused.join(has, "msg_id", "left")
    risky = F.col("risk_score") >= 25
    steps = [
        (~risky, "No action needed; stay careful with codes and passwords"),
        (risky & F.col("has_url"), "Do not open the link"),
        (risky & F.col("has_upi"), "Do not pay to the handle"),
        (risky & F.col("has_phone"), "Do not call the number"),
        (F.col("risk_score") >= 50, "Report the message"),
        (F.col("risk_score") >= 75, "Block the sender"),
    ]
    listed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in steps]))
    return df.select(*fused.columns, F.array_join(listed, "; ").alias("actions"))


def sms_score(messages: DataFrame, url_scores: DataFrame) -> DataFrame:
    """The short-message score: link, pressure, theme, number and sender points; bank notices count 0.

    messages: msg_id, text, sender; url_scores: msg_id, n_urls, most (the highest url score). Nulls are no evidence.
    """
    df = messages.join(url_scores, "msg_id", "left").withColumns({"n_urls": F.coalesce("n_urls", F.lit(0)), "most": F.coalesce("most", F.lit(0)), "low": F.lower(F.trim(F.coalesce("text", F.lit(""))))})
    holds = lambda words: reduce(lambda a, b: a | b, [F.contains("low", F.lit(w)) for w in words])
    urgent = reduce(lambda a, b: a + b, [F.contains("low", F.lit(w)).cast("int") for w in fixed.SMS_URGENCY_PHRASES])
    df = df.withColumns({"urgent": urgent, "kyc": holds(fixed.SMS_KYC_TRAPS), "utility": holds(fixed.SMS_UTILITY_TRAPS), "lure": holds(fixed.SMS_FINANCIAL_LURES), "bank": F.contains("low", F.lit("bank"))})
    pick = lambda *steps: reduce(lambda rest, s: F.when(s[0], F.lit(s[1])).otherwise(rest), reversed(steps), F.lit(0))
    number = F.col("low").rlike(r"(?:\+91[\-\s]?)?[6-9]\d{9}")
    personal = F.coalesce(F.trim("sender").rlike(r"^\+?[0-9]{10,13}$"), F.lit(False))
    points = (
        pick((F.col("most") >= 80, 65), (F.col("most") >= 40, 35))
        + pick((F.col("urgent") >= 2, 25), (F.col("urgent") == 1, 12))
        + pick((F.col("kyc") | F.col("utility"), 30), (F.col("lure"), 25))
        + pick((number & (F.col("kyc") | F.col("utility") | F.col("bank")), 20))
        + pick((personal & (F.col("kyc") | F.col("bank")), 25))
    )
    notice = holds(["credited with", "debited with", "avl bal", "otp is"]) & (F.col("n_urls") == 0) & ~F.col("kyc") & ~F.col("utility")
    theme = F.when(notice, "LEGITIMATE_BANK_NOTIFICATION").when(F.col("kyc"), "KYC_BANKING_FRAUD").when(F.col("utility"), "UTILITY_DISCONNECTION_SCAM").when(F.col("lure"), "FINANCIAL_LOTTERY_SCAM")
    theme = theme.when((F.col("n_urls") > 0) & (F.col("most") > 30), "MALICIOUS_LINK_DISTRIBUTION").otherwise("GENERAL_MESSAGE")
    df = df.withColumns({"sms_score": F.when(notice, 0).otherwise(F.least(F.lit(100), points)).cast("int"), "sms_category": theme})
    level = F.when(F.col("sms_score") < 25, "SAFE_LOW").when(F.col("sms_score") < 60, "SUSPICIOUS").when(F.col("sms_score") < 80, "HIGH_RISK").otherwise("CRITICAL")
    return df.select("msg_id", "sms_score", level.alias("level"), "sms_category")

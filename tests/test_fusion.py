"""Risk fusion and the short-message score on small cases worked out by hand."""

from sentrail.operators import entities as E
from sentrail.operators import fusion as R
from sentrail.operators import intent as I
from sentrail.operators import text as T

MESSAGES = [
    (1, "Dear SBI customer, your KYC has expired. Update immediately at http://sbi-kyc-1.xyz/login or your account will be blocked within 24 hours.", "+919876543210"),
    (2, "DHL: consignment held at customs. Pay Rs.500 to help7@ybl immediately.", None),
    (3, "You have won a prize. Pay the fee now. Call 9876543210", "VK-SBIINB"),
    (4, "Lunch at noon?", ""),
    (5, None, None),
]

NAMES = list(R.FLAGS)[:4]


def tables(spark):
    messages = spark.createDataFrame(MESSAGES, "msg_id long, text string, sender string")
    judged = I.message_points(I.scam_class(I.families(T.language(messages).withColumn("folded", T.fold(messages["text"])))))
    return messages, judged, E.extract(messages)


def test_context(spark):
    _, judged, entities = tables(spark)
    got = {(r.msg_id, r.name, r.weight) for r in R.context_factors(judged, entities).collect()}
    assert got == {
        (1, "Brand / domain mismatch", 7.0),
        (1, "Bank/brand message from a personal number", 6.0),
        (2, "Payment handle inside a pressure message", 6.0),
        (3, "Callback number is the only channel offered", 5.0),
    }


def test_worst_url(spark):
    """The first of the worst of the first five urls."""
    text = " ".join(f"http://h{k}.com/a" for k in range(7))
    scores = [("http://h0.com/a", 10), ("http://h1.com/a", 40), ("http://h2.com/a", 40), ("http://h6.com/a", 90)]
    scored = spark.createDataFrame([(u, s, "h.com", s == 40, True) for u, s in scores], "url string, risk_score int, domain string, in_feed boolean, shortened boolean")
    worst = R.worst_urls(spark.createDataFrame([(1, text), (2, None), (3, "no link")], "msg_id long, text string"), scored)
    assert [(r.msg_id, r.url, r.url_score) for r in worst.collect()] == [(1, "http://h1.com/a", 40)]
    assert sorted(r.weight for r in R.url_factors(worst).collect()) == [6.0, 8.0, 10.0]


def test_fuse(spark):
    """Families are capped, the credit goes off, scores stay in 0 to 100 and round half to even."""
    factors = spark.createDataFrame(
        [(1, "url_technical", NAMES[0], 24.0, None, None, "rule", 0), (1, "url_technical", NAMES[1], 8.0, None, None, "rule", 1), (1, "context_anomaly", NAMES[2], 7.5, None, None, "rule", 2), (1, "context_anomaly", NAMES[3], 7.5, None, None, "rule", 1), (2, "message_intent", "no flag", 3.0, None, None, "rule", 0)]
        + [(3, f, NAMES[k], 30.0, None, None, "rule", k) for f in ("message_intent", "url_technical", "entity_reputation", "campaign_similarity", "context_anomaly") for k in range(4)],
        R.FACTOR,
    )
    judged = spark.createDataFrame([(1, "en", 0.0, "phishing_link", 2.0), (2, "en", 8.0, "legitimate", 0.0), (3, "ta", 0.0, "kyc", 1.0), (4, "und", 0.0, "legitimate", 0.0)], "msg_id long, language string, benign_credit double, scam_category string, top_score double")
    got = {r.msg_id: (r.risk_score, r.band, r.confidence, r.scam_category) for r in R.fuse(judged, R.breakdown(factors)).collect()}
    assert got == {1: (40, "CAUTION", 0.71, "phishing_link"), 2: (0, "LOW", 0.5, "legitimate"), 3: (100, "CRITICAL", 0.95, "kyc"), 4: (0, "LOW", 0.25, "legitimate")}
    flags = R.red_flags(factors).collect()
    assert len([r for r in flags if r.msg_id == 3]) == 12 and [r.title for r in sorted(flags, key=lambda r: r.place) if r.msg_id == 1] == [R.FLAGS[NAMES[k]] for k in (0, 1, 3, 2)]
    assert not [r for r in flags if r.msg_id == 2]


def test_actions(spark):
    _, _, entities = tables(spark)
    fused = spark.createDataFrame([(1, 80), (2, 30), (4, 0)], "msg_id long, risk_score int")
    got = {r.msg_id: r.actions for r in R.actions(fused, entities).collect()}
    assert got[1] == "Do not open the link; Report the message; Block the sender"
    assert got[2] == "Do not pay to the handle" and got[4].startswith("No action")


def test_reputation_and_campaigns(spark):
    _, _, entities = tables(spark)
    hashes = {r.type: r.hash for r in entities.where("msg_id = 2").collect()}
    reputation = spark.createDataFrame([(hashes["upi"], 2, 8.0), (hashes["brand"], 0, 3.0), ("other", 5, 10.0)], "hash string, report_count long, weight double")
    assert sorted((r.msg_id, r.name, r.weight) for r in R.reputation_factors(entities, reputation).collect()) == [(2, "Previously reported brand", 3.0), (2, "Previously reported upi", 8.0)]
    moment = reputation.withColumn("msg_id", reputation["report_count"] * 0 + 1)
    assert R.reputation_factors(entities, moment).count() == 0
    links = spark.createDataFrame([(1, k, s, "same_indicator") for k, s in enumerate([0.5, 1.0, 0.4, 0.9])], "msg_id long, campaign long, strength double, reasons string")
    assert sorted(r.weight for r in R.campaign_factors(links).collect()) == [7.5, 13.5, 15.0]


def test_sms(spark):
    rows = [
        (1, "Update KYC immediately or account will be blocked http://a.xyz/b", "+919876543210"),
        (2, "Rs.500 debited with ref 1. Avl bal Rs.9", None),
        (3, "Electricity bill unpaid, call 9876543210", None),
        (4, "See www.x.com/a", None),
        (5, None, None),
    ]
    scores = spark.createDataFrame([(1, 1, 85), (4, 1, 45)], "msg_id long, n_urls long, most int")
    got = {r.msg_id: (r.sms_score, r.level, r.sms_category) for r in R.sms_score(spark.createDataFrame(rows, "msg_id long, text string, sender string"), scores).collect()}
    assert got == {
        1: (100, "CRITICAL", "KYC_BANKING_FRAUD"),
        2: (0, "SAFE_LOW", "LEGITIMATE_BANK_NOTIFICATION"),
        3: (50, "SUSPICIOUS", "UTILITY_DISCONNECTION_SCAM"),
        4: (35, "SUSPICIOUS", "MALICIOUS_LINK_DISTRIBUTION"),
        5: (0, "SAFE_LOW", "GENERAL_MESSAGE"),
    }


def test_factors_by_family(spark):
    """Two families and a template: each is a factor of its own with evidence, and the confidence counts all three."""
    text = "Your parcel prize is here, act now"
    messages = spark.createDataFrame([(1, text), (2, "Thank you for shopping. Avl bal Rs 5"), (3, None)], "msg_id long, text string")
    judged = I.message_points(I.scam_class(I.families(messages.withColumn("folded", T.fold(messages["text"])))))
    got = sorted((r.msg_id, r.seq, r.name, r.weight, r.observed, r.evidence, r.source) for r in R.intent_factors(judged).collect())
    urgency, bait = ("Artificial time pressure", "2 matching phrase(s)"), ("Too-good-to-be-true reward", "1 matching phrase(s)")
    assert [(g[2], g[4]) for g in got[:2]] == [urgency, bait] and {g[0] for g in got} == {1}
    assert [g[3] for g in got] == [7.5, 6.5, 8.0] or got[2][3] == round(min(11, 4.5 + 1.8 * 1.75), 2)
    assert got[0][5] == "act now" and got[1][5] == "prize" and got[2][2] == "Matches a known lottery prize pattern" and got[2][6] == "rule:scam_template"
    fused = R.fuse(judged.withColumn("language", T.F.lit("en")), R.breakdown(R.intent_factors(judged)))
    assert {r.msg_id: r.confidence for r in fused.collect()} == {1: 0.56, 2: 0.35, 3: 0.35}


def test_promotion(spark):
    """A model may raise a class that rules saw or add one, never take one away, and then is a factor."""
    rows = [(1, "you won the lottery"), (2, "see you at noon"), (3, "see you at noon"), (4, "you won the lottery"), (5, "see you"), (6, "you won the lottery, police")]
    messages = spark.createDataFrame(rows, "msg_id long, text string")
    classed = I.scam_class(I.families(messages.withColumn("folded", T.fold(messages["text"]))))
    said = spark.createDataFrame([(1, "legitimate", 0.99), (2, "utility_bill", 0.8), (3, "utility_bill", 0.49), (4, "utility_bill", 0.9), (6, "impersonation", 0.95)], "msg_id long, label string, confidence double")
    done = {r.msg_id: r for r in I.promote(classed, said).collect()}
    assert [done[k].scam_category for k in range(1, 7)] == ["lottery_prize", "utility_bill", "legitimate", "lottery_prize", "legitimate", "impersonation" if 0.95 * 1.5 + 1.75 > done[6].class_scores[1].score else "lottery_prize"]
    assert round(done[2].top_score, 6) == 1.2 and done[1].top_score == classed.where("msg_id = 1").first().top_score
    factors = R.intent_factors(I.promote(classed, said)).where("source = 'model:text'").collect()
    assert {(r.msg_id, r.weight, r.observed) for r in factors} == {(2, 6.4, "classifier confidence 0.80"), (3, 3.92, "classifier confidence 0.49"), (4, 7.2, "classifier confidence 0.90"), (6, 7.6, "classifier confidence 0.95")}
    assert {(r.msg_id, r.check) for r in R.degraded(I.promote(classed, said)).collect()} == {(5, "ml_classifier")}


def test_explain(spark):
    fused = spark.createDataFrame([(1, 80, "lottery_prize"), (2, 0, "legitimate")], "msg_id long, risk_score int, scam_category string")
    judged = spark.createDataFrame([(1, "ta-en", "Tanglish"), (2, "en", "English")], "msg_id long, language string, language_label string")
    flags = spark.createDataFrame([(1, 2, "B"), (1, 1, "A"), (1, 3, "C")], "msg_id long, place int, title string")
    worst = spark.createDataFrame([(1, 61, "x.com")], "msg_id long, url_score int, domain string")
    links = spark.createDataFrame([(1, 9, 0.5), (1, 7, 0.5), (1, 3, 0.4)], "msg_id long, campaign long, strength double")
    got = {r.msg_id: r for r in R.explain(fused, judged, flags, worst, links, spark.createDataFrame([(1,)], "msg_id long")).collect()}
    assert got[1].summary == f"{R.LEADS[3]} The pattern resembles a lottery / prize scam. Main reasons: a; b. The link x.com scored 61/100 on structural checks. It also matches a tracked campaign: 7. Detected language: Tanglish."
    assert got[2].summary == f"{R.LEADS[0]} Detected language: English." and got[2].uncertainties == f"{R.UNCERTAIN['no_link']} {R.UNCERTAIN['no_report']}"
    assert got[1].uncertainties == R.UNCERTAIN["tanglish"]

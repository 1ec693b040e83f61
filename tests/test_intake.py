"""Intake and moderation: small cases with known results."""

import datetime as dt

from pyspark.sql import functions as F

from sentrail.operators import intake as N
from sentrail.operators import moderation as M


def test_reasons(spark):
    texts = {"a": None, " \n ": "empty", "": "empty", None: "empty", "x" * 8000: None, "x" * 8001: "too long"}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.why for r in df.select("text", N.text_reason(F.col("text")).alias("why")).collect()} == texts
    urls = {"http://a.example/x": None, "a.example": None, "ab": "too short", None: "too short", " JavaScript:alert(1) ": "unsupported scheme", "http://localhost/": "no host", "http://a.b/" + "x" * 2048: "too long", "data:text/plain,a.b": "unsupported scheme"}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.why for r in df.select("url", N.url_reason(F.col("url")).alias("why")).collect()} == urls
    fine, refused = N.checked(df, N.url_reason(F.col("url")))
    assert (fine.count(), refused.count(), refused.columns) == (2, 6, ["url", "reason"])


def test_unified(spark):
    texts = spark.createDataFrame([(1, " hi "), (2, None), (3, " ")], "id long, text string")
    urls = spark.createDataFrame([(4, "http://a.b/", " see "), (5, "http://a.b/", None), (6, None, None)], "id long, url string, context string")
    images = spark.createDataFrame([(7, "read", "typed", None), (8, "read", " ", ["http://q.r", "http://q.r", "x"]), (9, "", None, ["www.q.r"]), (10, None, None, ["x"])], "id long, ocr string, override string, payloads array<string>")
    codes = spark.createDataFrame([(11, ["upi://pay", "http://q.r"]), (12, []), (13, None)], "id long, payloads array<string>")
    got = {r.id: (r.input_type, r.text, r.extra_urls, r.corrected, r.needs_input) for r in N.unified(texts, urls, images, codes).collect()}
    assert got == {
        1: ("text", "hi", [], False, False), 2: ("text", None, [], False, True), 3: ("text", None, [], False, True),
        4: ("url", "see\nhttp://a.b/", ["http://a.b/"], False, False), 5: ("url", "http://a.b/", ["http://a.b/"], False, False), 6: ("url", None, [], False, True),
        7: ("image", "typed", [], True, False), 8: ("image", "read", ["http://q.r"], False, False), 9: ("image", "www.q.r", ["www.q.r"], False, False), 10: ("image", None, [], False, True),
        11: ("qr", "upi://pay\nhttp://q.r", ["http://q.r"], False, False), 12: ("qr", None, [], False, True), 13: ("qr", None, [], False, True),
    }


def test_moderation(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    reports = spark.createDataFrame([(1, "pending", None), (2, "pending", 9), (3, "pending", 8), (4, "pending", None)], "report_id long, status string, campaign long")
    rows = [
        (1, 1, "reject", day(1), "spam", None), (2, 1, "approve", day(2), None, None), (3, 2, "merge", day(3), None, 3), (4, 3, "merge", day(3), None, 77),
        (5, 99, "approve", day(3), None, None), (6, 1, "merge", day(2), None, 2), (7, 3, "close", day(9), None, None), (8, 1, "merge", day(1), None, 4),
    ]
    actions = spark.createDataFrame(rows, "action_id long, report_id long, action string, acted timestamp, reason string, into long")
    got = {r.report_id: (r.status, r.campaign, r.duplicate_of, r.approved_at, r.rejected_at, r.reason, r.merged_at) for r in M.moderate(reports, actions).collect()}
    assert got[1] == ("merged", 9, 2, day(2), day(1), "spam", day(2))  # of equal times the later action counts
    assert got[2] == ("merged", 8, 3, None, None, None, day(3))
    assert got[3] == ("pending", 8, None, None, None, None, None) and got[4] == ("pending", None, None, None, None, None, None)
    assert {(r.campaign, r.sightings, r.last_seen) for r in M.merged_sightings(reports, actions).collect()} == {(8, 1, day(3)), (9, 1, day(2))}
    assert {(r.source, r.target) for r in M.merge_edges(reports, actions).collect()} == {(2, 3), (1, 2), (1, 4)}
    none = actions.limit(0)
    assert M.moderate(reports, none).count() == 4 and M.merge_edges(reports, none).count() == 0


def test_campaign_states(spark):
    at = lambda n: dt.datetime(2024, 1, n)
    campaigns = spark.createDataFrame([(1, "active"), (2, "active")], "campaign long, state string")
    changes = spark.createDataFrame([(1, 1, "closed", at(1)), (2, 1, "gone", at(2)), (3, 7, "closed", at(1))], "change_id long, campaign long, state string, acted timestamp")
    assert {(r.campaign, r.state) for r in M.campaign_states(campaigns, changes).collect()} == {(1, "closed"), (2, "active")}

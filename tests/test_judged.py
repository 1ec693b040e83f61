"""Messages judged by the skeletons of their texts, against messages judged one by one."""

import re

from pyspark.sql import functions as F

from sentrail.functions import fixed
from sentrail.operators import correlate as C
from sentrail.operators import intent as I
from sentrail.operators import text as T
from sentrail.plans import risk_queries as Q

TEXTS = [
    "Pay within 24 hours or it is blocked", "Pay within 48 hours or it is blocked", "24 reasons to pay within 24 hours", "Call 9876543210 now", "Call 9123456780 now", "Call 8123456780 now", "send the 9 digit code",
    "send the 8 digit code", "unga account 12 KYC expired, udane pannunga", "unga account 34 KYC expired, udane pannunga", "உங்கள் கணக்கு 5 முடக்கப்படும்", "REF 100200 is blocked", "REF 100300 is blocked", "", None,
]


def _digits(items):
    """Literal digits other than 9, and ranges that hold some digits but not all."""
    for op, value in items:
        name = str(op)
        if name in ("LITERAL", "NOT_LITERAL"):
            yield from [chr(value)] if chr(value) in "012345678" else []
        elif name == "RANGE":
            yield from [value] if (value[0] <= 57 and value[1] >= 48) and not (value[0] <= 48 and value[1] >= 57) else []
        elif name == "IN":
            yield from _digits(value)
        elif name == "BRANCH":
            for x in value[1]:
                yield from _digits(x)
        elif name == "SUBPATTERN":
            yield from _digits(value[3])
        elif name in ("ASSERT", "ASSERT_NOT"):
            yield from _digits(value[1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            yield from _digits(value[2])


def test_no_pattern_names_a_masked_digit():
    patterns = [p for ps in fixed.INTENTS.values() for p in ps] + list(fixed.BENIGN) + [p for c in fixed.SCAM_CLASSES.values() for p in c["patterns"]] + T.PROTECTED
    assert not [p for p in patterns if list(_digits(re._parser.parse(p)))]
    words = [*fixed.TANGLISH, *fixed.TANGLISH.values(), *fixed.TAMIL, *fixed.TAMIL.values(), *fixed.ENGLISH_STOPWORDS]
    assert not [w for w in words if re.search("[0-8]", w)]


def test_judged_by_skeleton(spark, monkeypatch):
    rows = spark.createDataFrame([(i, t, "+919876543210") for i, t in enumerate(TEXTS)], "msg_id long, text string, sender string")
    monkeypatch.setattr(Q, "_messages", lambda spark, sf: rows)
    plain = I.message_points(I.scam_class(I.families(T.language(rows).withColumn("folded", T.fold(F.col("text"))))))
    for most in (20_000, 0):  # broadcast and merged
        monkeypatch.setattr(Q, "MOST_BROADCAST", most)
        got = Q._judged(spark, "")
        same = [c for c in got.columns if c != "n_classes_hit"]
        assert {c: None for c in [*same, "n_classes_hit"]}.keys() == set(plain.columns) - {"text", "folded"}
        by = lambda df: {r.msg_id: r for r in df.select(*same, F.map_entries("n_classes_hit").alias("hits")).collect()}
        assert by(got) == by(plain) and got.count() == len(TEXTS)


def test_a_skeleton_is_judged_once(spark, monkeypatch):
    """Five hundred messages that differ in digits alone are one text to judge."""
    rows = spark.range(500).selectExpr("id AS msg_id", "'Legal action pending, REF ' || lpad(id % 8, 8, '7') AS text", "'x' AS sender")
    judged, plain = [], Q._judge
    monkeypatch.setattr(Q, "_messages", lambda spark, sf: rows)
    monkeypatch.setattr(Q, "_judge", lambda texts: judged.append(texts.count()) or plain(texts))
    assert Q._judged(spark, "").count() == 500 and sum(judged) == 1


def test_loose_campaigns(spark, monkeypatch):
    """As ``campaigns``, and reports of one indicator are no edges."""
    import random

    rng = random.Random(4)
    rows = sorted({(r, rng.randrange(60)) for r in range(-40, 120) for _ in range(rng.choice([1, 1, 1, 2, 3]))})
    mentions = spark.createDataFrame(rows, "report_id long, indicator long")
    edges, plain = [], C.components
    monkeypatch.setattr(C, "components", lambda e, hot=False: edges.append(e.count()) or plain(e, hot=hot))
    table = lambda df: sorted(map(tuple, df.collect()))
    assert table(C.loose_campaigns(mentions)) == table(C.campaigns(mentions))
    single = spark.createDataFrame([(r, r % 3) for r in range(50)], "report_id long, indicator long")
    assert table(C.loose_campaigns(single)) == [(r, r % 3) for r in range(50)] and edges[0] < len(rows) and edges[-1] == 0

"""Duplicates, activation and reputation before a message, against plain loops on small tables with ties and hot keys."""

import random

from pyspark.sql import functions as F

from sentrail.operators import components as G
from sentrail.sources import shared
from sentrail.operators import correlate as C
from sentrail.operators import ranks as R


def test_duplicates(spark):
    """Five at most: templates first, the latest first; one that also shares an indicator says so, however old."""
    rng = random.Random(4)
    n = 70
    reports = [(r, rng.randrange(25)) for r in range(n)]
    mentions = [(r, i) for r in range(n) for i in rng.sample(range(9), rng.choice([0, 1, 2])) + [100] * (r % 2)] + [(3, None)]
    prints = [(r, rng.choice([None, "a", "b", *map(str, range(20))])) for r in range(n)]
    at, own, of = dict(reports), {r: {i for q, i in mentions if q == r and i is not None} for r in range(n)}, dict(prints)
    want = set()
    for r in range(n):
        earlier = sorted(((at[q], q) for q in range(n) if (at[q], q) < (at[r], r)), reverse=True)
        same = [q for _, q in earlier if of[q] is not None and of[q] == of[r]][:5]
        shared = [q for _, q in earlier if own[q] & own[r] and q not in same]
        want |= {(r, q, "template+indicator" if own[q] & own[r] else "template") for q in same} | {(r, q, "indicator") for q in shared[: 5 - len(same)]}
    got = C.duplicate_candidates(spark.createDataFrame(reports, "report_id long, created_at int"), spark.createDataFrame(mentions, "report_id long, indicator long"), spark.createDataFrame(prints, "report_id long, fingerprint string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_activation(spark):
    of = spark.createDataFrame([(r, r % 4 if r < 30 else 99) for r in range(32)], "report_id long, campaign long")
    reports = spark.createDataFrame([(r, (r * 7) % 5) for r in range(32)], "report_id long, created_at int")
    want = {(c, *sorted(((r * 7) % 5, r) for r in range(30) if r % 4 == c)[2]) for c in range(4)}
    assert {(r.campaign, r.activated_at, r.report_id) for r in C.activation(of, reports).collect()} == want


def test_reputation_before(spark):
    """What earlier messages tell; a message's own sighting and report, and later ones, do not count."""
    rng = random.Random(9)
    rows = [(m, rng.choice(["hot", "hot", "b", f"x{m % 7}"]), rng.randrange(20)) for m in range(120)]
    approved = {m for m in range(120) if rng.random() < 0.3}
    got = C.reputation_before(spark.createDataFrame([*rows, rows[0]], "msg_id long, hash string, at int"), spark.createDataFrame([(m,) for m in approved], "msg_id long"))
    want = set()
    for m, h, t in rows:
        seen = [q for q, k, s in rows if k == h and (s, q) < (t, m)]
        reports = sum(q in approved for q in seen)
        if reports or len(seen) + reports > 1:
            want.add((m, h, len(seen) + reports, reports, min(10.0, 3 + 2.5 * min(3, reports))))
    assert {(r.msg_id, r.hash, r.sighting_count, r.report_count, r.weight) for r in got.collect()} == want and got.count() == len(want)


def test_campaigns_of_a_hot_report(spark, monkeypatch):
    """Components named by their smallest report, whatever the signs of ids, with nodes of many neighbours by broadcast."""
    monkeypatch.setattr(G, "LARGE", 3)
    calls, plain = [], G.with_hot
    monkeypatch.setattr(G, "with_hot", lambda *x: calls.append(1) or plain(*x))
    rows = [(-5, i) for i in range(12)] + [(r, r % 12) for r in range(40)] + [(100, -7), (101, -7), (102, 99), (None, 1), (3, None)]
    got = C.campaigns(spark.createDataFrame(rows, "report_id long, indicator long")).collect()
    want = {(r, -5) for r in [-5, *range(40)]} | {(100, 100), (101, 100), (102, 102)}
    assert calls and {(r.report_id, r.campaign) for r in got} == want and len(got) == len(want)


def test_narrow_tables_are_cut_by_rows(spark):
    """While a narrow table is written, tasks take few bytes and there are partitions for its rows; then all is as before."""
    names = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes", shared.PARTITIONS]
    before, seen = [spark.conf.get(k, None) for k in names], []

    class Table:
        sparkSession, schema = spark, "a long"

        @property
        def write(self):
            return self

        def parquet(self, path):
            seen.append([spark.conf.get(k, None) for k in names])
            spark.range(3).select(F.col("id").alias("a")).write.parquet(path)

    assert shared.written(Table(), narrow=7 * shared.ROWS_A_PARTITION).count() == shared.written(Table()).count() == 3
    assert seen == [["8m", "16m", "7"], before] and [spark.conf.get(k, None) for k in names] == before


def test_campaign_tasks_follow_the_rows(spark, monkeypatch):
    """Every table of campaigns, and of what is joined with them, is written with partitions for its rows."""
    mentions = spark.createDataFrame([(r, r // 2) for r in range(50)] + [(r, 100 + r % 3) for r in range(30)], "report_id long, indicator long")
    reports = spark.range(50).select(F.col("id").alias("report_id"), F.lit("a").alias("category"), F.to_timestamp(F.lit("2020-01-31")).alias("created_at"))
    seen, plain = [], shared.written
    spy = lambda df, path=None, narrow=None: seen.append(narrow or 0) or plain(df, path, narrow)
    monkeypatch.setattr(G, "written", spy)
    monkeypatch.setattr(C, "written", spy)
    of = C.campaigns(mentions)
    assert len(seen) > 3 and min(seen) == 160
    for rows, made in [(50, lambda: C.campaign_stats(of, reports)), (80, lambda: C.edges(of, mentions)), (80, lambda: C.rotation(of, mentions)), (80, lambda: C.shared_indicators(of, mentions)), (50, lambda: C.timeline(of, reports))]:
        seen.clear()
        made()
        assert seen and set(seen) == {rows}
    assert {(r.month, r.n) for r in C.timeline(of, reports).collect()} == {("2020-01", 30), ("2020-01", 2)}


def test_rows_before(spark):
    """The rows before a row in its group, over ranges, for a hot key, ties, lone rows and a null key."""
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, 40 + i % 50, None]), rng.randrange(20), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, at long, i long").withColumn("own", F.col("i") * 2)
    got = {r.i: [(b.at, b.i, b.own) for b in r.before] for r in R.before(df, "k", ["at", "i"], 5, ["own"]).collect()}
    want, groups = {}, {}
    for k, at, i in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1], r[2])):
        want[i] = groups.setdefault(k, [])[-5:]
        groups[k].append((at, i, 2 * i))
    assert got == want

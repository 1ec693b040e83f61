"""Streaming jobs on file sources, in several batches, against plain results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sentrail.operators.components import components
from sentrail.operators.ranks import asof, carried, ranked
from sentrail.streaming import jobs

T0 = datetime(2024, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    """A function that makes a stream of tables, a batch for each; runs it, and returns what came out."""

    def run(batches, schema, change, mode="append", each=None):
        source, out = tmp_path / "in", []
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
            query = change(spark.readStream.schema(schema).parquet(str(source))).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state"))
            query = query.foreachBatch(each or (lambda df, k: out.extend(df.collect()))).trigger(availableNow=True).start()
            query.awaitTermination()
        return out

    return run


def test_registry(spark, stream, tmp_path):
    rows = [[("a", T0, True), ("b", T0, False)], [("a", T0 + timedelta(hours=5), False), ("a", T0 + timedelta(days=1), True)]]
    path = str(tmp_path / "registry")
    stream(rows, "indicator string, ts timestamp, approved boolean", jobs.registry_updates, "update", jobs.merge_into(path))
    got = {r.indicator: (r.first_seen, r.last_seen, r.sighting_count, r.report_count) for r in jobs.read_registry(spark, path).collect()}
    assert got == {"a": (T0, T0 + timedelta(days=1), 3, 2), "b": (T0, T0, 1, 0)}


def test_windows(stream):
    rows = [[(T0 + timedelta(hours=k), "x") for k in range(30)], [(T0 + timedelta(days=9), "x")], [(T0, "late"), (T0 + timedelta(days=20), "x")]]
    got = stream(rows, "created_at timestamp, category string", jobs.daily_volume)
    assert {(r.day, r.category, r.n) for r in got} >= {(T0, "x", 24), (T0 + timedelta(days=1), "x", 6)}
    assert all(r.category != "late" for r in got)


def test_pulse(spark):
    rows = spark.createDataFrame([(T0 + timedelta(days=k), "x") for k in range(3)], "created_at timestamp, category string")
    got = {r.until: r.n for r in jobs.pulse(rows).collect()}
    assert got[T0 + timedelta(days=1)] == 1 and got[T0 + timedelta(days=3)] == 3 and max(got.values()) == 3


def test_first_of_template(stream):
    rows = [[("a", T0, 1), ("a", T0, 2)], [("a", T0 + timedelta(hours=1), 3), ("b", T0, 4)]]
    got = stream(rows, "fingerprint string, created_at timestamp, id long", jobs.first_of_template)
    assert sorted(r.fingerprint for r in got) == ["a", "b"]


def test_enriched(spark, stream):
    threats = spark.createDataFrame([("bad.xyz", "phishing")], "domain string, category string")
    got = stream([[("bad.xyz",), ("ok.com",), (None,)]], "domain string", lambda s: jobs.enriched(s, threats))
    assert sorted((r.domain or "", r.category or "") for r in got) == [("", ""), ("bad.xyz", "phishing"), ("ok.com", "")]


def test_rate_limit(stream):
    """By hand: two in 60 seconds; refused ones don't count, and one of exactly 60 seconds ago does."""
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [[("u", "x", at(0), 1), ("u", "x", at(10), 2), ("u", "x", at(20), 3)], [("u", "x", at(60), 4), ("u", "x", at(61), 5), ("v", "x", at(61), 6)]]
    got = stream(rows, "client string, bucket string, ts timestamp, event_id long", lambda s: jobs.rate_limited(s, 2, 60))
    assert {r.event_id: r.accepted for r in got} == {1: True, 2: True, 3: False, 4: False, 5: True, 6: True}


def test_idle_clients_leave_no_state(spark, tmp_path):
    """Once the watermark has passed a client's last request, its times are gone; a busy client's stay."""
    schema, source, kept, out = "client string, bucket string, ts timestamp, event_id long", tmp_path / "in", [], {}
    at = lambda s: T0 + timedelta(seconds=s)
    for rows in [[(f"c{k}", "x", at(0), k) for k in range(20)], [("busy", "x", at(1000), 100)], [("busy", "x", at(1001), 101)], [("c1", "x", at(1002), 102)]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        query = jobs.rate_limited(spark.readStream.schema(schema).parquet(str(source)), 2, 60).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
        query = query.foreachBatch(lambda df, k: out.update({r.event_id: r.accepted for r in df.collect()})).trigger(availableNow=True).start()
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert kept[0] == 20 and kept[-1] == 2 and all(out.values()) and len(out) == 23


@pytest.mark.parametrize("compact", [2, 20])
def test_campaigns_by_batches(spark, stream, tmp_path, compact):
    """Several batches give what one gives; reports, ended names and changes are told batch by batch."""
    rows = [[(1, 10), (2, 20)], [(3, 30), (3, 20)], [(4, 10), (4, 30), (5, 50)], [(6, 60)], [(7, 60), (7, 10)]]
    path = str(tmp_path / "campaigns")
    stream(rows, "report_id long, indicator long", lambda s: s, "append", jobs.assign_batch(path, compact))
    state = lambda n: {r.indicator: r.campaign for r in jobs.campaign_links(spark, path, n, compact).collect()}
    assert [state(k) for k in (1, 2, 3)] == [{10: 1, 20: 2}, {10: 1, 20: 2, 30: 2}, {10: 1, 20: 1, 30: 1, 50: 5}] and jobs.campaign_links(spark, path, 0) is None
    assert state(5) == {10: 1, 20: 1, 30: 1, 50: 5, 60: 1}
    told = spark.read.parquet(f"{path}/reports")
    assert {(r.batch, r.report_id, r.campaign) for r in told.collect()} == {(0, 1, 1), (0, 2, 2), (1, 3, 2), (2, 4, 1), (2, 5, 5), (3, 6, 6), (4, 7, 1)}
    assert {(r.batch, r.campaign, r.into) for r in spark.read.parquet(f"{path}/merges").collect()} == {(2, 2, 1), (4, 6, 1)}
    written = {r.batch: r["count"] for r in spark.read.parquet(f"{path}/changes").groupBy("batch").count().collect()}
    assert written == {0: 2, 1: 1, 2: 3, 3: 1, 4: 1}
    assert (tmp_path / "campaigns" / "whole").exists() == (compact == 2)
    before = state(5)
    jobs.assign_batch(path, compact)(spark.createDataFrame(rows[4], "report_id long, indicator long"), 4)  # run again
    assert state(5) == before


def test_carried_and_asof(spark):
    """Running totals of a hot key over many ranges, and an as-of join, against plain loops; null keys are a key."""
    import random

    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(300), i, rng.randrange(5)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, at int, i long, v int").repartition(5)
    got = {r.i: (r.s, r.m) for r in carried(df, "k", ["at", "i"], {"s": F.col("v")}, {"m": F.col("v")}).collect()}
    for k in ("hot", "b", None):
        seen = []
        for _, i, v in sorted((at, i, v) for key, at, i, v in rows if key == k):
            assert got[i] == (sum(seen), max(seen, default=None))
            seen.append(v)
    asked = spark.createDataFrame([(k, t, 450 + n) for n, (k, t) in enumerate([("hot", 100), ("b", 0), ("none", 5), ("b", 299)])], "k string, at int, i long")
    for r in asof(asked, df, "k", ["at", "i"], {"s": "v"}, {"m": "at"}).collect():
        before = [(at, v) for k, at, i, v in rows if k == r.k and (at, i) < (r.at, r.i)]
        assert (r.s, r.m) == (sum(v for _, v in before), max((a for a, _ in before), default=None))


def test_ranked(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "b").alias("k"), (F.col("id") * 7 % 1000).alias("v"))
    got = ranked(df, "k", ["v"]).collect()
    for k in ("hot", "b", None):
        mine = sorted((r.v, r.n, r.n_of) for r in got if r.k == k)
        assert [n for _, n, _ in mine] == list(range(1, len(mine) + 1)) and {m for _, _, m in mine} == {len(mine)}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (None, 4), (6, 5), (6, 5)] + [(100, k) for k in range(101, 300)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5} | {k: 100 for k in range(100, 300)}

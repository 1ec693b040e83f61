"""Message text: small cases with known results, and the registered queries against their SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sentrail import plans
from sentrail.operators import entities as E
from sentrail.operators import text as T
from sentrail.operators import urls as U

SF = "/root/testdata/sf0.001"


def one(spark, column, *values):
    rows = spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x")).alias("y")).collect()
    return [r.y for r in rows]


def test_normalize(spark):
    assert one(spark, T.normalize, "urgenttttt   call  98765  43210", "see http://aaaa.com/xxxx  now", None) == ["urgentt call 98765  43210", "see http://aaaa.com/xxxx now", None]


def test_fold(spark):
    assert one(spark, T.fold, "Udane click pannunga http://Udane.com") == ["immediately click http://Udane.com"]


def test_fingerprint_ignores_links_and_digits(spark):
    a, b, c = one(spark, T.fingerprint, "Pay 100 at http://a.com now", "Pay 999 at http://b.org now", "Pay now please")
    assert a == b != c


def test_redact(spark):
    assert one(spark, T.redact, "Call 9876543210 or mail somebody@x.com", "1234567890123", "a" * 200) == ["Call 987*****10 or mail so***@x.com", "1234****23", "a" * 180 + "…"]


def test_entities(spark):
    text = "SBI: pay Rs.5 lakh to help@ybl or visit http://sbi-kyc.xyz/a. Call 98765-43210 in Adyar"
    got = {(r.type, r.canonical) for r in E.extract(spark.createDataFrame([(1, text), (2, None)], "msg_id long, text string")).collect()}
    assert {("upi", "help@ybl"), ("amount", "inr:500000"), ("domain", "sbi-kyc.xyz"), ("url", "http://sbi-kyc.xyz/a"), ("phone", "+919876543210"), ("locality", "adyar"), ("brand", "sbi")} <= got
    assert not any(t == "email" for t, _ in got)


def test_url_parts(spark):
    urls = ["HTTP://U@Example.COM:80/a/../%7Eb//c/?utm_source=x&b=2&a=1#F", "//www.bbc.co.uk:8443", "192.168.0.1/x"]
    got = {r.url: r for r in U.normalize(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert got[urls[0]].normalized == "http://example.com/~b/c/?a=1&b=2#F"
    assert (got[urls[1]].registered_domain, got[urls[1]].tld, got[urls[1]].subdomain, got[urls[1]].port) == ("bbc.co.uk", "co.uk", "www", 8443)
    assert got[urls[2]].is_ip and got[urls[2]].tld == ""


def test_entropy(spark):
    assert one(spark, U.entropy, "abababab", "a", "", "abcd") == [1.0, 0.0, 0.0, 2.0]


CHECKED = ["lang_detect", "fingerprint", "entity_registry", "dup_candidates", "pulse_dims", "campaign_stats", "url_decompose", "url_keywords", "redirect_chain", "scam_class"]


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        path = f"{SF}/{f}/*.parquet" if os.path.isdir(f"{SF}/{f}") else f"{SF}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    want = sorted(map(str, con.sql(f"SELECT {', '.join(cols)} FROM ({plans.oracle_sql()[name]})").fetchall()))
    assert got == want

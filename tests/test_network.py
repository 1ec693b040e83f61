"""Addresses and snapshots on small tables."""

from sentrail.operators import network as W


def test_kinds(spark):
    want = {
        "8.8.8.8": (True, "IPv4", False), "10.1.2.3": (True, "IPv4", True), "[::1]": (True, "IPv6", True), "2001:4860:4860::8888": (True, "IPv6", False), "240.0.0.1": (True, "IPv4", True),
        "1.2.3": (False, None, False), "256.1.1.1": (False, None, False), "a.example": (False, None, False), "": (False, None, False), None: (False, None, False), "fe80::1": (True, "IPv6", True), "x:80": (False, None, False),
    }
    df = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r.host: tuple(r.k) for r in df.select("host", W.address_kind(df["host"]).alias("k")).collect()} == want


def test_resolution(spark):
    hosts = spark.createDataFrame([(h,) for h in ("two", "six", "both", "gone", "unasked", "9.9.9.9", "::2", None, "two")], "host string")
    snapshot = spark.createDataFrame([("two", "1.1.1.1"), ("two", "1.1.1.2"), ("two", "1.1.1.2"), ("six", "::5"), ("both", "1.1.1.1"), ("both", "::5"), ("gone", None), ("other", "1.1.1.1")], "host string, ip string")
    got = {r.host: (r.resolved, r.failed, r.n_v4, r.n_v6, r.protocol, r.multiple) for r in W.resolution(hosts, snapshot).collect()}
    assert got == {
        "two": (True, False, 2, 0, "IPv4", True), "six": (True, False, 0, 1, "IPv6", False), "both": (True, False, 1, 1, "Dual-Stack", True), "gone": (False, True, 0, 0, None, False),
        "unasked": (False, False, 0, 0, None, False), "9.9.9.9": (True, False, 1, 0, "IPv4", False), "::2": (True, False, 0, 1, "IPv6", False),
    }


def test_owners(spark):
    got = {r.ip: (r.asn, r.org, r.country) for r in W.owners(spark.createDataFrame([(x,) for x in ("8.8.8.8", "104.16.1.1", "10.0.0.1", "[::1]", "9.9.9.9", None, "8.8.8.8")], "ip string")).collect()}
    assert got == {"8.8.8.8": ("AS15169", "Google LLC", "US"), "104.16.1.1": ("AS13335", "Cloudflare, Inc.", "US"), "10.0.0.1": W.PRIVATE, "[::1]": W.PRIVATE, "9.9.9.9": (None, None, None)}

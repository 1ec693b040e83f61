"""Addresses and hosts: kinds of addresses, states of hosts in a passive snapshot, owners of address blocks.

Nothing is looked up on a network; snapshots are tables.
"""

from __future__ import annotations

import ipaddress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrail.functions import fixed

# What stands for the owner of addresses that are not public.
PRIVATE = ("Private", "RFC1918 / Private Network", "Local")


def _kind(host: str | None) -> dict:
    try:
        ip = ipaddress.ip_address((host or "").strip("[]").strip())
    except ValueError:
        return {"is_ip": False, "version": None, "private": False}
    return {"is_ip": True, "version": f"IPv{ip.version}", "private": ip.is_private or ip.is_loopback or ip.is_reserved or ip.is_link_local}


def address_kind(host: Column) -> Column:
    """Struct of is_ip, version (IPv4, IPv6 or null) and private (private, loopback, reserved or link-local).

    Names and nulls are no addresses and stay in the JVM; only what has digits and dots or a colon is parsed.
    """

    def run(hosts: pa.Array) -> pa.Array:
        return pa.array([_kind(h) for h in hosts.to_pylist()], pa.struct([("is_ip", pa.bool_()), ("version", pa.string()), ("private", pa.bool_())]))

    likely = F.coalesce(host.rlike(r"^\s*\[?[0-9.]+\]?\s*$|:"), F.lit(False))
    parsed = F.arrow_udf(run, "struct<is_ip: boolean, version: string, private: boolean>")(F.when(likely, host))
    none = F.struct(F.lit(False).alias("is_ip"), F.lit(None).cast("string").alias("version"), F.lit(False).alias("private"))
    return F.when(likely, parsed).otherwise(none)


def resolution(hosts: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(host, resolved, failed, n_v4, n_v6, protocol, multiple) for the distinct hosts.

    snapshot: host, ip; a null ip says that the host did not resolve. An address stands for itself. A host that the
    snapshot lacks was not asked: resolved and failed are both false. protocol is IPv4, IPv6, Dual-Stack or null.
    """
    asked = hosts.where("host is not null").select("host").distinct().withColumn("own", address_kind(F.col("host")))
    known = snapshot.where("ip is not null").select("host", "ip").distinct().withColumn("kind", address_kind(F.col("ip")))
    found = known.groupBy("host").agg(F.count_if(F.col("kind.version") == "IPv4").alias("v4"), F.count_if(F.col("kind.version") == "IPv6").alias("v6"))
    tried = snapshot.select("host").distinct().withColumn("tried", F.lit(True))
    df = asked.join(found, "host", "left").join(tried, "host", "left")
    n = lambda c, v: F.when(F.col("own.is_ip"), (F.col("own.version") == v).cast("long")).otherwise(F.coalesce(c, F.lit(0)))
    df = df.select("host", "tried", n("v4", "IPv4").alias("n_v4"), n("v6", "IPv6").alias("n_v6"))
    some = (F.col("n_v4") + F.col("n_v6")) > 0
    protocol = F.when((F.col("n_v4") > 0) & (F.col("n_v6") > 0), "Dual-Stack").when(F.col("n_v4") > 0, "IPv4").when(F.col("n_v6") > 0, "IPv6")
    return df.select("host", some.alias("resolved"), (~some & F.coalesce("tried", F.lit(False))).alias("failed"), "n_v4", "n_v6", protocol.alias("protocol"), ((F.col("n_v4") + F.col("n_v6")) > 1).alias("multiple"))


def owners(addresses: DataFrame) -> DataFrame:
    """(ip, asn, org, country) for the distinct addresses: private ones have an owner of their own, others that of the
    first listed prefix that they begin with, and null where there is none."""
    listed = [(n, p, *v) for n, (p, v) in enumerate(fixed.ASN_PREFIXES.items())]
    dim = F.broadcast(addresses.sparkSession.createDataFrame(listed, "n int, prefix string, asn string, org string, country string"))  # a fixed list
    bare = F.btrim("ip", F.lit("[] "))
    ips = addresses.where("ip is not null").select("ip").distinct().select("ip", bare.alias("bare"), address_kind(F.col("ip"))["private"].alias("private"))
    hit = ips.join(dim, F.col("bare").startswith(F.col("prefix")), "left").groupBy("ip", "private").agg(F.min_by(F.struct("asn", "org", "country"), "n").alias("o"))
    pick = lambda k, c: F.when(F.col("private"), F.lit(PRIVATE[k])).otherwise(F.col(f"o.{c}")).alias(c)
    return hit.select("ip", pick(0, "asn"), pick(1, "org"), pick(2, "country"))

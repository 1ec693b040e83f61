"""Queries over URLs, and their SQL. The URLs are those of pages, and a mix of forms made from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrail.functions import fixed
from sentrail.operators import network as W
from sentrail.operators import urls as U
from sentrail.sources.shared import written
from sentrail.sources.tables import read

URL_SQL = """
SELECT DISTINCT CASE o_orderkey % 16
 WHEN 0 THEN 'http://sbi-kyc-' || CAST(o_custkey % 40 AS STRING) || '.xyz/login?utm_source=x&b=2&a=' || CAST(o_custkey % 7 AS STRING)
 WHEN 1 THEN 'https://www.amaz0n-security-login.xyz/verify/' || CAST(o_custkey % 50 AS STRING)
 WHEN 2 THEN 'https://secure.paypa1-help' || CAST(o_custkey % 9 AS STRING) || '.co.uk:8443/a/../b//c/./d/'
 WHEN 3 THEN 'http://192.168.' || CAST(o_custkey % 100 AS STRING) || '.' || CAST(o_orderkey % 200 AS STRING) || ':8080/admin'
 WHEN 4 THEN 'https://onlinesib.top/netbanking?id=' || CAST(o_custkey % 60 AS STRING)
 WHEN 5 THEN 'bit.ly/a' || CAST(o_custkey % 300 AS STRING)
 WHEN 6 THEN 'https://retail.onlinesbi.sbi/login?session=' || CAST(o_custkey % 30 AS STRING)
 WHEN 7 THEN 'https://www.аpple-id' || CAST(o_custkey % 20 AS STRING) || '.com/'
 WHEN 8 THEN 'https://sbl.fake' || CAST(o_custkey % 20 AS STRING) || '.bank.in/kyc'
 WHEN 9 THEN 'HTTP://User@Example.COM:80/%7Efoo/%2fbar' || CAST(o_custkey % 50 AS STRING) || '?Q=1#Frag'
 WHEN 10 THEN 'https://login.netflix.account-verify.' || CAST(o_custkey % 20 AS STRING) || '.club/refund?b=%20x&a=1'
 WHEN 11 THEN 'http://sbi-kyc-update.xyz/' || CAST(o_custkey % 50 AS STRING)
 WHEN 12 THEN 'https://x7k9q2vz8w4m1p6t3.top/qz8xw7v6u5t4s3r2q1/' || CAST(o_custkey % 50 AS STRING)
 WHEN 13 THEN 'https://hdfc.bank.in/cards/' || CAST(o_custkey % 40 AS STRING)
 WHEN 14 THEN 'https://a.b.c.d.nteflix' || CAST(o_custkey % 10 AS STRING) || '.info//evil.com/'
 ELSE 'http://cafe-' || CAST(o_custkey % 200 AS STRING) || '.org/menu?utm_medium=a&ref=b' END AS url
FROM orders
UNION
SELECT url FROM pages
"""


def urls(spark, sf):
    return spark.sql(URL_SQL.replace("FROM orders", "FROM {o}").replace("FROM pages", "FROM {p}"), o=read(spark, sf, "orders"), p=read(spark, sf, "pages"))


def url_scheme(spark, sf):
    return U.split_url(urls(spark, sf)).select("url", "scheme")


def url_host_port(spark, sf):
    return U.split_url(urls(spark, sf)).select("url", "host", F.coalesce("port", F.lit(-1)).alias("port"))


def url_decompose(spark, sf):
    return U.decompose(U.split_url(urls(spark, sf))).select("url", "subdomain", "registered_domain", "tld", "domain", "is_ip")


def url_path(spark, sf):
    return U.split_url(urls(spark, sf)).select("url", U.clean_path(F.col("raw_path")).alias("path"))


def url_pct(spark, sf):
    return urls(spark, sf).select("url", U.decode_unreserved(F.concat("url", F.lit("%7e%2f%zz%41"))).alias("decoded"))


def url_strip_tracking(spark, sf):
    df = U.split_url(urls(spark, sf))
    gone = F.array_join(F.transform(F.filter(U.query_pairs(F.col("raw_query")), lambda p: U.is_tracking(p["k"])), lambda p: p["k"]), ",")
    return df.select("url", U.clean_query(F.col("raw_query")).alias("query"), gone.alias("stripped"))


def url_normalize(spark, sf):
    return U.normalize(urls(spark, sf)).select("url", "normalized")


def url_dedupe(spark, sf):
    return U.normalize(urls(spark, sf)).groupBy("normalized").agg(F.count("*").alias("n"), F.min("url").alias("first_url"))


def url_lexical(spark, sf):
    df = U.lexical(U.normalize(urls(spark, sf)))
    cols = "url_length domain_length subdomain_count path_length query_length dot_count hyphen_count underscore_count digit_count special_count digit_ratio special_ratio path_depth parameter_count unusual_port has_at has_percent double_slash"
    return df.select("url", *cols.split())


def url_semantic(spark, sf):
    df = U.semantic(U.normalize(urls(spark, sf)))
    return df.select("url", F.array_join("semantic", ",").alias("semantic"), "semantic_weight")


def url_keywords(spark, sf):
    return U.keywords(U.semantic(U.normalize(urls(spark, sf)))).select("url", F.array_join("keywords", ",").alias("keywords"))


def url_tld(spark, sf):
    return U.suspicious_tld(U.decompose(U.split_url(urls(spark, sf)))).select("url", "tld", "suspicious_tld")


def host_entropy(spark, sf):
    return U.split_url(urls(spark, sf)).select("host").distinct().select("host", U.entropy(F.col("host")).alias("entropy"))


def url_entropy_flags(spark, sf):
    return U.entropies(U.normalize(urls(spark, sf))).select("url", "domain_entropy", "path_entropy", "high_domain", "high_subdomain", "high_path", "high_query")


def idn_forms(spark, sf):
    hosts = U.split_url(urls(spark, sf)).select("host").distinct()
    return U.idn(hosts.unionByName(hosts.select(F.concat(F.lit("xn--mnchen-3ya."), "host").alias("host"))))


def mixed_script(spark, sf):
    return U.normalize(urls(spark, sf)).select("host", "mixed_script").distinct()


def homograph_risk(spark, sf):
    return U.normalize(urls(spark, sf)).select("host", F.array_join("confusables", "").alias("confusables"), "homograph_risk").distinct()


def official_domain(spark, sf):
    return U.official(U.decompose(U.split_url(urls(spark, sf)))).select("domain", "official").distinct()


def shortener(spark, sf):
    return U.shortener(U.decompose(U.split_url(urls(spark, sf)))).select("url", "shortened")


def ip_host(spark, sf):
    df = U.decompose(U.split_url(urls(spark, sf)))
    private = F.col("host").rlike(r"^(10\.|192\.168\.|127\.|172\.(1[6-9]|2\d|3[01])\.)")
    return df.select("url", "is_ip", (F.col("is_ip") & private).alias("private_ip"))


def unusual_port(spark, sf):
    return U.split_url(urls(spark, sf)).select("url", F.coalesce(~F.col("port").isin(80, 443), F.lit(False)).alias("unusual_port"))


def threat_join(spark, sf):
    feed = spark.createDataFrame([(d, v["category"], v["source"]) for d, v in fixed.THREAT_LIST.items()], "domain string, category string, source string")
    return U.decompose(U.split_url(urls(spark, sf))).join(F.broadcast(feed), "domain").select("url", "domain", "category", "source")  # a fixed list


def known_threats(spark, sf):
    """Listed domains and how many URLs use them."""
    feed = spark.createDataFrame([(d, v["category"]) for d, v in fixed.THREAT_LIST.items()], "domain string, category string")
    n = U.decompose(U.split_url(urls(spark, sf))).groupBy("domain").agg(F.count("*").alias("n"))
    return feed.join(n, "domain", "left").select("domain", "category", F.coalesce("n", F.lit(0)).alias("n"))


def unmask(spark, sf):
    stems = U.decompose(U.split_url(urls(spark, sf))).select("registered_domain").distinct()
    return stems.select("registered_domain", U.unmask(F.col("registered_domain")).alias("unmasked"), U.unmask_groups(U.unmask(F.col("registered_domain"))).alias("ungrouped"))


def stem_tokens(spark, sf):
    stem = U.stem_of(F.col("registered_domain"), F.col("tld"))
    df = U.decompose(U.split_url(urls(spark, sf))).select("registered_domain", "tld").distinct()
    return df.select("registered_domain", stem.alias("stem"), F.array_join(U.stem_tokens(stem), ",").alias("tokens"))


def _stems(spark, sf):
    return written(U.decompose(U.split_url(urls(spark, sf))).select(U.stem_of(F.col("registered_domain"), F.col("tld")).alias("stem")).distinct())


def brand_match(spark, sf):
    return U.brand_match(_stems(spark, sf))


def brand_dl(spark, sf):
    """Edit distance of every name's first token to a brand, where a bound lets it through."""
    t = _stems(spark, sf).select(F.get(U.stem_tokens(F.col("stem")), F.lit(0)).alias("token")).where("token is not null").distinct()
    return near_brands(t)


def near_brands(tokens):
    """Pairs of tokens and brands at a distance of 4 or less; a swap counts 1 there and 2 in plain edits, so 8 of those are a bound."""
    pair = tokens.select("token", F.explode(U.lits(fixed.BRAND_REGISTRY)).alias("brand")).where(F.levenshtein("token", "brand") <= 8)
    d = pair.withColumn("distance", U.edit_distance("token", "brand"))
    return d.withColumn("similarity", F.bround(1 - F.col("distance") / F.greatest(F.char_length("token"), F.char_length("brand")), 3)).where("distance <= 4")


def brand_similarity(spark, sf):
    s = F.col("similarity")
    rating = F.when(s >= 0.85, "HIGH").when(s >= 0.7, "MEDIUM").when(s >= 0.5, "LOW").otherwise("NONE")
    return brand_dl(spark, sf).groupBy(rating.alias("rating")).agg(F.count("*").alias("n"))


def brand_near(spark, sf):
    """Native test for one edit, against the exact distance."""
    t = _stems(spark, sf).select(F.explode(U.stem_tokens(F.col("stem"))).alias("token")).distinct()
    return t.select("token", F.explode(U.lits(fixed.LEGACY_BRANDS)).alias("brand")).where(U.one_edit(F.col("token"), F.col("brand")))


def brand_legacy(spark, sf):
    df = U.normalize(urls(spark, sf))
    return df.select("url", U.legacy_brand(F.col("domain"), F.lower("normalized")).alias("b")).select("url", "b.brand", "b.score")


def url_brands(spark, sf):
    df = U.brands(U.official(U.normalize(urls(spark, sf))))
    return df.select("url", "brand", "brand_score", "brand_source", "mismatch", "n_deceptive")


def url_score(spark, sf):
    return U.score(urls(spark, sf)).select("url", "official", "brand", F.round("score", 1).alias("score"))


def url_verdict(spark, sf):
    return U.verdict(U.score(urls(spark, sf))).select("url", "risk_score", "category", "level", "confidence")


def url_compound(spark, sf):
    done = U.score(urls(spark, sf))
    return done.select("url", "high_domain", "high_subdomain", "high_path", "compound", "entropy_points", F.array_join("entropy_signals", "; ").alias("signals"))


def url_factors(spark, sf):
    done = U.factors(U.verdict(U.score(urls(spark, sf))))
    return done.select("url", "level", F.array_join("factors", "; ").alias("factors"), F.array_join("advice", "; ").alias("advice"))


def brand_diff(spark, sf):
    names = U.normalize(urls(spark, sf), "url").select(U.stem_of(F.col("registered_domain"), F.col("tld")).alias("stem")).distinct()
    return U.brand_differences(names.select(F.explode(U.stem_tokens(F.col("stem"))).alias("token")))


def url_risk_by_domain(spark, sf):
    df = U.verdict(U.score(urls(spark, sf)))
    return df.groupBy("registered_domain").agg(F.count("*").alias("n"), F.max("risk_score").alias("worst"), F.round(F.avg("risk_score"), 6).alias("mean"))


_DNS = "SELECT s_suppkey AS id, 'cafe-' || CAST(s_suppkey % 200 AS STRING) || '.org' AS host, '104.' || CAST(s_suppkey % 40 AS STRING) || '.' || CAST(s_nationkey AS STRING) || '.7' AS ip FROM supplier"


def _dns(spark, sf):
    return spark.sql(_DNS.replace("FROM supplier", "FROM {s}"), s=read(spark, sf, "supplier"))


def dns_enrich(spark, sf):
    """Addresses of each host in a passive snapshot; a host that isn't in it has no signal."""
    ips = _dns(spark, sf).groupBy("host").agg(F.count_distinct("ip").alias("n_ips"))
    hosts = U.split_url(urls(spark, sf)).select("host").distinct()
    n = F.coalesce("n_ips", F.lit(0))
    return hosts.join(ips, "host", "left").select("host", n.alias("n_ips"), (n > 1).alias("multiple_ips"))


def asn_join(spark, sf):
    """Range join of addresses with blocks of a static list; the narrowest block wins."""
    blocks = []
    for prefix, (asn, org, _) in fixed.ASN_PREFIXES.items():
        p = [int(x) for x in prefix.split(".")]
        lo = sum(x << (24 - 8 * i) for i, x in enumerate(p))
        blocks.append((lo, lo + (1 << (32 - 8 * len(p))) - 1, asn, org))
    dim = F.broadcast(spark.createDataFrame(blocks, "lo long, hi long, asn string, org string"))  # a fixed list
    parts = F.transform(F.split("ip", r"\."), lambda x: x.cast("long"))
    ips = _dns(spark, sf).select("ip").distinct().withColumn("n", F.aggregate(parts, F.lit(0).cast("long"), lambda a, b: a * 256 + b))
    return ips.join(dim, (F.col("n") >= F.col("lo")) & (F.col("n") <= F.col("hi")), "left").groupBy("ip").agg(F.min_by("asn", F.col("hi") - F.col("lo")).alias("asn"), F.min_by("org", F.col("hi") - F.col("lo")).alias("org"))


def address_kinds(spark, sf):
    """Distinct hosts of urls and addresses of the snapshot."""
    hosts = U.split_url(urls(spark, sf)).select("host").unionByName(_dns(spark, sf).select(F.col("ip").alias("host"))).distinct()
    return hosts.select("host", W.address_kind(F.col("host")).alias("k")).select("host", "k.is_ip", "k.version", "k.private")


def dns_state(spark, sf):
    return W.resolution(_dns(spark, sf).select("host").unionByName(U.split_url(urls(spark, sf)).select("host")), _dns(spark, sf).select("host", F.when(~F.col("host").startswith("cafe-1"), F.col("ip")).alias("ip")))


def address_owners(spark, sf):
    private = F.when(F.col("id") % 7 == 0, F.concat(F.lit("10.0.0."), (F.col("id") % 250).cast("string"))).otherwise(F.col("ip"))
    return W.owners(_dns(spark, sf).select(private.alias("ip")))


_HOPS = "SELECT DISTINCT 'bit.ly/' || CAST(l_orderkey % 500 AS STRING) AS src, CASE WHEN l_orderkey % 500 % 5 = 0 THEN 'https://end' || CAST(l_orderkey % 500 AS STRING) || '.org/' ELSE 'bit.ly/' || CAST((l_orderkey % 500 + 7) % 500 AS STRING) END AS dst FROM lineitem"


def redirect_chain(spark, sf):
    """Follows captured redirects for at most five hops; a chain that comes back to a place it has seen stops."""
    hop = spark.sql(_HOPS.replace("FROM lineitem", "FROM {l}"), l=read(spark, sf, "lineitem"))
    now = hop.select("src", F.col("dst").alias("final"), F.array("src", "dst").alias("chain"))
    for _ in range(4):
        step = hop.select(F.col("src").alias("final"), F.col("dst").alias("next"))
        now = now.join(step, "final", "left").select(
            "src",
            F.when(F.col("next").isNull() | F.array_contains("chain", F.col("next")), F.col("final")).otherwise(F.col("next")).alias("final"),
            F.when(F.col("next").isNull() | F.array_contains("chain", F.col("next")), F.col("chain")).otherwise(F.concat("chain", F.array("next"))).alias("chain"),
        )
    return now.select("src", "final", (F.size("chain") - 1).alias("hops"), F.array_join("chain", " > ").alias("chain"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return ", ".join(_q(x) for x in xs)


_PARTS = rf"""WITH urls AS ({URL_SQL}),
a AS (SELECT url, CASE WHEN regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://') THEN lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*)://', 1)) ELSE 'http' END AS scheme,
  regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://', '') AS rest FROM urls),
b AS (SELECT *, regexp_replace(regexp_extract(rest, '^[^/?#]*'), '^[^@]*@', '') AS net, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS raw_path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS raw_query,
  regexp_extract(rest, '^[^#]*#(.*)$', 1) AS fragment FROM a),
c AS (SELECT *, rtrim(lower(CASE WHEN regexp_matches(net, ':\d+$') THEN regexp_replace(net, ':\d+$', '') ELSE net END), '.') AS host, TRY_CAST(nullif(regexp_extract(net, ':(\d+)$', 1), '') AS INT) AS p0 FROM b),
d AS (SELECT *, CASE WHEN (scheme = 'http' AND p0 = 80) OR (scheme = 'https' AND p0 = 443) THEN NULL ELSE p0 END AS port, string_split(host, '.') AS lb, regexp_matches(host, '^\d+\.\d+\.\d+\.\d+$') AS is_ip FROM c),
e AS (SELECT *, CASE WHEN is_ip OR len(lb) <= 1 THEN 0 WHEN len(lb) >= 3 AND (lb[-2] || '.' || lb[-1] IN ({_list(fixed.MULTI_PART_TLDS)}) OR (length(lb[-1]) = 2 AND lb[-2] IN ({_list(fixed.SECOND_LEVELS)}))) THEN 2 ELSE 1 END AS k FROM d),
f AS (SELECT *, CASE k WHEN 0 THEN '' ELSE array_to_string(lb[-k:], '.') END AS tld, CASE k WHEN 0 THEN host ELSE array_to_string(lb[-(k + 1):], '.') END AS registered_domain,
  CASE WHEN k > 0 AND len(lb) > k + 1 THEN array_to_string(lb[:len(lb) - k - 1], '.') ELSE '' END AS subdomain, CASE WHEN host LIKE 'www.%' AND len(lb) > 2 THEN substr(host, 5) ELSE host END AS domain FROM e),
g AS (SELECT *, CASE WHEN raw_path IN ('', '/') THEN '/' ELSE '/' || array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split(replace(replace(raw_path, '%7E', '~'), '%2f', '%2F'), '/'), lambda x: [x])),
  lambda s, x: CASE WHEN x[1] IN ('', '.') THEN s WHEN x[1] = '..' THEN s[:len(s) - 1] ELSE list_concat(s, x) END), '/') || CASE WHEN raw_path LIKE '%/' THEN '/' ELSE '' END END AS path,
  list_filter(list_transform(string_split(raw_query, '&'), lambda x: {{'k': url_decode(replace(regexp_extract(x, '^[^=]*'), '+', ' ')), 'v': url_decode(replace(regexp_extract(x, '^[^=]*=(.*)$', 1), '+', ' '))}}), lambda p: p.k <> '' OR p.v <> '') AS ps FROM f),
h AS (SELECT *, array_to_string(list_transform(list_sort(list_filter(ps, lambda p: NOT (lower(p.k) IN ({_list(fixed.TRACKING_PARAMS)}) OR lower(p.k) LIKE 'utm_%'))), lambda p: replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')), '&') AS query,
  array_to_string(list_transform(list_filter(ps, lambda p: lower(p.k) IN ({_list(fixed.TRACKING_PARAMS)}) OR lower(p.k) LIKE 'utm_%'), lambda p: p.k), ',') AS stripped,
  array_to_string(list_filter(string_split(host, ''), lambda x: x IN ({_list(fixed.CONFUSABLES)})), '') AS confusables,
  len(list_filter(lb, lambda x: regexp_matches(x, '[a-z]') AND regexp_matches(x, '[^\x00-\x7F]'))) > 0 AND NOT is_ip AS mixed FROM g),
i AS (SELECT *, CASE WHEN mixed OR confusables <> '' THEN 'CRITICAL' WHEN regexp_matches(host, '[^\x00-\x7F]|xn--') THEN 'LOW' ELSE 'NONE' END AS homograph_risk FROM h),
n AS (SELECT *, scheme || '://' || domain || CASE WHEN port IS NOT NULL THEN ':' || port ELSE '' END || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END || CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END AS normalized FROM i)"""


def _entropy(x: str) -> str:
    return f"CASE WHEN length({x}) <= 1 THEN 0.0 ELSE round(coalesce((SELECT -sum(p * log2(p)) FROM (SELECT count(*) / length({x}) AS p FROM (SELECT unnest(string_split({x}, '')) AS ch) GROUP BY ch)), 0), 3) END"


# Hosts of URL_SQL whose letters are shown in ASCII form; DuckDB has no IDNA.
_ASCII = ", ".join(f"({_q(h)}, {_q(h.encode('idna').decode())})" for h in (f"\u0430pple-id{k}.com" for k in range(20)))
_NORMAL = f"""{_PARTS}, pn(d, ascii_domain) AS (VALUES {_ASCII}),
nz AS (SELECT n.* REPLACE (CASE WHEN homograph_risk = 'CRITICAL' THEN replace(normalized, '://' || domain, '://' || coalesce(ascii_domain, domain)) ELSE normalized END AS normalized) FROM n LEFT JOIN pn ON d = domain)"""
_COUNT = lambda c: f"length(normalized) - length(replace(normalized, '{c}', ''))"
_FILLED = lambda part, mark: f"CAST(len(list_filter(string_split({part}, '{mark}'), lambda x: x <> '')) AS INT)"
_SPECIAL = r"len(regexp_extract_all(normalized, '[^\p{L}\p{N}/:]'))"
_DIGITS = r"len(regexp_extract_all(normalized, '\p{Nd}'))"
_LEXICAL = f"""CAST(length(normalized) AS INT) AS url_length, CAST(length(domain) AS INT) AS domain_length, {_FILLED('subdomain', '.')} AS subdomain_count, CAST(length(path) AS INT) AS path_length, CAST(length(query) AS INT) AS query_length,
CAST({_COUNT('.')} AS INT) AS dot_count, CAST({_COUNT('-')} AS INT) AS hyphen_count, CAST({_COUNT('_')} AS INT) AS underscore_count, CAST({_DIGITS} AS INT) AS digit_count, CAST({_SPECIAL} AS INT) AS special_count,
round_even({_DIGITS} / greatest(length(normalized), 1), 4) AS digit_ratio, round_even({_SPECIAL} / greatest(length(normalized), 1), 4) AS special_ratio, {_FILLED('path', '/')} AS path_depth, {_FILLED('query', '&')} AS parameter_count,
coalesce(port NOT IN (80, 443), false) AS unusual_port, contains(normalized, '@') OR contains(url, '@') AS has_at, regexp_matches(normalized, '%[0-9a-fA-F]{{2}}') OR regexp_matches(url, '%[0-9a-fA-F]{{2}}') AS has_percent, contains(regexp_replace(url, '^.*?://', ''), '//') AS double_slash"""
_TRIMMED = "trim(path, '/')"
_LONG = lambda part, n: f"CASE WHEN length({part}) > {n} THEN {_entropy(part)} ELSE 0.0 END"
_ENTROPIES = f"""{_NORMAL}, et AS (SELECT url, domain, subdomain, query, {_TRIMMED} AS tr FROM nz), es AS (SELECT *, {_entropy('domain')} AS domain_entropy, {_LONG('subdomain', 2)} AS subdomain_entropy, {_LONG('tr', 3)} AS path_entropy, {_LONG('query', 3)} AS query_entropy FROM et)"""

_GROUPS = ", ".join("CASE " + " ".join(f"WHEN contains(lower(normalized), {_q(v)}) THEN {_q(v)}" for v in vs) + " END" for vs in fixed.SEMANTIC_GROUPS.values())
_SEMANTIC = f"list_filter([{_GROUPS}], lambda x: x IS NOT NULL)"
_KEYWORDS = f"list_sort(list_distinct(list_concat({_SEMANTIC}, list_filter([{_list(fixed.SUSPICIOUS_WORDS)}], lambda w: contains(lower(normalized), w) OR contains(lower(url), w)))))"
_KNOWN = sorted({d for ds in fixed.LEGACY_BRANDS.values() for d in ds} | {d for b in fixed.BRAND_REGISTRY.values() for d in b["official_domains"]})
_OFFICIAL = f"(len(list_filter([{_list(_KNOWN)}], lambda o: domain = o OR ends_with(domain, '.' || o))) > 0 OR domain IN ({_list(b + '.bank.in' for b in fixed.BANK_IN_ROOTS)}) OR regexp_matches(domain, '\\.(gov|nic)\\.in$'))"
_TARGETS = ", ".join(f"({i}, {_q(b)}, {_q(t)})" for i, b, t in U.brand_targets())
_UNMASK = f"translate(%s, '{''.join(fixed.LEET)}@$', '{''.join(fixed.LEET.values())}as')"
_UNGROUP = "replace(replace(replace(replace(%s, 'rn', 'm'), 'vv', 'w'), 'cl', 'd'), 'nn', 'm')"
#: DuckDB's distances count bytes, so the one character of more than a byte gets one of its own.
_BYTE = "replace(%s, 'а', chr(1))"
_STEMS = "st AS (SELECT DISTINCT registered_domain, CASE WHEN tld <> '' THEN substr(registered_domain, 1, length(registered_domain) - length(tld) - 1) ELSE split_part(registered_domain, '.', 1) END AS stem, tld FROM n)"
_TOKENS = "list_filter(regexp_split_to_array(stem, '[-_.]+'), lambda x: x <> '')"
_BRAND = f""", targets(ti, brand, target) AS (VALUES {_TARGETS}),
cd AS (SELECT DISTINCT stem, ci, toks[ci] AS cand FROM (SELECT stem, toks, unnest(range(1, len(toks) + 1)) AS ci FROM (SELECT DISTINCT stem, CASE WHEN len({_TOKENS}) > 1 THEN list_append({_TOKENS}, regexp_replace(stem, '[-_]', '', 'g')) ELSE {_TOKENS} END AS toks FROM %s))),
ce AS (SELECT *, {_UNMASK % 'cand'} AS u FROM cd WHERE length(cand) >= 2), cf AS (SELECT *, {_UNGROUP % 'u'} AS s FROM ce),
cg AS (SELECT *, damerau_levenshtein({_BYTE % 'cand'}, target) AS da, damerau_levenshtein({_BYTE % 's'}, target) AS db, length(cand) = length(target) AND length(target) IN (3, 4) AND list_sort(string_split(cand, '')) = list_sort(string_split(target, '')) AS ana FROM cf, targets),
ch AS (SELECT *, greatest(round(1 - da / greatest(length(cand), length(target)), 3), round(1 - db / greatest(length(s), length(target)), 3)) AS sim FROM cg),
ck AS (SELECT *, CASE WHEN cand = target THEN 1.0 WHEN u = target OR s = target THEN 0.95 WHEN least(da, db) = 1 OR ana THEN 0.90 WHEN least(da, db) <= 1 OR sim >= 0.75 THEN round(sim, 2) END AS brand_score FROM ch),
bm AS (SELECT stem, brand, CAST(brand_score AS DOUBLE) AS brand_score, cand AS token FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY brand_score DESC, ci, ti) AS rn FROM ck WHERE brand_score IS NOT NULL) WHERE rn = 1 AND brand_score >= 0.7)"""
_DL = f"""{_PARTS}, {_STEMS}, tk AS (SELECT DISTINCT {_TOKENS}[1] AS token FROM st), dl AS (SELECT token, brand, CAST(damerau_levenshtein({_BYTE % 'token'}, brand) AS DOUBLE) AS distance FROM tk, (SELECT unnest([{_list(fixed.BRAND_REGISTRY)}]) AS brand) WHERE token IS NOT NULL),
dm AS (SELECT *, round(1 - distance / greatest(length(token), length(brand)), 3) AS similarity FROM dl)"""
_DROP = lambda long, short: f"list_filter(range(1, length({long}) + 1), lambda i: left({long}, i - 1) || substr({long}, i + 1) = {short})[1]"
_SWAP = "list_filter(range(1, length(token)), lambda i: left(token, i - 1) || substr(token, i + 1, 1) || substr(token, i, 1) || substr(token, i + 2) = target)[1]"
_DIFF = f"""{_PARTS}, {_STEMS}, tk AS (SELECT DISTINCT unnest({_TOKENS}) AS token FROM st), targets(ti, brand, target) AS (VALUES {_TARGETS}),
df AS (SELECT DISTINCT token, brand, target, CASE WHEN length(token) + 1 = length(target) THEN {_DROP('target', 'token')} END AS m, CASE WHEN length(token) = length(target) + 1 THEN {_DROP('token', 'target')} END AS e,
 CASE WHEN length(token) = length(target) AND token <> target THEN {_SWAP} END AS s, length(token) = length(target) AND length(target) IN (3, 4) AND token <> target AND list_sort(string_split(token, '')) = list_sort(string_split(target, '')) AS ana FROM tk, targets)"""

QUERIES = {
    f.__name__: f
    for f in (
        address_kinds, dns_state, address_owners, url_scheme, url_host_port, url_decompose, url_path, url_pct, url_strip_tracking, url_normalize, url_dedupe, url_lexical, url_semantic, url_keywords, url_tld, host_entropy, url_entropy_flags, idn_forms,
        mixed_script, homograph_risk, official_domain, shortener, ip_host, unusual_port, threat_join, known_threats, unmask, stem_tokens, brand_match, brand_dl, brand_similarity, brand_near, brand_legacy,
        url_brands, url_score, url_verdict, url_risk_by_domain, url_compound, url_factors, brand_diff, dns_enrich, asn_join, redirect_chain,
    )
}

ORACLE_SQL = {
    "brand_diff": f"{_DIFF} SELECT token, brand, target, CASE WHEN m IS NOT NULL THEN 'missing' WHEN e IS NOT NULL THEN 'extra' WHEN s IS NOT NULL THEN 'transposed' ELSE 'anagram' END AS kind, CASE WHEN m IS NOT NULL THEN substr(target, m, 1) WHEN e IS NOT NULL THEN substr(token, e, 1) WHEN s IS NOT NULL THEN substr(token, s, 2) ELSE target END AS letters FROM df WHERE m IS NOT NULL OR e IS NOT NULL OR s IS NOT NULL OR ana",
    "url_scheme": f"{_PARTS} SELECT url, scheme FROM n",
    "url_host_port": f"{_PARTS} SELECT url, host, coalesce(port, -1) AS port FROM n",
    "url_decompose": f"{_PARTS} SELECT url, subdomain, registered_domain, tld, domain, is_ip FROM n",
    "url_normalize": f"{_NORMAL} SELECT url, normalized FROM nz",
    "url_dedupe": f"{_NORMAL} SELECT normalized, count(*) AS n, min(url) AS first_url FROM nz GROUP BY 1",
    "url_lexical": f"{_NORMAL} SELECT url, {_LEXICAL} FROM nz",
    "url_entropy_flags": f"""{_ENTROPIES} SELECT url, domain_entropy, path_entropy, domain_entropy >= 3.8 AND length(domain) >= 8 AS high_domain, subdomain_entropy >= 3.8 AND length(subdomain) >= 8 AS high_subdomain,
 path_entropy >= 4.0 AND length(tr) >= 14 AS high_path, query_entropy >= 4.2 AND length(query) >= 20 AS high_query FROM es""",
    "url_path": f"{_PARTS} SELECT url, path FROM n",
    "url_strip_tracking": f"{_PARTS} SELECT url, query, stripped FROM n",
    "url_tld": f"{_PARTS} SELECT url, tld, tld IN ({_list(fixed.SUSPICIOUS_TLDS)}) OR list_last(string_split(tld, '.')) IN ({_list(fixed.SUSPICIOUS_TLDS)}) AS suspicious_tld FROM n",
    "url_semantic": f"{_PARTS} SELECT url, array_to_string({_SEMANTIC}, ',') AS semantic, CAST(round(least(0.75, len({_SEMANTIC}) * 0.15), 2) AS DOUBLE) AS semantic_weight FROM n",
    "url_keywords": f"{_PARTS} SELECT url, array_to_string({_KEYWORDS}, ',') AS keywords FROM n",
    "host_entropy": f"{_PARTS}, hh AS (SELECT DISTINCT host FROM n) SELECT host, {_entropy('host')} AS entropy FROM hh",
    "mixed_script": f"{_PARTS} SELECT DISTINCT host, mixed AS mixed_script FROM n",
    "homograph_risk": f"{_PARTS} SELECT DISTINCT host, confusables, homograph_risk FROM n",
    "official_domain": f"{_PARTS} SELECT DISTINCT domain, {_OFFICIAL} AS official FROM n",
    "shortener": rf"{_PARTS} SELECT url, len(list_filter([{_list(fixed.SHORTENERS)}], lambda o: domain = o OR ends_with(domain, '.' || o))) > 0 OR (length(domain) <= 7 AND contains(domain, '.') AND regexp_matches(raw_path, '^/[a-zA-Z0-9_-]{{2,12}}$')) AS shortened FROM n",
    "ip_host": rf"{_PARTS} SELECT url, is_ip, is_ip AND regexp_matches(host, '^(10\.|192\.168\.|127\.|172\.(1[6-9]|2\d|3[01])\.)') AS private_ip FROM n",
    "unusual_port": f"{_PARTS} SELECT url, coalesce(port NOT IN (80, 443), false) AS unusual_port FROM n",
    "threat_join": f"{_PARTS}, t(domain, category, source) AS (VALUES {', '.join(f'({_q(d)}, {_q(v["category"])}, {_q(v["source"])})' for d, v in fixed.THREAT_LIST.items())}) SELECT url, domain, category, source FROM n JOIN t USING (domain)",
    "known_threats": f"{_PARTS}, t(domain, category) AS (VALUES {', '.join(f'({_q(d)}, {_q(v["category"])})' for d, v in fixed.THREAT_LIST.items())}) SELECT domain, category, count(url) AS n FROM t LEFT JOIN n USING (domain) GROUP BY ALL",
    "unmask": f"{_PARTS} SELECT DISTINCT registered_domain, {_UNMASK % 'registered_domain'} AS unmasked, {_UNGROUP % (_UNMASK % 'registered_domain')} AS ungrouped FROM n",
    "stem_tokens": f"{_PARTS}, {_STEMS} SELECT registered_domain, stem, array_to_string({_TOKENS}, ',') AS tokens FROM st",
    "brand_match": f"{_PARTS}, {_STEMS}{_BRAND % 'st'} SELECT * FROM bm",
    "brand_dl": f"{_DL} SELECT * FROM dm WHERE distance <= 4",
    "brand_similarity": f"{_DL} SELECT CASE WHEN similarity >= 0.85 THEN 'HIGH' WHEN similarity >= 0.7 THEN 'MEDIUM' WHEN similarity >= 0.5 THEN 'LOW' ELSE 'NONE' END AS rating, count(*) AS n FROM dm WHERE distance <= 4 GROUP BY 1",
    "brand_near": f"{_PARTS}, {_STEMS}, tk AS (SELECT DISTINCT unnest({_TOKENS}) AS token FROM st) SELECT token, brand FROM tk, (SELECT unnest([{_list(fixed.LEGACY_BRANDS)}]) AS brand) WHERE damerau_levenshtein({_BYTE % 'token'}, brand) <= 1",
    "dns_enrich": f"{_PARTS}, dns AS ({_DNS}), g2 AS (SELECT host, count(DISTINCT ip) AS n_ips FROM dns GROUP BY 1), hh AS (SELECT DISTINCT host FROM n) SELECT host, coalesce(n_ips, 0) AS n_ips, coalesce(n_ips, 0) > 1 AS multiple_ips FROM hh LEFT JOIN g2 USING (host)",
    "asn_join": f"WITH dns AS (SELECT DISTINCT ip FROM ({_DNS})), b(prefix, asn, org) AS (VALUES {', '.join(f'({_q(p)}, {_q(v[0])}, {_q(v[1])})' for p, v in fixed.ASN_PREFIXES.items())}) SELECT ip, arg_max(asn, length(prefix)) AS asn, arg_max(org, length(prefix)) AS org FROM dns LEFT JOIN b ON starts_with(ip || '.', prefix || '.') GROUP BY ip",
    "address_kinds": rf"""{_PARTS}, dns AS ({_DNS}), hh AS (SELECT host FROM n UNION SELECT ip FROM dns) SELECT host, regexp_matches(host, '^\d+(\.\d+){{3}}$') AS is_ip, CASE WHEN regexp_matches(host, '^\d+(\.\d+){{3}}$') THEN 'IPv4' END AS version,
 regexp_matches(host, '^(10\.|192\.168\.|127\.|172\.(1[6-9]|2\d|3[01])\.)\d+\.\d+') AS private FROM hh WHERE host IS NOT NULL""",
    "dns_state": f"""{_PARTS}, dns AS ({_DNS}), hh AS (SELECT host FROM n UNION SELECT host FROM dns), k AS (SELECT host, count(DISTINCT ip) FILTER (NOT starts_with(host, 'cafe-1')) AS v FROM dns GROUP BY 1 UNION ALL SELECT host, 1 FROM hh WHERE regexp_matches(host, '^\\d+(\\.\\d+){{3}}$'))
SELECT host, coalesce(v, 0) > 0 AS resolved, v IS NOT NULL AND v = 0 AS failed, coalesce(v, 0) AS n_v4, CAST(0 AS BIGINT) AS n_v6, CASE WHEN v > 0 THEN 'IPv4' END AS protocol, coalesce(v, 0) > 1 AS multiple FROM hh LEFT JOIN k USING (host) WHERE host IS NOT NULL""",
    "address_owners": f"""WITH dns AS (SELECT DISTINCT CASE WHEN id % 7 = 0 THEN '10.0.0.' || CAST(id % 250 AS STRING) ELSE ip END AS ip FROM ({_DNS})), b(n, prefix, asn, org, country) AS (VALUES {', '.join(f'({n}, {_q(p)}, {_q(v[0])}, {_q(v[1])}, {_q(v[2])})' for n, (p, v) in enumerate(fixed.ASN_PREFIXES.items()))})
SELECT ip, CASE WHEN starts_with(ip, '10.') THEN '{W.PRIVATE[0]}' ELSE arg_min(asn, n) END AS asn, CASE WHEN starts_with(ip, '10.') THEN '{W.PRIVATE[1]}' ELSE arg_min(org, n) END AS org, CASE WHEN starts_with(ip, '10.') THEN '{W.PRIVATE[2]}' ELSE arg_min(country, n) END AS country FROM dns LEFT JOIN b ON starts_with(ip, prefix) GROUP BY ip""",
    "redirect_chain": f"""WITH RECURSIVE hop AS ({_HOPS}), w(src, final, chain) AS (
  SELECT src, dst, [src, dst] FROM hop UNION ALL SELECT w.src, hop.dst, list_append(chain, hop.dst) FROM w JOIN hop ON hop.src = w.final WHERE len(chain) < 6 AND NOT list_contains(chain, hop.dst))
SELECT src, final, CAST(len(chain) - 1 AS INT) AS hops, array_to_string(chain, ' > ') AS chain FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY len(chain) DESC) AS rn FROM w) WHERE rn = 1""",
}

"""Archives and capture index: exact round trips and searches against plain versions."""

import base64
import gzip
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sentrail.llm import warc


def key(url):
    url = url or ""
    if "://" not in url:
        return ")" + url
    rest = url.split("://", 1)[1].split("#", 1)[0]
    site = rest.split("/", 1)[0].split("?", 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in site.rpartition("@")[2])
    name, colon, port = host.rpartition(":")
    port = colon + port if colon and (not port or (port.isascii() and port.isdigit())) else ""
    return ",".join(reversed((host[: -len(port)] if port else host).split("."))) + port + ")" + rest[len(site) :]


ODD_URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/A?b#c", "https://u:p@h@x.example.org:8080/p", "http://a.b?q=://z", "://x/y", "http://é.example/\n%0A%250D", "http://a.b:/c", "a" * 300_000, "http://x.example/" + "p" * 100_000]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    bodies = [None, "", "x", "é" * 50, "\r\n\r\nContent-Length: 9\r\n", "<p>" + "漢" * 200_000]
    out = [(i, f"http://h{rng.randrange(9)}.example.com/{rng.randrange(20)}", rng.choice([*bodies, f"own {i}"])) for i in range(150)]
    out += [(200 + i, u, f"u{i}") for i, u in enumerate(ODD_URLS)] + [(5, "http://again.example/", "x")] * 2 + [(None, "http://null.example/", "x"), (None, "http://null.example/", "only here"), (300, "http://hot.example/", "hot")]
    return out + [(400 + i, "http://hot.example/", "hot") for i in range(60)]


@pytest.fixture(scope="module")
def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "y") for r in rows], "page_id long, url string, html string, cid int, `a.b` string").repartition(3)


def plain(rows, least):
    best = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= least and i is not None:
            best[raw] = max(best.get(raw, i), i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        response = best.get(raw, i) == i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else best[raw]))
    return out


ORDER = lambda r: tuple((x is None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("least", [0, 2])
def test_round_trip(pages, rows, least):
    got = warc.round_trip(pages, least=least)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=ORDER) == sorted(plain(rows, least), key=ORDER)


def test_keys(spark):
    table = spark.createDataFrame([(u,) for u in ODD_URLS], "url string")
    assert [r.k for r in table.select(warc.capture_key(F.col("url")).alias("k")).collect()] == [key(u) for u in ODD_URLS]


def test_search_and_payloads(spark, pages, rows):
    """One key or a key and an id, in small blocks that hot keys span; what is missing gives nothing; revisits have the payload of their response."""
    folder, places = warc.write_archives(pages)
    index = warc.build_index(places, folder, lines=4)
    held = defaultdict(list)
    for i, u, h in rows:
        held[key(u)].append(("" if i is None else str(i), h or ""))
    asked = [*held, "com,example,h0)/none", "", "zzz)"]
    found = warc.search(index, spark.createDataFrame([(k, None) for k in asked] * 2, "skey string, cid string"))
    assert sorted((r.skey, r.cid) for r in found.collect()) == sorted((k, c) for k, v in held.items() for c, _ in v)
    pairs = [(k, c) for k, v in held.items() for c, _ in v] + [("zzz)", "1"), (key(rows[0][1]), "no")]
    one = warc.search(index, spark.createDataFrame(pairs, "skey string, cid string"))
    assert sorted((r.skey, r.cid) for r in one.collect()) == sorted((k, c) for k, v in held.items() for c, _ in v)
    whole = warc.payloads(index, spark.createDataFrame([(k, None) for k in held], "skey string, cid string"))
    want = sorted(("" if i is None else str(i), u or "", (h or "").encode()) for i, u, h in rows)
    assert sorted((r.cid, r.url, bytes(r.payload)) for r in whole.collect()) == want


def test_archives_are_plain_gzip(spark, pages):
    """Any reader of concatenated gzip members sees the records one after another."""
    folder, places = warc.write_archives(pages)
    files = [r.file for r in places.select("file").distinct().collect()]
    data = b"".join(gzip.decompress(open(f"{folder.removeprefix('file:')}/{f}", "rb").read()) for f in files)
    assert data.count(b"WARC/1.1\r\nWARC-Type: ") == pages.count()


def test_broken_record():
    raw = warc.record("1", "http://a/", b"abc", warc.payload_digest(b"abd"), None, None, warc.DATE)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

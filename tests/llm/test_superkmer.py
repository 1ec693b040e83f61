"""Repeated windows against a brute-force version."""

import hashlib
import random

import pytest

from sentrail.llm import superkmer


def brute(rows, size):
    first, out = {}, []
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - size + 1):
            if i is not None:
                g = tuple(w[k : k + size])
                first[g] = min(first.get(g, i), i)
    for i, w in words:
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("size,m,hot", [(5, 2, 50_000), (5, 2, 1), (4, 4, 50_000), (6, 1, 2)])
def test_small(spark, size, m, hot):
    rng = random.Random(size * 10 + m + hot)
    rows = []
    for i in range(120):
        text = "".join(rng.choice(["a", "b", "c", "é"]) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.choice([0, 1, 3, 8, 20, 60])))
        rows += [(i % 100, text)] * rng.choice([1, 1, 2])
    passage = " ".join("p%d" % k for k in range(12))
    rows += [(200 + i, f"u{i} v{i} {passage} w{i}") for i in range(40)] + [(None, passage), (7, None), (300, ""), (301, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in superkmer.digests(docs, size=size, m=m, hot=hot).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, size), key=key)


def test_texts_and_clashes(spark):
    long = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, long, 1, "x"), (2, "own " + long + " end", 2, "y"), (3, None, 3, None)], "doc_id long, text string, id long, kept string")
    got = {r.doc_id: r for r in superkmer.remove_repeats(docs).collect()}
    assert got[1].text == long and got[2].text == "own end" and got[3].text is None
    assert [got[k].id for k in (1, 2, 3)] == [1, 2, 3] and got[2].kept == "y"
    assert superkmer.digests(docs.limit(0)).count() == 0


def test_names(spark):
    long = " ".join(f"w{k}" for k in range(60))
    names = ["doc_id", "text", "own", "key", "_own", "kept", "a.b"]
    docs = spark.createDataFrame([(k, long, *["v"] * 5) for k in (1, 2)], ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    got = superkmer.remove_repeats(docs)
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == [(1, long, *["v"] * 5), (2, "", *["v"] * 5)]

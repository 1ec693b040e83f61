"""Benchmark decontamination against a plain version."""

import hashlib
import random
import re

import pytest

from sentrail.llm import decontam


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)]


def brute(text, items, size):
    """n_words, n_hit, n_items, digest and hit words of one text."""
    mine = [w for _, _, w in words(text)]
    hit, ids = set(), set()
    for i, t in items:
        w = [x for _, _, x in words(t)]
        k = min(size, len(w))
        grams = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        for j in range(len(mine) - k + 1):
            if k and tuple(mine[j : j + k]) in grams:
                hit |= set(range(j, j + k))
                ids.add("" if i is None else str(i))
    return len(mine), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), hit


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice(["a", "B", "é", "7"]) + rng.choice([" ", "-", "\n", " . "]) for _ in range(n))
    docs = [(k, text(rng.choice([0, 1, 5, 30]))) for k in range(60)] + [(3, "a b"), (3, "a b"), (None, "B a"), (70, None), (71, "x" * 9000 + " a b")]
    items = [(k, text(rng.choice([0, 2, 3, 9]))) for k in range(8)] + [(20, None), (None, "é é"), (21, "..."), (1, "a b"), (1, "a b"), (22, "7")]
    names = "doc_id long, text string, n_hit string, _hit int, contaminated string, `a.b` int"
    return spark.createDataFrame([(*r, "u", 1, "v", 2) for r in docs], names), spark.createDataFrame(items, "item_id long, text string"), docs, items


@pytest.mark.parametrize("block", [1_000_000, 10])
def test_hits(tables, block):
    """One block and several give the same."""
    docs, bench, rows, items = tables
    got = decontam.find_hits(docs.select("doc_id", "text"), bench, keep=["doc_id"], size=4, block_windows=block).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = [(i, *brute(t, items, 4)[:4]) for i, t in rows]
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    assert all(r.contaminated == (r.n_hit > 0) for r in got)
    assert any(r.n_items > 2 for r in got) and any(r.n_hit == 0 for r in got)


def test_drop_and_cut(tables):
    """Columns of any name stay; cut texts are those without the hit words."""
    docs, bench, rows, items = tables
    items = [x for x in items if x[0] != 22]
    bench = bench.where("item_id is null or item_id != 22")
    left = decontam.drop_documents(docs, bench, size=4)
    assert left.columns == docs.columns
    assert {(r.doc_id, r.text, r.n_hit, r["_hit"], r["a.b"]) for r in left.collect()} == {(i, t, "u", 1, 2) for i, t in rows if not brute(t, items, 4)[4]}
    cut = decontam.remove_spans(docs, bench, size=4)
    assert cut.columns == docs.columns
    for r in cut.collect():
        if r.text is not None:
            whole = [t for i, t in rows if i == r.doc_id]
            assert [w for _, _, w in words(r.text)] in [[w for k, (_, _, w) in enumerate(words(t)) if k not in brute(t, items, 4)[4]] for t in whole]


def test_empty_tables(tables):
    docs, bench, _, _ = tables
    assert decontam.drop_documents(docs.limit(0), bench).count() == 0
    assert decontam.drop_documents(docs, bench.limit(0)).count() == docs.count()

"""The stages of the corpus pipeline against plain versions, each on its own input."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sentrail.llm import bayeslsh, crf, packing
from sentrail.llm._tokens import Encoder, vocabulary
from test_linealign import brute as brute_lines

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    """rows: [(id, text)] -> [(id, n, component, kept)], by all pairs."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                both = len(a & sets[j])
                if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                    group[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = (min(ids) if ids else None) if sets[i] else d
        out.append((d, len(sets[i]), least, least is None or d == least))
    return out


def test_near_duplicates(spark):
    base = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(base[:k] + ["x%d" % i] * (k % 3) + base[k:])) for i, k in enumerate(range(0, 40, 2))]
    rows += [(100 + i, " ".join(base[: 10 + i])) for i in range(30)]
    rows += [(200, "A b c"), (201, "a B C"), (202, "a b"), (203, ""), (204, None), (203, " "), (None, "a b c"), (None, "z"), (5, "only mine"), (205, "only mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = [tuple(r) for r in bayeslsh.near_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)
    assert bayeslsh.near_duplicates(docs.limit(0)).count() == 0


def test_large_groups(spark):
    """Copies with few and many edits of their own, and some that share edits: only these link what is far from the base."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(120), rng.choice([1, 3, 5, 8, 12])):
            w[k : k + 1] = rng.choice([[f"x{i}_{k}"], [], [f"y{k}", base[k]]])
        if i % 3 == 0:
            for k in (5, 30, 60, 90):
                w[k] = f"z{i % 9}_{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_components(rows)
    assert len({r[2] for r in want}) > 5
    assert sorted(tuple(r) for r in bayeslsh.near_duplicates(docs).collect()) == sorted(want)


def test_near_duplicates_keep_columns(spark):
    """Names of inner and result columns in the input, and repeated rows, of which all that are kept stay."""
    names = ["doc_id", "text", "tag", "gone", "own", "row", "component_id", "kept", "n_shingles", "id", "a.b"]
    rows = [(k, t, *["v"] * 9) for k, t in [(1, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (3, None), (None, "q")]]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    got = bayeslsh.deduplicate(docs)
    assert got.columns == names
    assert sorted((r.doc_id or 0, r.text or "", r["a.b"]) for r in got.collect()) == [(0, "q", "v"), (1, "a b c d e f", "v"), (1, "a b c d e f", "v"), (3, "", "v")]


def test_sequential_bound():
    need = bayeslsh.needed_matches(128, 16, 75, 1e-6)
    assert need[16] < need[64] < need[128] < 96


@pytest.fixture(scope="module")
def passed(spark):
    """Input and output of every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF).persist()
        out[name] = (docs.collect(), done.collect())
        if name != "packing":
            assert done.columns == docs.columns
        docs = done
    return out


def test_quality(passed, spark):
    before, after = passed["quality_classifier"]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    seen = [r.doc_id for r in before if r.doc_id in quality]
    assert sum((d in kept) == (quality[d] == 1) for d in seen) >= 0.95 * len(seen)
    assert set(after) <= set(before)


def test_lines(passed):
    before, after = passed["line_dedup"]
    want = {d: t for d, (t, _, n) in brute_lines({r.doc_id: r.text for r in before}).items() if not n or t.split()}
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_near(passed):
    before, after = passed["near_dedup"]
    want = {d for d, _, _, kept in brute_components([(r.doc_id, r.text) for r in before]) if kept}
    assert {r.doc_id for r in after} == want


def test_leaks(passed, spark):
    before, after = passed["benchmark_decontamination"]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        k = min(10, len(w))
        grams |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    sizes = {len(g) for g in grams}
    leaks = lambda w: any(tuple(w[i : i + k]) in grams for k in sizes for i in range(len(w) - k + 1))
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not leaks(words(r.text))}


def test_packed(passed):
    before, after = passed["packing"]
    enc = Encoder(vocabulary())
    n = {r.doc_id: len(enc.ids(r.text)) + 1 for r in before}
    pieces = {}
    for r in after:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    assert {d: [k for _, k in sorted(p)] for d, p in pieces.items()} == {d: packing.piece_lengths(k) for d, k in n.items()}


def test_stages_with_odd_tables(spark):
    """Extra columns with the names of results, nulls and an empty table; every stage keeps the columns."""
    names = "doc_id long, text string, lang string, source string, n_chars long, n_hit string, score string, _score int, n_removed int, kept string, tag string, id string"
    good = "A plain sentence that says a thing or two about rivers. Another one follows it here.\n"
    docs = spark.createDataFrame([(k, t, None, None, None, *[None] * 7) for k, t in [(1, good * 4), (2, good * 4), (3, None), (4, ""), (None, good), (None, None)]], names)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            done = stage(spark, table, SF)
            rows = done.collect()
            assert name == "packing" or (done.columns == docs.columns and len(rows) <= table.count())


def test_run(spark, passed):
    got = corpus_pipeline.run(spark, SF)
    assert got.agg(F.sum("length")).first()[0] == sum(r.length for r in passed["packing"][1])


def test_field_cases(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "good line here\nanother", "a"), (2, "BAD!! ###", "b"), (3, None, "c"), (4, "", "d"), (None, "x", "e"), (2, "BAD!! ###", "b")], "doc_id long, text string, score string")
    got = crf.classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert crf.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in crf.classify(docs, labels.limit(0)).collect()} == {0.5}

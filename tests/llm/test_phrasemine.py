"""Phrase mining against plain counts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from sentrail.llm import phrasemine


def brute(rows, least, top, cover, longest=4):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    frequent = {p: a for p, a in f.items() if a >= least}
    found = []
    for (lang, *w), a in frequent.items():
        if len(w) < 2:
            continue
        cuts = [(2_000_000 * a // (frequent[(lang, *w[:k])] + frequent[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = lambda p: p[0] == lang and len(p) - 1 > len(w) and any(list(p[1 + i : 1 + i + len(w)]) == w for i in range(len(p) - len(w)))  # noqa: B023, E731
        if not any(inside(p) and 100 * b >= cover * a for p, b in frequent.items()):
            found.append((lang, score, a, " ".join(w), frequent[(lang, *w[:k])], frequent[(lang, *w[k:])], n[lang]))
    out = []
    for lang in {x[0] for x in found}:
        mine = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[:top]
        out += [(lang, i + 1, p, a, left, right, n, score) for i, (_, score, a, p, left, right, n) in enumerate(mine)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["a", "B", "é", "漢字", "x-y", "\x00", "of", "the", "A", "\x85", "q\u00a0r"]
    seps = [" "] * 6 + ["  ", "\t ", ". ", "\n", "!", " ,"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice(seps) for _ in range(n))
    rows = [(i, text(rng.choice([0, 1, 4, 30])), rng.choice(["en", "en", "de", None, "und", ""])) for i in range(80)]
    return rows + [(3, "new york city " * 9, "en")] * 3 + [(None, "New York City", "en"), (90, None, "en"), (91, "", None), (92, "long tail " * 9000, "zz"), (93, "w" * 200_000 + " w", "zz")]


@pytest.mark.parametrize(("least", "sample", "slack", "bits", "top"), [(5, 8, 0.5, 27, 2000), (3, 10**9, 1.0, 20, 7), (9, 1, 1.0, 20, 2000), (4, 3, 5.0, 20, 3), (6, 8, 0.5, 8, 2000)])
def test_against_plain(spark, rows, least, sample, slack, bits, top):
    """Samples that see nothing, everything or too little, and a bit table that says yes to all, change nothing."""
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, h int, `c.d` string").repartition(3)
    got = phrasemine.mine(table, least=least, sample=sample, slack=slack, filter_bits=bits, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, top, 80)


def test_failures_lead_to_further_passes(spark, rows, monkeypatch):
    """A sample that proposes nothing has every level found by its border, one pass after another."""
    passes = []
    plain = phrasemine.count
    monkeypatch.setattr(phrasemine, "count", lambda *a, **k: passes.append(a[3:] != ()) or plain(*a, **k))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    phrasemine.mine(docs, least=3, sample=10**9).collect()
    assert passes == [False, False, True, True, True]


def test_exact_past_64_bits(spark):
    """The score's product may pass 64 bits."""
    from pyspark.sql import functions as F

    a, parts = 9_000_000_000_000_000, 19_000_000_000_000_000
    score = spark.range(1).select(F.lit(a).alias("a"), F.lit(parts - a).alias("l"), F.lit(a).alias("r"))
    got = score.select(F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div cast(l + r as decimal(21,0))")).first()[0]
    assert got == 2_000_000 * a // parts


def test_bit_table(spark):
    h = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    table = phrasemine.bit_table(spark.createDataFrame([(int(x),) for x in h], "h long"), 22)
    assert phrasemine._within_filter(table, h.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(0, 2**64, 5000, dtype=np.uint64)
    assert phrasemine._within_filter(table, other).mean() < 0.01


def test_empty(spark):
    for rows in ([], [(1, None, None)], [(1, "a b", "en")]):
        assert phrasemine.mine(spark.createDataFrame(rows, "doc_id long, text string, lang string")).count() == 0

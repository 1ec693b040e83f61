"""The suffix tree: base scores by brute force, a distribution that sums to one, and gains on held-out text."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import plain_suffixtree as plain
import pyarrow as pa

from sentrail.llm import suffixtree as st
from sentrail.sources import shared

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [*re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split(), None]


def base(rows):
    train = [r for r in rows if zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 7 != 2]
    c = Counter(w for r in train for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        w = tokens(t)
        yield i, zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-12, atol=1e-9)


def test_real(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = st.score(docs).collect()
    same([r[:6] for r in got], base([(r.doc_id, r.text) for r in docs.collect()]))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_tables_by_join(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()] + [(3, None), (3, None), (None, "The the"), (70, ""), (71, "zz qq")]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    got = st.score(some, share=5e-3, entry_share=1e-3, table_share=2e-3).collect()
    same([r[:6] for r in got], base(rows))
    assert all(r.score < 0 for r in got)
    assert st.score(some.limit(0)).count() == 0


def test_sums_to_one(spark):
    text = " ".join(["a b c", "a b d", "x y"][k % 3] for k in range(400)) + " once twice"
    docs = spark.createDataFrame([(k, text + f" r{k}") for k in range(20)], "id long, text string")
    tree, counts = plain.train(docs, share=1e-3, entry_share=1e-3)
    assert any(len(level.context) for level in tree.levels[1:])
    words = [np.uint64(r.key & (2**64 - 1)) for r in counts.collect()]
    for before in ["", "a", "a b", "c a b", "x", "r3 a", "zz"]:
        head = st.tokens_of(pa.array([before]))[0][:-1]
        total = 0.0
        for w in words + [None]:
            h = np.uint64(99) if w is None else w
            p = tree.share[tree.symbols(np.array([h]))].copy()
            y = tree.symbols(np.append(head, h))
            first = np.array([0, len(y)])
            for level, (x, has) in zip(tree.levels, plain.contexts(y, first, len(tree.levels)), strict=True):
                p = level.smooth(p, x[-1:], has[-1:], y[-1:], tree.strength)
            c = {int(k): m for k, m in zip(tree.word, tree.word_count, strict=True)}.get(int(h), 0)
            rare = y[-1] == plain.RARE
            total += float(p[0]) * (((c + 1) / (tree.n + tree.v + 1)) / tree.share[plain.RARE] if rare else 1)
        assert abs(total - 1) < 1e-9, (before, total)


def test_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    table = st.Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1)) == np.where(np.isin(keys + np.uint64(1), keys), np.searchsorted(keys, keys + np.uint64(1)), -1)).all()
    assert (st.Table(keys[:0]).find(keys) == -1).all()


def test_tables_match_the_plain_tree(spark):
    """Every word is frequent here, so the plain form has no rare symbol and must give the same scores."""
    rng = np.random.default_rng(5)
    words = ["a", "b", "c", "d", "e", "f"]
    rows = [(k, " ".join("a b c d e f a c e".split()[: 3 + k % 7]) + " " + " ".join(rng.choice(words, 30))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs.where(st.fold_of("doc_id", st.FOLDS) != st.HELD_OUT)
    tree, _ = plain.train(train, share=0, entry_share=0, table_share=0)
    assert all(len(level.context) for level in tree.levels)
    want = dict(zip([r[0] for r in rows], tree.score(*st.tokens_of(pa.array([r[1] for r in rows])))[2], strict=True))
    for how in ({}, {"table_share": 1.0, "hot_share": 1.0}):
        got = {r.doc_id: r.score for r in st.score(docs, **how).collect()}
        assert np.allclose([got[k] for k in want], list(want.values()), rtol=1e-9)


def test_a_passage_is_learned_at_any_size(spark):
    """A passage of three training texts is learned beside 400,000 other tokens as well."""
    passage = " ".join(f"p{k}" for k in range(40))
    held = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 7 == 2][0]
    train = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 7 != 2]
    rng = np.random.default_rng(7)
    rows = [(held, passage)] + [(k, passage) for k in train[:3]] + [(k, " ".join(f"w{x}" for x in rng.integers(0, 50, 2000))) for k in train[3:203]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in st.score(docs).collect()}
    assert got[held].train_tokens > 400_000
    assert got[held].score > got[held].base_score / 2


def test_packed_counts(spark, monkeypatch):
    """Runs are counted alike when they are sent and merged a few at a time, in many partitions; nulls, empty and long texts count."""
    rng = np.random.default_rng(3)
    rows = [None, "", "a", "a b c d", "a b c d"] + [" ".join(rng.choice(["a", "b", "c", "dd", "E"], 300)) for _ in range(20)] + ["hot line of words " * 3000]
    texts = spark.createDataFrame([(r,) for r in rows], "text string").repartition(5)
    want = Counter()
    for r in rows:
        w = [st.END_WORD if x is None else st.tokens_of(pa.array([x.decode()]))[0][0] for x in tokens(r)]
        for size in (2, 3, 4):
            want.update((size, *map(int, w[k : k + size])) for k in range(len(w) - size + 1))
    want = Counter((k[0], k[-1], n) for k, n in want.items() if n >= 3)
    monkeypatch.setattr(st, "PACKED_BYTES", 4000)
    for held in (1 << 20, 50):
        monkeypatch.setattr(st, "HELD", held)
        got = [r for part in range(2) for r in st._run_counts(texts, [2, 3, 4], part, 2, 3, 3 * 20_000).collect()]
        assert len({(r.size, r.g) for r in got}) == len(got)
        assert Counter((r.size, r.y & (2**64 - 1), r.n) for r in got) == want
    assert st._run_counts(texts.limit(0), [2], 0, 1, 1, 0).count() == 0


def test_scores_do_not_depend_on_pieces(spark, monkeypatch):
    """Small pieces, many partitions and clashing further columns change no score; a word that is in a third of all places is no special case."""
    rng = np.random.default_rng(9)
    rows = [(k, " ".join(np.where(rng.random(200) < 0.35, "the", rng.choice(["a", "b", "c", "d"], 200)))) for k in range(60)] + [(60, None), (60, None), (None, "the a"), (61, "the a " * 4000)]
    docs = spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], "doc_id long, text string, row int, w double, found string")
    want = sorted((r.doc_id or -1, r.score) for r in st.score(docs).collect())
    monkeypatch.setattr(st, "PACKED_BYTES", 300_000)
    monkeypatch.setattr(st, "HELD", 200)
    got = sorted((r.doc_id or -1, r.score) for r in st.score(docs, passes=1, hot_share=1.0, table_share=1.0).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-9)


def test_no_table_of_askers(spark, tmp_path, monkeypatch):
    """What tokens ask for is never written as a table, and tables are packed: a few rows for all runs and texts."""
    rng = np.random.default_rng(11)
    rows = [(k, " ".join(rng.choice(["a", "b", "c", "d", "e"], 400))) for k in range(50)]
    seen, plain = {}, st.Scratch.keep

    def keep(self, name, pieces):
        seen[name] = plain(self, name, pieces)
        return seen[name]

    monkeypatch.setattr(st.Scratch, "keep", keep)
    monkeypatch.setattr(st.Scratch, "drop", lambda self, name: None)
    monkeypatch.setattr(st, "written", lambda df, path=None: seen.setdefault(f"w{len(seen)}", shared.written(df, path)))
    assert st.score(spark.createDataFrame(rows, "doc_id long, text string")).count() == 50
    assert not [k for k, df in seen.items() if any(kind.startswith("array") for _, kind in df.dtypes)]
    assert all(seen[k].columns == ["to", "kind", "rows"] and seen[k].count() < 60 for k in ("found", "longer", "pairs", "deep", "weights", "words"))

"""Line alignment against a plain version over all owners, and small cases."""

from collections import Counter, defaultdict

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sentrail.llm import linealign as la

WS = " \t\n\x0b\x0c\r"


def words(line):
    n, inside = 0, False
    for c in line:
        n += c not in WS and not inside
        inside = c not in WS
    return n


def openings(lines, block_words):
    """Shortest runs of lines with so many words, forwards from and backwards to each line that has words."""
    out = set()
    n = [words(x) for x in lines]
    for s in range(len(lines)):
        for e in range(s + 1, len(lines) + 1):
            if sum(n[s:e]) >= block_words and n[s] and n[e - 1] and (sum(n[s : e - 1]) < block_words or sum(n[s + 1 : e]) < block_words):
                out.add(tuple(lines[s:e]))
            if sum(n[s + 1 : e]) >= block_words:
                break
    return out


def brute(docs, rare=la.RARE, long_words=la.LONG_WORDS, block_words=la.BLOCK_WORDS):
    """docs: {id: text}. All documents in order, each against the first holders of its evidence lines and blocks."""
    lines = {d: t.split("\n") for d, t in docs.items() if t is not None}
    where, blocks = defaultdict(set), defaultdict(set)
    for d, ls in lines.items():
        for x in ls:
            where[x].add(d)
        for x in openings(ls, block_words):
            blocks[x].add(d)
    out = {}
    for d, ls in lines.items():
        n, drop = Counter(ls), set()
        owners = {min(where[x]) for x in ls if n[x] == 1 and words(x) and len(where[x]) > 1 and min(where[x]) < d and (len(where[x]) <= rare or words(x) >= long_words)}
        owners |= {min(blocks[x]) for x in openings(ls, block_words) if min(blocks[x]) < d}
        for o in owners:
            drop |= set(la.common_blocks(lines[o], ls, [words(x) for x in ls], block_words))
        out[d] = ("\n".join(x for i, x in enumerate(ls) if i not in drop), len(ls), len(drop))
    return out


def runs(places):
    """Ranges of neighbouring places."""
    out = []
    for k in sorted(places):
        if out and out[-1][1] == k:
            out[-1][1] = k + 1
        else:
            out.append([k, k + 1])
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=16), st.lists(st.integers(0, 6), max_size=16), st.integers(1, 5))
def test_alignment_deletes_what_is_common(a, b, least):
    """Lines are deleted in runs that the partner has, and no run of that length that it has is left."""
    n = [x % 3 for x in b]
    drop = la.common_blocks(a, b, n, least)
    held = lambda x: any(a[i : i + len(x)] == x for i in range(len(a) - len(x) + 1))
    for k in drop:
        assert any(held(b[s:e]) and sum(n[s:e]) >= least for s in range(k + 1) for e in range(k + 1, len(b) + 1) if set(range(s, e)) <= set(drop))
    for s, e in runs(set(range(len(b))) - set(drop)):
        assert not any(held(b[i:j]) and sum(n[i:j]) >= least for i in range(s, e) for j in range(i + 1, e + 1))


def test_nothing_but_alignment_deletes(spark, monkeypatch):
    """Evidence alone deletes no line."""
    a = "\n".join(f"w{k} x y z u v w" for k in range(9))
    docs = spark.createDataFrame([(1, a), (2, f"own\n{a}")], "doc_id long, text string")
    assert [r.n_removed for r in la.dedup_lines(docs).orderBy("doc_id").collect()] == [0, 9]
    pairs = la.block_partners(docs.select(la.F.col("doc_id").alias("id"), la.F.lit(0).cast("long").alias("tag"), la.F.array(la.F.lit(5).cast("long"), la.F.col("doc_id")).alias("h"), la.F.array(la.F.lit(20), la.F.lit(0)).alias("w")), 20)
    assert [tuple(r) for r in pairs.collect()] == [(2, 0, 1, 0)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_patience_is_an_alignment(a, b):
    got = la.patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
    if a == b:
        assert got == [(i, i) for i in range(len(a))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n", max_size=12)), max_size=6))
def test_line_hashes(texts):
    h, n, first = la.line_hashes(pa.array(texts, pa.string()))
    seen = {}
    for r, t in enumerate(texts):
        mine = list(zip(h[first[r] : first[r + 1]].tolist(), n[first[r] : first[r + 1]].tolist(), strict=True))
        want = t.split("\n") if t is not None else []
        assert [k for _, k in mine] == [words(x) for x in want]
        for (x, _), line in zip(mine, want, strict=True):
            assert seen.setdefault(line, x) == x
    assert len(set(seen.values())) == len(seen)


def test_real(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in la.dedup_lines(docs).collect()}
    assert got == want
    assert any(n for _, _, n in want.values())


def test_cases(spark):
    a, b = "one two three four five six seven eight nine ten eleven\n" * 1 + "x y z " * 5, "own line of b\n"
    rows = [(1, a, "u"), (2, b + a, "v"), (3, "", None), (4, None, "w"), (None, a, "n"), (2, b + a, "v"), (2, "other", "v"), (9, a, "z"), (5, "\n\n", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    got = sorted((r.doc_id or -1, r.text if r.text is not None else "NULL", r.tag or "", r.n_lines, r.n_removed) for r in la.dedup_lines(docs, rare=2).collect())
    assert got == sorted([(1, a, "u", 2, 0), (2, "own line of b", "v", 3, 2), (3, "", "", 1, 0), (4, "NULL", "w", 0, 0), (-1, a, "n", 2, 0), (2, "own line of b", "v", 3, 2), (2, "other", "v", 1, 0), (9, "", "z", 2, 2), (5, "\n\n", "q", 3, 0)])
    assert la.dedup_lines(docs.limit(0)).count() == 0


def exact(docs, block_words=la.BLOCK_WORDS):
    """Places of the lines in runs of at least block_words words that an earlier document has too."""
    lines = {d: t.split("\n") for d, t in docs.items()}
    out = {}
    for d, ls in lines.items():
        drop = set()
        for e in (x for x in lines if x < d):
            for i in range(len(ls)):
                for k in range(len(lines[e])):
                    n = 0
                    while i + n < len(ls) and k + n < len(lines[e]) and ls[i + n] == lines[e][k + n]:
                        n += 1
                    run = ls[i : i + n]
                    # Blank lines at the ends belong to no block of their own.
                    while run and not words(run[-1]):
                        run.pop()
                    if run and words(run[0]) and sum(map(words, run)) >= block_words:
                        drop |= set(range(i, i + len(run)))
        out[d] = drop
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["", "a", "b c", "d e f"]), max_size=9), min_size=1, max_size=4))
def test_blocks_cover_common_runs(rows):
    """Blocks against brute force over all earlier documents."""
    docs = {k: "\n".join(r) for k, r in enumerate(rows)}
    h, w, first = la.line_hashes(pa.array(list(docs.values()), pa.string()))
    run, a, b, row = la.line_blocks(h, w, first, 4)
    got = {k: set() for k in docs}
    for x, i, j, r in zip(run, a, b, row, strict=True):
        if any(y == x and q < r for y, q in zip(run, row, strict=True)):
            got[int(r)] |= set(range(int(i - first[r]), int(j - first[r])))
    assert got == exact(docs, 4)


def test_blocks_at_any_frequency(spark):
    """Short lines in more than ``rare`` documents, and a block that the later document holds twice."""
    verse = "\n".join(f"short line {k}" for k in range(8))
    rows = [(k, f"own {k}\n{verse}\nend {k}") for k in range(25)] + [(30, f"{verse}\nbetween\n{verse}")]
    got = {r.doc_id: (r.text, r.n_removed) for r in la.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (rows[0][1], 0)} | {k: (f"own {k}\nend {k}", 8) for k in range(1, 25)} | {30: ("between", 16)}


def test_a_block_with_lines_of_other_owners(spark):
    """Both lines of a block stand first in documents that don't have the block."""
    x, y = "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 x12", "y1 y2 y3 y4 y5 y6 y7 y8 y9 y10 y11 y12"
    rows = [(1, f"one\n{x}\nuno"), (2, f"two\n{y}\ndue"), (3, f"three\n{x}\n{y}\ntre"), (4, f"four\n{x}\n{y}\nquattro")]
    got = {r.doc_id: (r.text, r.n_removed) for r in la.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (t, 0) for k, t in rows[:3]} | {4: ("four\nquattro", 2)}


def test_names_and_long_texts(spark):
    names = ["doc_id", "text", "_tag", "_drop", "id", "tag", "h", "n_removed", "a.b"]
    long = "\n".join(f"line {k} of a long text" for k in range(30_000))
    docs = spark.createDataFrame([(k, long, *["v"] * 7) for k in (1, 2)], ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    got = la.dedup_lines(docs)
    assert got.columns == [c for c in names if c != "n_removed"] + ["n_lines", "n_removed"]
    assert sorted((r.doc_id, len(r.text), r.n_removed, r["_tag"], r["a.b"]) for r in got.collect()) == [(1, len(long), 0, "v", "v"), (2, 0, 30_000, "v", "v")]

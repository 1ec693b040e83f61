"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over all training words.

The n-grams of the benchmark are hashed into a sorted array and a bitmap; every window of every document is
looked up in the bitmap, then in the array, and a hit counts only if its words equal the item's words. The
benchmark is broadcast in blocks of at most ``block_windows`` windows (or one item, if that is longer), one pass over
the documents for each, so what is broadcast never grows past that bound. The result of a pass is written before the
next one, so a task holds one block. Documents are not shuffled.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField

from sentrail.llm._text import ALNUM, map_rows, numbered, Words, written

WINDOW = 10
BLOCK_WINDOWS = 1_000_000


class _Index:
    """Windows of some items: hashes in order, their words, and the items they come from."""

    def __init__(self, texts: list[str], ids: list, size: int):
        words = Words(pa.array(texts, pa.string()), ALNUM, lower=True)
        h = words.hashes()
        found: dict[tuple[int, bytes], set[int]] = defaultdict(set)
        hashed: dict[tuple[int, bytes], int] = {}
        n = words.counts
        for length in sorted({min(size, int(k)) for k in n if k}):
            at, w = words.windows(h, length)
            rows = np.searchsorted(words.first, at, side="right") - 1
            for a, x, r in zip(at, w, rows, strict=True):
                if min(size, n[r]) == length:
                    key = (length, words.joined(a, a + length))
                    found[key].add(int(r))
                    hashed[key] = int(x)
        self.ids = [str(x) for x in ids]
        self.by_length = {}
        for length in sorted({k[0] for k in found}):
            keys = sorted((hashed[k], k[1]) for k in found if k[0] == length)
            hs = np.array([k[0] for k in keys], dtype=np.uint64)
            bits = np.zeros(1 << 22, dtype=bool)
            bits[(hs >> np.uint64(42)).astype(np.int64)] = True
            items = [np.array(sorted(found[(length, k[1])]), dtype=np.int32) for k in keys]
            self.by_length[length] = (bits, hs, [k[1] for k in keys], items)

    def scan(self, words: Words) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
        """Start and length of every verified hit in a chunk, all lengths together, and the items of each row.

        Items are looked up once for each row and window, however often it occurs there.
        """
        h = words.hashes()
        out, seen, found = [], set(), defaultdict(set)
        for length, (bits, hs, keys, items) in self.by_length.items():
            at, w = words.windows(h, length)
            maybe = bits[(w >> np.uint64(42)).astype(np.int64)]
            at, w = at[maybe], w[maybe]
            rows = np.searchsorted(words.first, at, side="right") - 1
            for a, x, r, k in zip(at, w, rows, np.searchsorted(hs, w), strict=True):
                got = None
                while k < len(hs) and hs[k] == x:
                    got = got or words.joined(a, a + length)
                    if keys[k] == got:
                        out.append((a, length))
                        if (r, length, k) not in seen:
                            seen.add((r, length, k))
                            found[int(r)].update(self.ids[i] for i in items[k])
                    k += 1
        at, length = (np.array(x, dtype=np.int64) for x in (zip(*out, strict=True) if out else ([], [])))
        return at, length, found


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_windows: int):
    """Number of blocks, and their items; a block has about ``block_windows`` words at most, so as many windows."""
    item = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
    total = item.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (2 * block_windows)))  # a word takes two bytes at least, with its separator
    part = lambda k: item if n == 1 else item.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
    return n, (sorted((r["id"] or "", r["text"]) for r in part(k).collect()) for k in range(n))


class _Pass:
    """One pass over a chunk of documents with one block of the benchmark; the last pass makes the result."""

    def __init__(self, index, text: str, carried: bool, last: bool):
        self.index, self.text, self.carried, self.last = index, text, carried, last

    def __call__(self, part: pa.RecordBatch) -> list[pa.Array]:
        words = Words(part.column(part.schema.get_field_index(self.text)), ALNUM, lower=True)
        first, rows = words.first, part.num_rows
        index = self.index.value
        at, length, items = index.scan(words)
        step = np.zeros(len(words.s) + 1, dtype=np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + length, -1)
        hit = np.cumsum(step)[:-1] > 0
        if self.carried:
            for r, (was, ids) in enumerate(zip(part.column("_hit").to_pylist(), part.column("_items").to_pylist(), strict=True)):
                if ids:
                    hit[first[r] : first[r + 1]] |= np.unpackbits(np.frombuffer(was, np.uint8), count=first[r + 1] - first[r]).astype(bool)
                    items[r] |= set(ids)
        if not self.last:
            bits = [np.packbits(hit[first[r] : first[r + 1]]).tobytes() if r in items else b"" for r in range(rows)]
            return [pa.array(bits, pa.binary()), pa.array([sorted(items[r]) if r in items else [] for r in range(rows)], pa.list_(pa.string()))]
        total = np.concatenate([[0], np.cumsum(hit)])
        n_hit = total[first[1:]] - total[first[:-1]]
        n_items = np.array([len(items.get(r, ())) for r in range(rows)], dtype=np.int64)
        none = hashlib.sha256(b"").hexdigest()
        digest = [hashlib.sha256(",".join(sorted(items[r])).encode()).hexdigest() if r in items else none for r in range(rows)]
        spans = [_spans(words, hit, r) if r in items else [] for r in range(rows)]
        return [pa.array(words.counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array(n_hit > 0), pa.array(spans, pa.list_(pa.list_(pa.int64())))]


def _spans(words: Words, hit: np.ndarray, row: int) -> list[list[int]]:
    """First byte and end byte, in its row, of every run of hit words."""
    a, b = words.first[row], words.first[row + 1]
    flag = np.concatenate([[0], hit[a:b].astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(flag))
    o = words.offs[row]
    return [[int(words.s[a + i] - o), int(words.e[a + j - 1] - o)] for i, j in zip(edges[::2], edges[1::2], strict=True)]


FIELDS = [
    StructField("n_words", LongType()),
    StructField("n_hit", LongType()),
    StructField("n_items", LongType()),
    StructField("items_sha256", StringType()),
    StructField("contaminated", BooleanType()),
    StructField("hit_spans", ArrayType(ArrayType(LongType()))),
]
_CARRIED = [StructField("_hit", BinaryType()), StructField("_items", ArrayType(StringType()))]


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    keep: list[str],
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Marks the words of every document that lie in an occurrence of a benchmark window.

    Returns the columns ``keep``, then n_words, n_hit, n_items, items_sha256, contaminated and ``hit_spans``
    (pairs of first byte and end byte in the UTF-8 text, merged and in order).

    A null or wordless text has no words and no hits. Items with a null text or without words have no windows; an
    item with a null id counts under the empty string. Repeated rows are judged one by one. An empty benchmark
    contaminates nothing; empty documents give an empty table. Columns outside ``keep`` are not read; those in it
    must not have the names of the results (``remove_spans`` and ``drop_documents`` take any names).
    """
    spark = docs.sparkSession
    df = docs
    n, blocks = _blocks(benchmark, item_id, item_text, block_windows)
    for k, rows in enumerate(blocks):
        index = spark.sparkContext.broadcast(_Index([t for _, t in rows], [i for i, _ in rows], size))
        last = k == n - 1
        kept = keep if last or text in keep else [*keep, text]
        df = map_rows(df, _Pass(index, text, k > 0, last), FIELDS if last else _CARRIED, kept, text, also=[f.name for f in _CARRIED] if k else [])
        if not last:
            df = written(df)
    return df


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **how) -> DataFrame:
    """The documents with every hit span cut out of the text; other columns, of any name, stay. Nulls stay null.

    The spans are bytes of the UTF-8 text, so they are cut from its binary form.
    """
    names, (docs, (text,)) = docs.columns, numbered(docs, text)
    found = find_hits(docs, benchmark, keep=docs.columns, text=text, **how)
    raw = F.encode(F.col(text), "UTF-8")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("hit_spans", lambda s: s[1]))
    starts = F.concat(F.transform("hit_spans", lambda s: s[0]), F.array(F.octet_length(text).cast("long")))
    pieces = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda s: F.decode(F.substring(raw, s["a"].cast("int") + 1, (s["b"] - s["a"]).cast("int")), "UTF-8"))
    cut = F.when(F.col("contaminated"), F.array_join(pieces, "")).otherwise(F.col(text))
    return found.select(*[cut.alias(c) if c == text else F.col(c) for c in docs.columns]).toDF(*names)


def drop_documents(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **how) -> DataFrame:
    """The documents without any hit, with all their columns, of any name."""
    rows, (text,) = numbered(docs, text)
    return find_hits(rows, benchmark, keep=rows.columns, text=text, **how).where(~F.col("contaminated")).select(*rows.columns).toDF(*docs.columns)

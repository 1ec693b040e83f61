"""Line deduplication by pairwise alignment.

A later document is aligned with earlier ones that it shares evidence with. Evidence are lines that occur once in it and
are rare (in at most ``rare`` documents) or long (at least ``long_words`` words, at any frequency), and blocks: the
shortest runs of lines of ``block_words`` words, at any frequency. The partner is the first document that has the line
or the block. That is a star around the first, so a group of n copies gives n pairs.

The line hashes of a pair are aligned with patience diff, and aligned runs of at least ``block_words`` words are deleted
from the later document. What is left between them is aligned again, as moved and repeated passages do not fit one
alignment; where no line is unique, runs are anchored by their first ``block_words`` words instead. Only aligned runs
are deleted, and the first document that has a passage keeps it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from sentrail.llm._text import buffers, _BYTE, _BYTE_POWERS, map_rows, mix, NOT_SPACE, numbered, tidily, written

RARE, LONG_WORDS, BLOCK_WORDS = 20, 8, 20


def line_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and word counts of all \\n-separated lines of a chunk, and the first line of each row (nulls have none)."""
    data, offs = buffers(col)
    cut = np.flatnonzero(data == 10)
    row_of_cut = np.searchsorted(offs, cut, side="right") - 1
    live = np.array(col.is_valid())
    rows = np.arange(len(col))[live]
    s = np.concatenate([offs[:-1][live], cut + 1])
    e_row = np.concatenate([rows, row_of_cut])
    order = np.lexsort((s, e_row))
    s, e_row = s[order], e_row[order]
    nxt = np.append(s[1:] - 1, len(data))
    last = np.append(e_row[1:] != e_row[:-1], True)[: len(s)]
    e = np.where(last, offs[e_row + 1], nxt[: len(s)])
    up, down = _BYTE_POWERS.get(len(data) + 1)
    with np.errstate(over="ignore"):
        c = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=c[1:])
        h = mix((c[e] - c[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    w = NOT_SPACE[data]
    begin = w.copy()
    begin[1:] &= ~w[:-1]
    edge = offs[:-1][(offs[:-1] < len(data)) & (np.diff(offs) > 0)]
    begin[edge] = w[edge]
    starts = np.flatnonzero(begin)
    words = np.searchsorted(starts, e) - np.searchsorted(starts, s)
    return h.view(np.int64), words, np.searchsorted(e_row, np.arange(len(col) + 1))


def _anchors(a, b, a0, a1, b0, b1) -> list[tuple[int, int]]:
    """Longest increasing run of lines that occur once in either range."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    at = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
    pairs = [(i, at[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in at]
    tops, ends, back = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back[k] = ends[p - 1] if p else -1
        if p == len(tops):
            tops.append(j)
            ends.append(k)
        else:
            tops[p], ends[p] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: pairs of places of equal lines, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        found = _anchors(a, b, a0, a1, b0, b1)
        i, j = a0, b0
        for x, y in found:
            todo.append((i, x, j, y))
            out.append((x, y))
            i, j = x + 1, y + 1
        if found:
            todo.append((i, a1, j, b1))
    return sorted(out)


def long_runs(pairs: list[tuple[int, int]], words: list[int], block_words: int) -> list[tuple[int, int]]:
    """Ranges of the second sequence that aligned pairs cover without a gap in either, of ``block_words`` words at least."""
    out, begin = [], 0
    for k in range(1, len(pairs) + 1):
        if k == len(pairs) or pairs[k] != (pairs[k - 1][0] + 1, pairs[k - 1][1] + 1):
            s, e = pairs[begin][1], pairs[k - 1][1] + 1
            if sum(words[s:e]) >= block_words:
                out.append((s, e))
            begin = k
    return out


def openings(lines: list[int], words: list[int | None], block_words: int) -> list[tuple[tuple, int]]:
    """The first ``block_words`` words from every line on, as a run of lines, with its place; lines of unknown words are in none."""
    out, e, total = [], 0, 0
    for s in range(len(lines)):
        if e < s:
            e, total = s, 0
        while e < len(lines) and total < block_words and words[e] is not None:
            total += words[e]
            e += 1
        if total >= block_words:
            out.append((tuple(lines[s:e]), s))
        if e > s:
            total -= words[s]
    return out


def anchored(a: list[int], in_a: dict[tuple, int], b: list[int], words: list[int], block_words: int) -> list[tuple[int, int]]:
    """Ranges of ``b`` that runs of ``a`` match from a common opening on (``in_a``: those of ``a``), as far as both go on alike."""
    out, at = [], 0
    for opening, j in openings(b, words, block_words):
        if j >= at and opening in in_a:
            i, e = in_a[opening] + len(opening), j + len(opening)
            while i < len(a) and e < len(b) and a[i] == b[e]:
                i, e = i + 1, e + 1
            out.append((j, e))
            at = e
    return out


def common_blocks(a: list[int], b: list[int], words: list[int], block_words: int) -> list[int]:
    """Places in ``b`` of the lines of aligned runs of at least ``block_words`` words."""
    out, todo, in_a = [], [(0, len(b))], None
    while todo:
        s, e = todo.pop()
        part, of = b[s:e], words[s:e]
        found = long_runs(patience(a, part), of, block_words)
        if not found:
            if in_a is None:
                known = dict(zip(b, words, strict=True))
                in_a = dict(reversed(openings(a, [known.get(x) for x in a], block_words)))
            found = anchored(a, in_a, part, of, block_words)
        rest = [0, *(x for r in found for x in r), e - s] if found else []
        out += [s + k for x, y in found for k in range(x, y)]
        todo += [(s + x, s + y) for x, y in zip(rest[::2], rest[1::2], strict=True) if sum(of[x:y]) >= block_words]
    return sorted(out)


def line_blocks(h: np.ndarray, words: np.ndarray, first: np.ndarray, block_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shortest runs of lines of one row with ``block_words`` words: hash, first line, line after the last, row.

    They are taken from every line forwards and from every line backwards; both ends have words.
    """
    n = len(h)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    c = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    at = np.flatnonzero(words > 0)
    # Least end with c[end] - c[start] >= block_words, and greatest start with the same.
    ends = np.searchsorted(c, c[at] + block_words)
    starts = np.searchsorted(c, c[at + 1] - block_words, side="right") - 1
    a, b = np.concatenate([at, starts]), np.concatenate([ends, at + 1])
    owner = np.concatenate([row[at], row[at]])
    ok = (a >= first[owner]) & (b <= first[owner + 1]) & (b <= n)
    a, b, owner = a[ok], b[ok], owner[ok]
    if len(a):
        a, b, owner = np.unique(np.stack([a, b, owner]), axis=1)
    up, down = _BYTE_POWERS.get(n + 1)
    with np.errstate(over="ignore"):
        x = np.concatenate([[np.uint64(0)], np.cumsum(h.view(np.uint64) * up[:n], dtype=np.uint64)]).astype(np.uint64)
        run = mix((x[b] - x[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return run.view(np.int64), a, b, owner


def block_partners(table: DataFrame, block_words: int) -> DataFrame:
    """(id, tag, id_a, tag_a): documents and the first holders of their blocks. ``table``: id, tag, h, w (line hashes, words)."""

    def blocks(batches):
        for batch in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            h, w = batch.column(2), batch.column(3)
            first = np.concatenate([[0], np.cumsum(np.array(h.value_lengths().fill_null(0)))]).astype(np.int64)
            run, _, _, row = line_blocks(np.array(h.flatten()), np.array(w.flatten()), first, block_words)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(run)], names=["id", "tag", "b"])

    kind = table.schema["id"].dataType.simpleString()
    block = table.select("id", "tag", "h", "w").mapInArrow(tidily(blocks), f"id {kind}, tag long, b long")
    owner = block.groupBy("b").agg(F.min(F.struct("id", "tag")).alias("owner"), F.max("id").alias("last")).where("owner.id < last").select("b", "owner")
    later = block.join(written(owner), "b").where(F.col("owner.id") < F.col("id"))  # of two tables, so that Spark splits a hot block
    return later.select("id", "tag", F.col("owner.id").alias("id_a"), F.col("owner.tag").alias("tag_a")).distinct()


def find_deletions(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", rare: int = RARE, long_words: int = LONG_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Lines to delete: doc_id, tag (hash of the text), drop (places of lines, in order)."""
    source = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("tag"), F.col(text).alias("text")).where("id is not null and text is not null")

    def lines(part):
        h, words, first = line_hashes(part.column(part.schema.get_field_index("text")))
        offs = pa.array(first, pa.int32())
        return [pa.ListArray.from_arrays(offs, pa.array(h)), pa.ListArray.from_arrays(offs, pa.array(words, pa.int32()))]

    fields = [StructField("h", ArrayType(LongType())), StructField("w", ArrayType(IntegerType()))]
    table = written(map_rows(source, lines, fields, ["id", "tag"]).dropDuplicates(["id", "tag"]))
    line = table.select("id", "tag", F.explode(F.arrays_zip("h", "w")).alias("x")).groupBy("id", "tag", F.col("x.h").alias("h"), F.col("x.w").alias("w")).count()
    line = line.where("w > 0")
    owner = written(line.groupBy("h").agg(F.min(F.struct("id", "tag")).alias("owner"), F.count("*").alias("df")).where("df > 1"))
    mine = line.where("count = 1").join(owner, "h").where((F.col("owner.id") < F.col("id")) & ((F.col("df") <= rare) | (F.col("w") >= long_words)))
    by_line = mine.select("id", "tag", F.col("owner.id").alias("id_a"), F.col("owner.tag").alias("tag_a"))
    pairs = written(by_line.unionByName(block_partners(table, block_words)).distinct())
    joined = pairs.join(table, ["id", "tag"]).join(table.select(F.col("id").alias("id_a"), F.col("tag").alias("tag_a"), F.col("h").alias("h_a")), ["id_a", "tag_a"])

    def align(batches):
        for batch in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            h, w, a = (batch.column(i).to_pylist() for i in (2, 3, 4))
            drop = [common_blocks(x, y, z, block_words) for x, y, z in zip(a, h, w, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(drop, pa.list_(pa.int32()))], names=["id", "tag", "drop"])

    kind = source.schema["id"].dataType.simpleString()
    found = joined.select("id", "tag", "h", "w", "h_a").mapInArrow(tidily(align), f"id {kind}, tag long, drop array<int>").where("size(drop) > 0")
    return found.groupBy("id", "tag").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("drop")))).alias("drop"))


def dedup_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The documents with aligned common blocks deleted from ``text``, and n_lines, n_removed for each row.

    Lines are separated by \\n and compared byte by byte through 64-bit hashes; blank lines are aligned but are no
    evidence. A null text stays null with n_lines 0; a document that loses all its lines keeps an empty text. Rows
    with a null id are kept as they are and compared with nothing. Rows that share an id are not compared with each
    other, and each is judged by its own text. A column named n_lines or n_removed in the input is replaced; others may
    have any name.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs, (text, doc_id) = numbered(docs.select(*[F.col(f"`{c}`") for c in names]), text, doc_id)
    drop = find_deletions(docs, text=text, doc_id=doc_id, **how)
    keep = [c for c in docs.columns if c != text]
    mine = docs.select(*keep, F.col(text).alias("_text"), F.xxhash64(text).alias("_tag"))
    joined = mine.join(drop.select(F.col("id").alias("_id"), F.col("tag").alias("_tag2"), F.col("drop").alias("_drop")), (F.col(doc_id) == F.col("_id")) & (F.col("_tag") == F.col("_tag2")), "left")

    def cut(part):
        texts, drops = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("_text", "_drop"))
        out, n, gone = [], [], []
        for t, d in zip(texts, drops, strict=True):
            if d:
                at, lines = set(d), t.split("\n")
                n.append(len(lines))
                t = "\n".join(x for i, x in enumerate(lines) if i not in at)
            else:
                n.append(t.count("\n") + 1 if t is not None else 0)
            out.append(t)
            gone.append(len(d or ()))
        return [pa.array(out, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())]

    fields = [StructField(text, StringType()), StructField("n_lines", LongType()), StructField("n_removed", LongType())]
    done = map_rows(joined, cut, fields, keep, "_text", also=["_drop"])
    return done.select(*docs.columns, "n_lines", "n_removed").toDF(*names, "n_lines", "n_removed")

"""Repeated word windows by super-k-mer partitioning.

A window is ``size`` consecutive words of a document; its minimiser is the smallest hash of its runs of ``m`` words.
Consecutive windows with one minimiser make up a super-k-mer, which travels to its minimiser's bucket as one packed
string. Equal windows have equal minimisers, so each bucket can be counted by itself, by sorting its windows.

What must travel is cut down first, without losing a window: minimisers that occur in one document only have no
shared window; equal super-k-mers are merged into their first document before the shuffle (so thousands of copies
are one string); a bucket with a single distinct string needs no sorting. Buckets of more than ``hot`` distinct
strings, such as the borders of a passage that a third of all documents quote, are split: their windows travel one by
one as text and are sorted and counted by their words in many tasks, with partial minimums before the shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from sentrail.llm._text import chunks, map_rows, mix, NOT_SPACE, numbered, tidily, Words, written

SIZE, M, HOT = 50, 8, 50_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - span : width - span + len(x) - width + 1])


def super_kmers(words: Words, size: int, m: int) -> tuple[np.ndarray, ...]:
    """Row, minimiser, hash of the words, first word and number of windows of every super-k-mer of a chunk."""
    none = np.zeros(0, dtype=np.int64)
    h = words.hashes()
    at, whole = words.windows(h, size)
    if not len(at):
        return none, none, none, none, none
    every = np.full(len(h), np.iinfo(np.uint64).max, dtype=np.uint64)
    place, gram = words.windows(h, m)
    every[place] = gram
    low = _sliding_min(every, size - m + 1)[at]
    row = np.searchsorted(words.first, at, side="right") - 1
    new = np.ones(len(at), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    a = np.flatnonzero(new)
    k = np.diff(np.append(a, len(at)))
    with np.errstate(over="ignore"):
        order = np.arange(len(at), dtype=np.uint64) - np.repeat(a, k).astype(np.uint64)
        string = mix(np.add.reduceat(mix(whole + order * np.uint64(0x9E3779B97F4A7C15)), a) + k.astype(np.uint64))
    return row[a], low[a].view(np.int64), string.view(np.int64), at[a] - words.first[row[a]], k


def _cut(size: int, m: int):
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                row, v, s, a, k = super_kmers(Words(part.column(2), NOT_SPACE), size, m)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(v), pa.array(s), pa.array(a, pa.int32()), pa.array(k, pa.int32())], names=["id", "tag", "v", "s", "a", "k"])

    return run


def _pack(size: int):
    """Packed strings of the super-k-mers that a document stands for."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column(1), NOT_SPACE)
                out = []
                for r, (i, need) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    for x in need or ():
                        b = words.first[r] + x["a"]
                        out.append((x["v"], x["s"], i, words.joined(b, b + x["k"] + size - 1), x["hot"]))
                cols = list(zip(*out, strict=True)) if out else [()] * 5
                kinds = (pa.int64(), pa.int64(), part.schema.field(0).type, pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["v", "s", "first", "packed", "hot"])

    return run


def _later_windows(v: np.ndarray, first: list, packed: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the windows of some whole buckets: (string, offset) of those that a smaller document has too."""
    words = Words(packed, NOT_SPACE)
    at, w = words.windows(words.hashes(), size)
    row = np.searchsorted(words.first, at, side="right") - 1
    rank = {x: i for i, x in enumerate(sorted(set(first)))}
    doc = np.array([rank[x] for x in first])[row]
    with np.errstate(over="ignore"):
        key = w + mix(v.view(np.uint64))[row]
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(key))
    out = []
    several = doc[end - 1] > doc[start] if len(start) else np.zeros(0, bool)
    for a, b in zip(start[several], end[several], strict=True):
        least: dict[bytes, int] = {}
        for i in range(a, b):  # in order of documents
            x = at[order[i]]
            text = words.data[words.s[x] : words.e[x + size - 1]].tobytes()
            if least.setdefault(text, doc[i]) < doc[i]:
                out.append(order[i])
    out = np.array(sorted(out), dtype=np.int64)
    return row[out], at[out] - words.first[row[out]]


def _sort_buckets(size: int):
    """Buckets come sorted by minimiser; complete ones of a batch are counted together."""
    names = ["v", "s", "dead"]

    def counted(table: pa.Table):
        v, s = (table.column(i).combine_chunks().to_numpy() for i in (0, 1))
        row, off = _later_windows(v, table.column(2).to_pylist(), table.column(3).combine_chunks(), size)
        rows, start = np.unique(row, return_index=True)
        offs = pa.array(np.append(start, len(off)), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(v[rows]), pa.array(s[rows]), pa.ListArray.from_arrays(offs, pa.array(off, pa.int32()))], names=names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for part in chunks(batch, "packed"):
                v = part.column(0).to_numpy()
                last = int(np.searchsorted(v, v[-1]))
                if last or (held and held[-1].column(0)[-1].as_py() != v[0]):
                    if last == 0:
                        yield counted(pa.Table.from_batches(held))
                        held = [part]
                    else:
                        yield counted(pa.Table.from_batches([*held, part.slice(0, last)]))
                        held = [part.slice(last)]
                else:
                    held.append(part)
        if held:
            yield counted(pa.Table.from_batches(held))

    return run


def _single_windows(size: int):
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "packed"):
                words = Words(part.column(3), NOT_SPACE)
                at, _ = words.windows(words.hashes(), size)
                row = np.searchsorted(words.first, at, side="right") - 1
                for k in range(0, len(at), 4096):
                    a, r = at[k : k + 4096], row[k : k + 4096]
                    w = [words.joined(x, x + size) for x in a]
                    yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(r)) for i in (0, 1, 2)), pa.array(w, pa.binary()), pa.array(a - words.first[r], pa.int32())], names=["v", "s", "first", "w", "off"])

    return run


def _covered(n: int, runs: list, size: int) -> np.ndarray:
    step = np.zeros(n + 1, dtype=np.int64)
    for x in runs:
        if x["dead"] is None:
            step[x["a"]] += 1
            step[x["a"] + x["k"] + size - 1] -= 1
        else:
            for d in x["dead"]:
                step[x["a"] + d] += 1
                step[x["a"] + d + size] -= 1
    return np.cumsum(step)[:-1] > 0


def _remove(size: int):
    def run(part):
        runs = part.column(part.schema.get_field_index("runs")).to_pylist()
        texts = part.column(part.schema.get_field_index("text")).to_pylist()
        kept, gone = [], []
        for t, r in zip(texts, runs, strict=True):
            words = (t or "").encode().split()
            if r:
                cover = _covered(len(words), r, size)
                gone.append(int(cover.sum()))
                words = [w for w, c in zip(words, cover, strict=True) if not c]
            else:
                gone.append(0)
            kept.append(b" ".join(words).decode())
        return [pa.array(gone, pa.int64()), pa.array(kept, pa.string())]

    return run


def repeated_windows(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, m: int = M, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Finds the windows that also start in a document with a smaller id.

    Returns two tables: runs of such windows (id, tag, runs of first window a, number k, and, if not all of them,
    their offsets ``dead``), where tag is a hash of the text; and the texts (id, tag, text) of all documents that
    share a minimiser with another, of which those with runs are a part.
    """
    if not 0 < m <= size:
        raise ValueError("a minimiser must fit into a window")
    source = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("tag"), F.col(text).alias("text")).where("id is not null")
    kind = source.schema["id"].dataType.simpleString()
    cut = source.mapInArrow(tidily(_cut(size, m)), f"id {kind}, tag long, v long, s long, a int, k int")
    shared = cut.groupBy("v").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("v")
    part = written(cut.join(shared, "v"))

    strings = part.groupBy("v", "s").agg(F.min(F.struct("id", "tag", "a", "k")).alias("f"))
    bucket = strings.groupBy("v").agg(F.count("*").alias("n"), F.min("f.id").alias("low"), F.max("f.id").alias("high")).where("low < high").select("v", (F.col("n") > hot).alias("hot"))
    stands = strings.join(bucket, "v").groupBy(F.col("f.id").alias("id"), F.col("f.tag").alias("tag")).agg(F.collect_list(F.struct("v", "s", "f.a", "f.k", "hot")).alias("need"))
    involved = part.select("id", "tag").distinct().join(stands, ["id", "tag"], "left")
    texts = written(source.join(involved, ["id", "tag"]).dropDuplicates(["id", "tag"]))

    packed = written(texts.where("need is not null").select("id", "text", "need").mapInArrow(tidily(_pack(size)), f"v long, s long, first {kind}, packed binary, hot boolean"))
    dead = packed.where("not hot").repartition("v").sortWithinPartitions("v").mapInArrow(tidily(_sort_buckets(size)), "v long, s long, dead array<int>")
    single = packed.where("hot").mapInArrow(tidily(_single_windows(size)), f"v long, s long, first {kind}, w binary, off int")
    least = single.groupBy("v", "w").agg(F.min("first").alias("low"))
    split = single.join(least, ["v", "w"]).where("low < first").groupBy("v", "s").agg(F.array_sort(F.collect_set("off")).alias("dead"))
    dead = written(dead.unionByName(split))

    first = strings.select("v", "s", F.col("f.id").alias("first"))
    judged = part.join(first, ["v", "s"]).join(dead, ["v", "s"], "left").where("id > first or dead is not null")
    run = F.struct("a", "k", F.when(F.col("id") > F.col("first"), F.lit(None)).otherwise(F.col("dead")).alias("dead"))
    return judged.groupBy("id", "tag").agg(F.collect_list(run).alias("runs")), texts.select("id", "tag", "text")


def changed_texts(docs: DataFrame, *, size: int = SIZE, **how) -> DataFrame:
    """(id, tag, n_removed, kept) of the texts that lose words; ``kept`` is what is left, joined by one space."""
    runs, texts = repeated_windows(docs, size=size, **how)
    return map_rows(texts.join(runs, ["id", "tag"]), _remove(size), [StructField("n_removed", LongType()), StructField("kept", StringType())], ["id", "tag"], also=["runs"])


def remove_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The documents with repeated words cut out of ``text`` (those that lose none keep their text as it is).

    A word goes if a window that covers it also starts in a document with a smaller id; all windows are judged on the
    input. Null and empty texts and texts shorter than a window stay as they are. Rows with a null id lose nothing
    and take nothing from others; rows with equal ids don't touch each other. Extra columns of any name are kept.
    """
    names, (docs, (text, doc_id)) = docs.columns, numbered(docs, text, doc_id)
    cut = changed_texts(docs, text=text, doc_id=doc_id, **how).select(F.struct("id", "tag").alias("key"), "kept")
    found = docs.withColumn("own", F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("tag"))).join(cut, F.col("own") == F.col("key"), "left")
    return found.select(*[F.coalesce("kept", text).alias(c) if c == text else F.col(c) for c in docs.columns]).toDF(*names)


def digests(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and kept_sha256, of the kept words joined by one space.

    The rules are those of ``remove_repeats``; a null text has no words. Texts that lose nothing are digested where
    they are read and are not shuffled here.
    """

    def whole(part):
        words = [(t or "").encode().split() for t in part.column(part.schema.get_field_index("text")).to_pylist()]
        return [pa.array([len(w) for w in words], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string())]

    source = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))
    every = map_rows(source, whole, [StructField("n_words", LongType()), StructField("sha", StringType())], ["id", "tag"])
    cut = changed_texts(docs, text=text, doc_id=doc_id, **how).select("id", "tag", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
    gone, sha = F.coalesce("n_removed", F.lit(0).cast("long")), F.coalesce("kept_sha256", "sha")
    return every.join(cut, ["id", "tag"], "left").select(F.col("id").alias(doc_id), "n_words", gone.alias("n_removed"), sha.alias("kept_sha256"))

"""Phrase collocations by sampling with a negative border.

A sample of the documents proposes the phrases that may be frequent. A full pass then counts, over all documents and
exactly, the proposed phrases and their negative border: the phrases that were not proposed although both phrases of one
word less inside them were. A phrase of the border that turns out frequent is a failure of the sample; it makes longer
phrases possible that were never counted, so another full pass counts those, and so on until no failure is left. By
induction over the length every frequent phrase has then been counted.

Tasks ask whether a phrase was proposed in a bit table of a fixed size (two bits for each phrase). It may say yes wrongly,
which only has further phrases counted, and never no wrongly; so counts are exact at any size, and what is broadcast does
not grow. A phrase is a 64-bit hash of its language and words, its length in the three lowest bits; texts of the
frequent ones are looked up in the sample and, where it lacks them, in one more pass.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrail.llm._text import LOWER, Words, buffers, byte_table, chunks, mix, numbered, tidily
from sentrail.sources.shared import Scratch

LONGEST, LEAST, TOP, COVER = 4, 30, 2000, 80
SAMPLE = 8  # one document in so many
SLACK = 0.5  # the sample proposes what has this share of the occurrences that it would have at the minimum
FILTER_BITS = 27
HELD = 1 << 21  # hashes that a task gathers before it sums them
SALTS = 64
_SEGMENT = 20  # bits of a position in a segment of the bit table
_PIECE = byte_table(lambda b: b in b".,;:!?" or 0x0A <= b <= 0x0D)
_WORD = byte_table(lambda b: not (b in b".,;:!? \t" or 0x0A <= b <= 0x0D))
_STEP = np.uint64(0xD1342543DE82EF95 | 1)
_LEVEL = np.uint64(7)


@functools.lru_cache(maxsize=4096)
def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Phrases:
    """The words of a chunk of rows, the piece of each, and hashes of the phrases that start at given words."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        self.words = w = Words(texts, _WORD, lower=True)
        self.langs = langs.to_pylist()
        self.row = w.row_of_word()
        self.piece = np.cumsum(_PIECE[w.data])[w.s] + self.row if len(w.s) else np.zeros(0, np.int64)
        self.of_row = np.array([_lang_hash(x) for x in self.langs], dtype=np.uint64)
        self.unit = mix(w.hashes() ^ self.of_row[self.row])

    def within(self, size: int) -> np.ndarray:
        """For each word, whether a phrase of ``size`` words in one piece starts there."""
        ok = np.zeros(len(self.unit), dtype=bool)
        m = len(ok) - size + 1
        if m > 0:
            ok[:m] = self.piece[:m] == self.piece[size - 1 :]
        return ok

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            total, power = np.zeros(len(at), np.uint64), np.uint64(1)
            for j in range(size):
                total += self.unit[at + j] * power
                power *= _STEP
        return mix(total) & ~_LEVEL | np.uint64(size)

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """The phrase of no words, once for each language of the chunk, and how many words the language has."""
        kinds, of = np.unique(self.of_row, return_inverse=True)
        return mix(kinds) & ~_LEVEL, np.bincount(of, weights=self.words.counts, minlength=len(kinds)).astype(np.int64)

    def texts(self, at: np.ndarray, size: int) -> pa.Array:
        """Phrases as text, words joined by one space."""
        w = self.words
        long = (w.e - w.s) + 1
        begin = np.concatenate([[0], np.cumsum(long)])
        flat = np.full(begin[-1], 0x20, np.uint8)
        inside = np.arange(begin[-1]) - np.repeat(begin[:-1], long)
        letters = inside < np.repeat(long - 1, long)
        flat[letters] = w.data[(np.repeat(w.s, long) + inside)[letters]]
        a, b = begin[at], begin[at + size] - 1
        offsets = np.concatenate([[0], np.cumsum(b - a)])
        data = flat[np.repeat(a - offsets[:-1], b - a) + np.arange(offsets[-1])]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


def _within_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have both their bits set in a table of segments of 2**20 bits."""
    seg = (h >> np.uint64(43)) % np.uint64(len(bits))
    found = np.ones(len(h), dtype=bool)
    for shift in (3, 23):
        o = (h >> np.uint64(shift)) & np.uint64((1 << _SEGMENT) - 1)
        found &= (bits[seg, o >> np.uint64(3)] >> (o & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def bit_table(phrases: DataFrame, bits: int) -> np.ndarray:
    """A table of 2**bits bits with two of them set for each hash ``h``; tasks fill segments of 128 KB each."""
    segments = 1 << max(0, bits - _SEGMENT)

    def run(batches):
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            seg = ((h >> np.uint64(43)) % np.uint64(segments)).astype(np.int64)
            order = np.argsort(seg, kind="stable")
            cuts = np.flatnonzero(np.diff(seg[order])) + 1
            for group in np.split(order, cuts) if len(order) else []:
                table = tables.setdefault(int(seg[group[0]]), np.zeros(1 << _SEGMENT, dtype=bool))
                for shift in (3, 23):
                    table[(h[group] >> np.uint64(shift)) & np.uint64((1 << _SEGMENT) - 1)] = True
        for k, table in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(table, bitorder="little").tobytes()])], names=["seg", "bits"])

    dealt = phrases.select("h").repartition(F.pmod(F.shiftrightunsigned("h", 43), F.lit(segments)))
    found = np.zeros((segments, 1 << (_SEGMENT - 3)), dtype=np.uint8)
    for r in dealt.mapInArrow(tidily(run), "seg long, bits binary").toLocalIterator():  # at most 2**bits bits in all
        found[r.seg] |= np.frombuffer(r.bits, np.uint8)
    return found


class _Sums:
    """Counts of hashes, handed out whenever enough have been gathered."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(h)
        self.held += len(h)
        if self.held >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            h, c = np.unique(np.concatenate(self.parts), return_counts=True)
            self.parts, self.held = [], 0
            yield _counts(h, c)


def _counts(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])


def _levels(p: Phrases, longest: int, known: np.ndarray | None, fresh: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Starts, hashes and lengths of the phrases to count.

    With a table ``known``, those whose two phrases of one word less are in it; with ``fresh``, only those of which one is
    in that (and both in either). Without tables, all.
    """
    inside = lambda t, h: np.zeros(len(h), bool) if t is None else _within_filter(t, h)
    member = new = None
    for size in range(1, longest + 1):
        ok = p.within(size)
        if size > 1 and known is not None:
            ok[:-1] &= member[:-1] & member[1:]
        at = np.flatnonzero(ok)
        h = p.hashes(at, size)
        keep = slice(None)
        if fresh is not None:
            keep = new[at] | new[np.minimum(at + 1, len(new) - 1)] if size > 1 else np.zeros(len(at), bool)
        yield at[keep], h[keep], size
        if known is not None:
            member, new = np.zeros(len(ok), bool), np.zeros(len(ok), bool)
            new[at] = inside(fresh, h)
            member[at] = inside(known, h) | new[at]


def count(docs: DataFrame, longest: int, known: np.ndarray | None = None, fresh: np.ndarray | None = None) -> DataFrame:
    """Exact counts (h, c) of the phrases that ``_levels`` gives, over all rows of ``docs`` (lang, text)."""
    sent = docs.sparkSession.sparkContext.broadcast((known, fresh)) if known is not None else None

    def run(batches):
        old, new = sent.value if sent is not None else (None, None)
        sums = _Sums()
        for batch in batches:
            for part in chunks(batch, "text"):
                p = Phrases(part.column(0), part.column(1))
                if new is None:
                    yield _counts(*p.totals())
                for _, h, _ in _levels(p, longest, old, new):
                    yield from sums.add(h)
        yield from sums.flush()

    return docs.mapInArrow(tidily(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def texts(docs: DataFrame, longest: int, wanted: np.ndarray) -> DataFrame:
    """Language and text (h, lang, phrase) of the phrases of two words and more in the table ``wanted``."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        table = sent.value
        for batch in batches:
            for part in chunks(batch, "text"):
                p = Phrases(part.column(0), part.column(1))
                for size in range(2, longest + 1):
                    at = np.flatnonzero(p.within(size))
                    h = p.hashes(at, size)
                    hit = _within_filter(table, h)
                    h, first = np.unique(h[hit], return_index=True)
                    if len(h):
                        at = at[hit][first]
                        langs = pa.array([p.langs[r] for r in p.row[at]], pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), langs, p.texts(at, size)], names=["h", "lang", "phrase"])

    return docs.mapInArrow(tidily(run), "h long, lang string, phrase string").distinct()


def _parts(phrases: DataFrame) -> DataFrame:
    """Adds to (h, lang, phrase, a) the hashes of the phrases inside: ``zero`` (no words), ``pre`` and ``suf`` of each cut, ``subs`` (two words and more)."""

    def run(batches):
        lists = pa.list_(pa.int64())
        for batch in batches:
            p = Phrases(batch.column(1), batch.column(2))
            sizes, first = p.words.counts, p.words.first[:-1]
            zero = (mix(p.of_row) & ~_LEVEL).view(np.int64)
            found: dict[tuple[int, int], np.ndarray] = {}
            for size in range(1, int(sizes.max(initial=1))):
                for a in range(int(sizes.max(initial=1)) - size + 1):
                    rows = np.flatnonzero(sizes >= a + size)
                    h = np.zeros(len(sizes), np.int64)
                    h[rows] = p.hashes(first[rows] + a, size).view(np.int64)
                    found[a, size] = h
            rows = [(int(n), r) for r, n in enumerate(sizes)]
            pre = [[int(found[0, k][r]) for k in range(1, n)] for n, r in rows]
            suf = [[int(found[k, n - k][r]) for k in range(1, n)] for n, r in rows]
            subs = [[int(found[a, s][r]) for s in range(2, n) for a in range(n - s + 1)] for n, r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(zero), pa.array(pre, lists), pa.array(suf, lists), pa.array(subs, lists)], names=[*batch.schema.names, "zero", "pre", "suf", "subs"])

    return phrases.select("h", "lang", "phrase", "a").mapInArrow(tidily(run), "h long, lang string, phrase string, a long, zero long, pre array<long>, suf array<long>, subs array<long>")


def frequent(docs: DataFrame, sample: DataFrame, scratch: Scratch, *, longest: int, least: int, propose: int, filter_bits: int) -> DataFrame:
    """All phrases (h, c) of up to ``longest`` words with ``least`` occurrences and more, exactly counted.

    Level 0 (no words) has the words of each language.
    """
    proposed = scratch.keep("proposed", [count(sample, longest).where(F.col("c") >= propose).select("h")])
    known = bit_table(proposed, filter_bits)
    counts = [scratch.keep("counts0", [count(docs, longest, known).where(F.col("c") >= least)])]
    level = F.col("h").bitwiseAND(7)
    failed = counts[0].where(level.between(1, longest - 1)).join(proposed, "h", "left_anti").select("h")
    while failed.limit(1).count():
        fresh = bit_table(failed, filter_bits)
        seen = functools.reduce(DataFrame.unionByName, counts).select("h")
        more = scratch.keep(f"counts{len(counts)}", [count(docs, longest, known, fresh).where(F.col("c") >= least).join(seen, "h", "left_anti")])
        counts.append(more)
        known |= fresh
        failed = more.where(level.between(1, longest - 1)).join(proposed, "h", "left_anti").select("h")
    return functools.reduce(DataFrame.unionByName, counts)


def mine(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", longest: int = LONGEST, least: int = LEAST, top: int = TOP, cover: int = COVER,
    sample: int = SAMPLE, slack: float = SLACK, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """The ``top`` phrases of each language by their weakest cut: lang, rank, phrase, a, l, r, n, score.

    A-Z count as lower case; pieces end at ``.,;:!?`` and line ends, words at spaces and tabs. A null text is empty, a
    null language is ``und``. A phrase of 2 to ``longest`` words with ``a >= least`` occurrences is cut after each of
    its words but the last, into parts of l and r occurrences; floor(2000000 * a / (l + r)) of the lowest cut (the
    first of equals) is its score. It goes if a longer frequent phrase around it has at least ``cover`` % of its
    occurrences. n are all words of the language. Order: score and a descending, phrase ascending by bytes.

    ``sample`` is the share of documents (by a hash of the id) that proposes phrases; it and ``slack`` and
    ``filter_bits`` change the work, never the result. An empty table gives no rows; repeated rows count as often as they
    are there; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    rows, (the_text, the_lang, the_id) = numbered(docs, text, lang, doc_id)
    pick = F.pmod(F.xxhash64(F.col(the_id).cast("string")), F.lit(sample)) == 0
    clean = lambda df: df.select(F.coalesce(F.col(the_lang), F.lit("und")).alias("lang"), F.coalesce(F.col(the_text), F.lit("")).alias("text"))
    whole, part = clean(rows), scratch.keep("sample", [clean(rows.where(pick))])
    counts = frequent(whole, part, scratch, longest=longest, least=least, propose=max(1, round(least * slack / sample)), filter_bits=filter_bits)
    wanted = counts.where(F.col("h").bitwiseAND(7) >= 2)
    told = scratch.keep("texts0", [texts(part, longest, bit_table(wanted, filter_bits)).join(wanted, "h", "left_semi")])
    rest = wanted.join(told, "h", "left_anti")
    if rest.limit(1).count():  # frequent in all documents, absent from the sample
        told = told.unionByName(scratch.keep("texts1", [texts(whole, longest, bit_table(rest, filter_bits)).join(rest, "h", "left_semi")]))
    phrases = scratch.keep("phrases", [_parts(told.join(wanted.withColumnRenamed("c", "a"), "h"))])
    cuts = phrases.select("h", "a", F.posexplode(F.arrays_zip("pre", "suf")).alias("k", "cut")).select("h", "a", "k", "cut.pre", "cut.suf")
    cuts = cuts.join(counts.select(F.col("h").alias("pre"), F.col("c").alias("l")), "pre").join(counts.select(F.col("h").alias("suf"), F.col("c").alias("r")), "suf")
    score = F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div cast(l + r as decimal(21,0))")
    weakest = cuts.groupBy("h").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w"))
    around = phrases.select(F.explode("subs").alias("h"), "a").groupBy("h").agg(F.max("a").alias("most"))
    kept = phrases.select("h", "lang", "phrase", "a", "zero").join(around, "h", "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * cover))
    scored = kept.join(weakest, "h").select("lang", "phrase", "a", "zero", "w.l", "w.r", "w.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = scored.withColumn("salt", salt).withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = counts.where(F.col("h").bitwiseAND(7) == 0).select(F.col("h").alias("zero"), F.col("c").alias("n"))
    return best.join(words, "zero").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Scoring by a probabilistic suffix tree over words.

Every word and the end of a text is a symbol. Contexts are the runs of one to three words that training has at least
``LEAST`` times; a context of depth d stays if its next-symbol distribution diverges from that of its suffix by a
likelihood-ratio test, or if a longer context on top of it stays. Each context's distribution is smoothed with that
of its suffix, down to the add-one word frequencies, and every token is scored in the longest context that the tree
has. The minimum is a count and not a share, so what is learned does not shrink as the corpus grows.

The tree is a set of Spark tables keyed by the hash of a run of words: a run of k words is a context of depth k and an
entry (context and next symbol) of depth k - 1. A score in the longest context is a sum over the runs that end in each
token: an entry adds log(1 + n / ((strength + rest) * p of its suffix)), a context adds the log of the mass that it
leaves to its suffix. So scoring is a sum of the weights of all runs of a text. Weights of words and runs of at least
``table_share`` and ``HOT_SHARE`` of all tokens are broadcast (at most 1 / share of them each, at any size); all others
are asked for. There are several runs for every token, so they travel and are kept as packed bytes by ranges of a
hash, in passes by residue. Suffixes of a run, and contexts on top of them, end in the same two words, so all that is
judged of contexts of two words and more needs one meeting by these two words; only runs that are there often enough
come to it. Runs longer than pairs are counted only where a bit table of a fixed size says that all their pairs were
found, and a token asks only for runs that such a table says have a weight. A table may say yes wrongly, which costs
work and changes no result.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrail.llm._text import NOT_SPACE, chunks, tidily, Words, written
from sentrail.llm.crf import fold_of
from sentrail.llm.phrasemine import _within_filter
from sentrail.sources.shared import Scratch

FOLDS, HELD_OUT, DEPTH = 7, 2, 3
TABLE_SHARE = 2e-7
LEAST, HOT_SHARE = 2, 2e-6
PASSES = 2
FILTER_BITS = 27
HELD, PIECE, PACKED_BYTES = 1 << 18, 1 << 15, 32 << 20
TURN = 17
PACKED, SEGMENT = "to int, kind int, rows binary", 20
RUN, PAIR, WEIGHT, WORD = [np.uint64] * 3 + [np.int64], [np.uint64] * 2 + [np.int64] * 5, [np.uint64, np.int64, np.float64], [np.uint64, np.float64, np.float64]
STRENGTH = 10.0
END_WORD = np.uint64(0x1234567890ABCDEF)
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class Table:
    """Places of 64-bit keys in an array, looked up in bulk through a few direct-mapped levels."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels = keys.astype(np.uint64), []
        left, k = np.arange(len(keys)), 0
        while len(left):
            bits = max(8, int(np.ceil(np.log2(4 * len(left)))))
            slots = np.full(1 << bits, -1, dtype=np.int32)
            at = self._slot(self.keys[left], k, bits)
            slots[at[::-1]] = left[::-1]
            self.levels.append((bits, slots))
            left = left[slots[at] != left]
            k += 1

    @staticmethod
    def _slot(x: np.ndarray, k: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((x * _ODD[k % len(_ODD)] + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of every x, -1 where there is none."""
        out = np.full(len(x), -1, dtype=np.int64)
        todo = np.arange(len(x))
        for k, (bits, slots) in enumerate(self.levels):
            y = x if k == 0 else x[todo]
            got = slots[self._slot(y, k, bits)]
            some = got >= 0
            same = some & (self.keys[got] == y)
            out[todo[same]] = got[same]
            todo = todo[some & ~same]
            if not len(todo):
                break
        return out


def tokens_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a chunk with an end after each row, and the first token of each row."""
    w = Words(col, NOT_SPACE, lower=True)
    return np.insert(w.hashes(), w.first[1:], END_WORD), w.first + np.arange(len(w.first))


def _batched(fn):
    """Runs fn over the token arrays of each chunk and sums its (key, count) pairs over each batch."""

    def run(batches):
        for batch in batches:
            keys, counts = [], []
            for part in chunks(batch, "text"):
                k, n = fn(*tokens_of(part.column(0)))
                keys.append(k)
                counts.append(n)
            key, at = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(total)], names=["key", "n"])

    return run


def _summed(texts: DataFrame, fn) -> DataFrame:
    return texts.mapInArrow(tidily(_batched(fn)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _word_counts(tokens: np.ndarray, first: np.ndarray):
    key, n = np.unique(tokens, return_counts=True)
    return key.view(np.int64), n


def runs(tokens: np.ndarray, first: np.ndarray, depth: int):
    """Hashes of the runs of 2 to depth + 1 tokens in a row, and the places of their last tokens."""
    place = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
    h = tokens
    for d in range(1, depth + 1):
        before = np.zeros(len(tokens), dtype=np.uint64)
        before[1:] = h[:-1]
        h = tokens ^ (before << np.uint64(TURN) | before >> np.uint64(64 - TURN))
        at = np.flatnonzero(place >= d)
        yield h[at], at


def _longer(run, word):
    """Hash of a run with one more word, as in ``runs``."""
    return F.shiftleft(run, TURN).bitwiseOR(F.shiftrightunsigned(run, 64 - TURN)).bitwiseXOR(word)


def _shorter(run, word):
    """Hash of a run without its last word."""
    x = run.bitwiseXOR(word)
    return F.shiftleft(x, 64 - TURN).bitwiseOR(F.shiftrightunsigned(x, TURN))


def _without_last(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """``_shorter`` for arrays."""
    x = run ^ word
    return x << np.uint64(64 - TURN) | x >> np.uint64(TURN)


def _partitions(spark, size: float) -> int:
    """Partitions in which so many bytes take some 32 MB each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size / PACKED_BYTES) + 1)


def _packed(kind: int, parts: int, key: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Columns as bytes, one after another, a row for each partition (a range of keys) that has some; their order is kept."""
    to = (key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    order = np.argsort(to.astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")
    to, columns = to[order], [x[order] for x in columns]
    cuts = np.append(np.flatnonzero(np.diff(to, prepend=np.uint64(parts))), len(to))
    rows = [b"".join(x[a:b].tobytes() for x in columns) for a, b in pairwise(cuts)]
    return pa.RecordBatch.from_arrays([pa.array(to[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(rows), kind, np.int32)), pa.array(rows, pa.binary())], names=["to", "kind", "rows"])


def _unpacked(batch: pa.RecordBatch, kind: int, types: list) -> list[np.ndarray]:
    """All rows of a kind in a batch of packed ones, by column."""
    found, width = [[np.zeros(0, t)] for t in types], sum(np.dtype(t).itemsize for t in types)
    for raw in batch.filter(pa.array(batch.column(1).to_numpy() == kind)).column(2).to_pylist():
        at, n = 0, len(raw) // width
        for column, t in zip(found, types, strict=True):
            column.append(np.frombuffer(raw, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(x) for x in found]


def _joined(held: list) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*held, strict=True)]


def _pieces(kind: int, columns: list[np.ndarray]):
    """Packed rows of a table that is kept: of ``PIECE`` rows at most, as the JVM holds large values twice."""
    for a in range(0, len(columns[0]), PIECE):
        piece = [x[a : a + PIECE] for x in columns]
        yield _packed(kind, 1, piece[0], piece)


def _sent(df: DataFrame, kind: int, to: int, arrays) -> DataFrame:
    """The packed columns that ``arrays(batch)`` gives, the key first, of up to ``HELD`` rows at a time; with one partition a table to keep."""

    def run(batches):
        held = []
        for batch in batches:
            held.append(arrays(batch))
            if sum(len(h[0]) for h in held) >= HELD:
                key, *columns = _joined(held)
                yield from _pieces(kind, columns) if to == 1 else [_packed(kind, to, key, columns)]
                held = []
        if held:
            key, *columns = _joined(held)
            yield from _pieces(kind, columns) if to == 1 else [_packed(kind, to, key, columns)]

    return df.mapInArrow(tidily(run), PACKED)


def _columns(batch: pa.RecordBatch, *types) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False).view(t) for k, t in enumerate(types)]


def _flat(packed: DataFrame, kind: int, types: list, schema: str, columns) -> DataFrame:
    """``columns(*unpacked)`` of one kind of a packed table as rows."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            found = columns(*_unpacked(batch, kind, types))
            for a in range(0, len(found[0]), HELD):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in (y[a : a + HELD] for y in found)], names=names)

    return packed.mapInArrow(tidily(run), schema)


def _summed_by(key: np.ndarray, firsts: list[np.ndarray], sums: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct keys in ascending order, the first of some columns and the sums of others for each."""
    order = np.argsort(key)
    key = key[order]
    one = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    return [key[one], *(x[order][one] for x in firsts), *(np.add.reduceat(x[order], one) if len(one) else x for x in sums)]


def _run_counts(*how) -> DataFrame:
    """``_counted`` as rows: size, g, y, up and n."""

    def run(batches):
        for batch in batches:
            for size in np.unique(batch.column(1).to_numpy()):
                g, *others = (pa.array(x.view(np.int64)) for x in _unpacked(batch, size, RUN))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), size, np.int32)), g, *others], names=["size", "g", "y", "up", "n"])

    return _counted(*how).mapInArrow(tidily(run), "size int, g long, y long, up long, n long")


def _counted(texts: DataFrame, sizes: list[int], part: int, parts: int, least: float, entries: float, pairs: np.ndarray | None = None) -> DataFrame:
    """g, y (last word), up (the run without its first word) and n, packed, of the runs of some sizes (kinds) and one residue of g that occur ``least`` times.

    Tasks sum up to ``HELD`` runs at a time and send them as packed bytes by ranges of g. Who receives them merges them
    whenever ``HELD`` more, and as many as there are, have come, so a frequent run takes up no more than a rare one. With a bit table ``pairs``
    only runs all of whose pairs of neighbours are in it are counted.
    """
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(pairs) if pairs is not None else None
    to = _partitions(spark, entries * 20 / parts)
    kinds = {size: [np.uint64] * (2 if size == 2 else 3) + [np.uint32] for size in sizes}  # up of a pair is y

    def flushed(size, held):
        g, *others, n = _summed_by(*(lambda g, *o: (g, o[:-1], o[-1:]))(*_joined(held)))
        return _packed(size, to, g, [g, *others, n.astype(np.uint32)])

    def count(batches):
        table = sent.value if sent is not None else None
        held = {size: [] for size in sizes}
        for batch in batches:
            for piece in chunks(batch, "text"):
                tokens, first = tokens_of(piece.column(0))
                found = dict(enumerate(runs(tokens, first, max(sizes) - 1), 2))
                if table is not None:
                    seen, (h, at) = np.zeros(len(tokens), dtype=bool), found[2]
                    seen[at] = _within_filter(table, h)
                shorter = tokens
                for size, (h, at) in found.items():
                    if size in sizes:
                        ok = h % np.uint64(parts) == np.uint64(part)
                        for k in range(size - 1 if table is not None else 0):
                            ok &= seen[at - k]
                        held[size].append((h[ok], tokens[at[ok]], *((shorter[at[ok]],) if size > 2 else ()), np.ones(int(ok.sum()), dtype=np.int64)))
                        if sum(len(x[0]) for x in held[size]) >= HELD:
                            yield flushed(size, held[size])
                            held[size] = []
                    shorter = np.zeros(len(tokens), dtype=np.uint64)
                    shorter[at] = h
        for size in sizes:
            if held[size]:
                yield flushed(size, held[size])

    def merge(batches):
        kept, fresh = {size: [] for size in sizes}, dict.fromkeys(sizes, 0)
        squeeze = lambda held: _summed_by(*(lambda g, *o: (g, o[:-1], o[-1:]))(*_joined(held)))
        for batch in batches:
            for size in sizes:
                got = _unpacked(batch, size, kinds[size])
                kept[size].append((*got[:-1], got[-1].astype(np.int64)))
                fresh[size] += len(got[0])
                if fresh[size] >= max(HELD, len(kept[size][0][0])):
                    kept[size], fresh[size] = [squeeze(kept[size])], 0
        for size in sizes:
            if kept[size]:
                g, *others, n = squeeze(kept[size])
                often = n >= least
                g, y, up, n = g[often], others[0][often], others[-1][often], n[often]
                yield from _pieces(size, [g, y, up, n])

    return texts.mapInArrow(tidily(count), PACKED).repartitionById(to, "to").mapInArrow(tidily(merge), PACKED)


def _bits(packed: DataFrame, kinds: dict[int, list], bits: int) -> np.ndarray:
    """A table as of ``bit_table`` for the first columns of a packed table."""
    segments = 1 << bits - SEGMENT

    def deal(batches):
        for batch in batches:
            for kind, types in kinds.items():
                h = _unpacked(batch, kind, types)[0]
                for a in range(0, len(h), HELD):
                    x = h[a : a + HELD]
                    yield _packed(0, segments, (x >> np.uint64(43)) << np.uint64(64 - bits + SEGMENT), [x])

    def fill(batches):
        for batch in batches:
            of = batch.column(0).to_numpy()
            for segment in np.unique(of):
                table = np.zeros(1 << SEGMENT, dtype=bool)
                for shift in (3, 23):
                    table[(_unpacked(batch.filter(pa.array(of == segment)), 0, [np.uint64])[0] >> np.uint64(shift)) & np.uint64((1 << SEGMENT) - 1)] = True
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(table, bitorder="little").tobytes()])], names=["segment", "bits"])

    found = np.zeros((segments, 1 << (SEGMENT - 3)), dtype=np.uint8)
    for r in packed.mapInArrow(tidily(deal), PACKED).repartition("to").mapInArrow(tidily(fill), "segment int, bits binary").toLocalIterator():  # at most 2**bits bits for each batch
        found[r.segment] |= np.frombuffer(r.bits, np.uint8)
    return found


def _told(parts, total, rest, other, k):
    """Whether contexts diverge from their suffixes: parts are the sums of n * log(n / (total * expected)) of their entries."""
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (parts + np.where(rest > 0, rest * np.log(rest / (total * other)), 0.0))
    return (k > 0) & (g > k + 4 * np.sqrt(2 * k) + 4)


def _deeper(pairs: DataFrame, longer: DataFrame, floor: float, least: float, strength: float, part: int, parts: int, size: float) -> DataFrame:
    """Packed: g, n, w (kind 0) of the runs with weights of contexts of two words and more, of one residue of the last two; the words (kind 1) that such contexts are on top of.

    Runs first meet the pairs that end them (by ranges of ``up``), then all runs whose contexts end in the same two words
    meet (by ranges of that pair): suffixes of theirs, and contexts on top, have the same two words. Only runs and pairs
    that are there often enough come this far.
    """
    end, to, u, f = END_WORD, _partitions(pairs.sparkSession, size / parts), np.uint64, np.float64
    mine = lambda key: key % u(parts) == u(part)
    only = lambda ok, *columns: tuple(x[ok] for x in columns)

    def of_pairs(batch):
        g, _, n, n_y, total, rest, _ = _unpacked(batch, 0, PAIR)
        base = (n_y + 1) / floor
        return g, g, (n + base) / (total + 1), (n + (strength + rest) * base) / (total + strength), base

    def entries(batch):
        g, y, up, n = _unpacked(batch, 3, RUN)
        return only(mine(_without_last(g, y)), up, up, g, y, n)

    def with_pairs(batches):
        held, table = [], None
        for batch in batches:
            held.append(_unpacked(batch, 0, [u, f, f, f]))
            up, g, y, n = _unpacked(batch, 1, [u, u, u, np.int64])
            if not len(up):
                continue
            if table is None:  # pairs come first
                table = _joined(held)
                order = np.argsort(table[0])
                table = [x[order] for x in table]
            if len(table[0]):
                at = np.minimum(np.searchsorted(table[0], up), len(table[0]) - 1)
                hit = table[0][at] == up
                g, y, n = only(hit, g, y, n)
                yield _packed(1, to, _without_last(g, y), [g, y, n, *(x[at[hit]] for x in table[1:])])

    def contexts(batch):
        g, y, n, *_ = _unpacked(batch, 0, PAIR)
        return only(mine(g) & (y != end) & (n >= least), g, g, n, y)

    def long_contexts(batch):
        g, y, up, n = _unpacked(batch, 3, RUN)
        return only(mine(up) & (y != end) & (n >= least), up, g, n, up)

    def long_entries(batch):
        g, y, up, n = _unpacked(batch, 4, RUN)
        c = _without_last(up, y)
        return only(mine(c), c, g, y, n, up)

    def place(keys, x):
        """Places of x in ascending keys, and which are there."""
        if not len(keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return at, keys[at] == x

    def tree(batches):
        kinds = {0: [u, np.int64, u], 1: [u, u, np.int64, f, f, f], 2: [u, np.int64, u], 3: [u, u, np.int64, u]}
        held = {k: [[np.zeros(0, t) for t in types]] for k, types in kinds.items()}
        for batch in batches:
            for k, types in kinds.items():
                held[k].append(_unpacked(batch, k, types))
        tables = {}
        for k in kinds:
            columns = _joined(held.pop(k))
            order = np.argsort(columns[0])
            tables[k] = [x[order] for x in columns]
        (c2, total2, word), (g3, y3, n3, e3, m3, base) = tables[0], tables[1]
        at, hit = place(c2, _without_last(g3, y3))
        g3, n3, e3, m3, base, at = only(hit, g3, n3, e3, m3, base, at)
        sums = lambda i, size, x: np.bincount(i, weights=x, minlength=size)
        k2, rest2 = np.bincount(at, minlength=len(c2)), total2 - sums(at, len(c2), n3)
        kept2 = _told(sums(at, len(c2), n3 * np.log(n3 / (total2[at] * e3))), total2, rest2, np.maximum(1e-12, 1 - sums(at, len(c2), e3)), k2)
        lent3 = (strength + rest2[at]) * m3
        (c3, total3, c3_up), (g4, y4, n4, up4) = tables[2], tables[3]
        (at4, hit), (up, some) = place(c3, _without_last(g4, y4)), place(g3, up4)
        g4, n4, at4, up = only(hit & some, g4, n4, at4, up)
        e4 = (n3[up] + base[up]) / (total2[at[up]] + 1)
        k3, rest3 = np.bincount(at4, minlength=len(c3)), total3 - sums(at4, len(c3), n4)
        kept3 = _told(sums(at4, len(c3), n4 * np.log(n4 / (total3[at4] * e4))), total3, rest3, np.maximum(1e-12, 1 - sums(at4, len(c3), e4)), k3)
        lent4 = (strength + rest3[at4]) * ((n3 + lent3) / (total2[at] + strength))[up]
        below, known = place(c2, c3_up[kept3])
        kept2[below[known]] = True
        left = lambda rest, total: np.log10((strength + rest) / (total + strength))
        in3, in4 = kept2[at], kept3[at4]
        found = [(g3[in3], n3[in3], np.log10(1 + n3[in3] / lent3[in3])), (g4[in4], n4[in4], np.log10(1 + n4[in4] / lent4[in4]))]
        found += [(c[kept], total[kept], left(rest[kept], total[kept])) for c, total, rest, kept in ((c2, total2, rest2, kept2), (c3, total3, rest3, kept3))]
        words = np.unique(word[kept2])
        for kind, columns in [*((0, x) for x in found), (1, (words,))]:
            yield from _pieces(kind, columns)

    ended = _sent(pairs, 0, to, of_pairs).unionByName(_sent(longer, 1, to, entries))
    ended = ended.repartitionById(to, "to").sortWithinPartitions("kind").mapInArrow(tidily(with_pairs), PACKED)
    together = ended.unionByName(_sent(pairs, 0, to, contexts)).unionByName(_sent(longer, 2, to, long_contexts)).unionByName(_sent(longer, 3, to, long_entries))
    return together.repartitionById(to, "to").mapInArrow(tidily(tree), PACKED)


def grow(texts: DataFrame, counts: DataFrame, n: int, v: int, tables: Scratch, *, depth: int = DEPTH, least: float = LEAST, entry_least: float = LEAST, strength: float = STRENGTH, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """The tree as tables: words (key, n, w), and packed (kind 0) the runs (g, n, w) with their weights (log10).

    A run may have two rows, one as an entry and one as a context; its weight is their sum. Runs of more than two
    words are counted, and contexts judged, in ``passes`` by residue of a key, pairs in half of them, so that the disk
    their shuffles take is a share of the whole; steps drop the tables that only they read.
    """
    spark, end = texts.sparkSession, int(END_WORD.view(np.int64))
    floor = float(n + v + 1)
    base = (F.col("n_y") + 1) / F.lit(floor)
    found = tables.keep("found", [_counted(texts, [2], j, max(1, passes // 2), entry_least, n) for j in range(max(1, passes // 2))])
    longer = None
    if depth > 1:  # a run that is there so often has pairs that are
        seen = _bits(found, {2: RUN}, FILTER_BITS)
        longer = tables.keep("longer", [_counted(texts, list(range(3, depth + 2)), j, passes, entry_least, n * (depth - 1), seen) for j in range(passes)])
    of_word = counts.select(F.col("key").alias("y"), F.col("n").alias("n_y"))
    rows = _flat(found, 2, RUN, "g long, y long, up long, n long", lambda g, y, up, n: (g, y, up, n))
    ended = tables.keep("ended", [rows.join(of_word, "y").select(_shorter(F.col("g"), F.col("y")).alias("c"), "g", "y", "n", "n_y")])
    tables.drop("found")
    sums = ended.groupBy("c").agg(F.count("*").alias("k"), F.sum("n").alias("sum"), F.sum(F.col("n") * F.log(F.col("n") / base)).alias("parts"), F.greatest(F.lit(1e-12), 1 - F.sum(base)).alias("other"))
    context = counts.where((F.col("key") != end) & (F.col("n") >= least)).select(F.col("key").alias("c"), F.col("n").alias("total"))
    rest, total = F.col("rest"), F.col("total")
    g = 2 * (F.col("parts") - F.col("sum") * F.log(total) + F.when(rest > 0, rest * F.log(rest / (total * F.col("other")))).otherwise(F.lit(0.0)))
    judged = sums.join(context, "c").withColumn("rest", total - F.col("sum")).select("c", "total", "rest", (g > F.col("k") + 4 * F.sqrt(2 * F.col("k")) + 4).alias("own"))
    tests = tables.keep("tests", [judged])
    pairs = ended.join(tests, "c").select("g", "y", "n", "n_y", "total", "rest", F.col("own").cast("long"))
    pairs = tables.keep("pairs", [_sent(pairs, 0, 1, lambda batch: [(x := _columns(batch, *PAIR))[0], *x])])
    tables.drop("ended")

    on_top = spark.createDataFrame([], "c long")
    deep = None
    if depth > 1:
        size = n * 8.0  # bytes that are sent, about
        deep = tables.keep("deep", [_deeper(pairs, longer, floor, least, strength, j, passes, size) for j in range(passes)])
        tables.drop("longer")
        on_top = written(_flat(deep, 1, [np.uint64], "c long", lambda c: (c,)).distinct())

    def weighed(own, *columns):
        g, y, n, n_y, total, rest, told = columns
        ok, w = told == own, np.log10(1 + n / ((strength + rest) * ((n_y + 1) / floor)))
        return g[ok], y[ok], n[ok], w[ok]

    def of_own(batch):
        g, _, n, w = weighed(1, *_unpacked(batch, 0, PAIR))
        return g, g, n, w

    below = _flat(pairs, 0, PAIR, "g long, y long, n long, w double", lambda *x: weighed(0, *x))
    below = below.withColumn("c", _shorter(F.col("g"), F.col("y"))).join(on_top, "c", "left_semi").select("g", "n", "w")
    weights = tables.keep("weights", [_sent(pairs, 0, 1, of_own), _sent(below, 0, 1, lambda batch: [(x := _columns(batch, *WEIGHT))[0], *x])])
    tables.drop("pairs")
    kept = tests.join(on_top.withColumn("on_top", F.lit(True)), "c", "left").where("own or on_top")
    left = F.log10((F.lit(strength) + rest) / (total + strength)).alias("w")
    words = written(counts.join(kept.select(F.col("c").alias("key"), left), "key", "left").select("key", "n", F.coalesce("w", F.lit(0.0)).alias("w")))
    return words, weights if deep is None else weights.unionByName(deep.where("kind = 0"))


def _text_sums(rows: DataFrame, weights: DataFrame, often, used, depth: int, part: int, passes: int, size: float) -> DataFrame:
    """row, n_tokens, copies, known, base and w of texts, as far as words and runs of one residue give them.

    Tasks add what the broadcast ``often`` has and ask for the rest: words, and runs that the bit table ``used`` may
    have. Weights and askers meet as packed bytes by ranges of g, and what is found goes back by ranges of rows.
    """
    to, u, f, i = _partitions(rows.sparkSession, size / passes), np.uint64, np.float64, np.int64
    sums = [u, i, i, i, f, f]

    def ask(batches):
        asked, own = [], []
        for batch in batches:
            for piece in chunks(batch, "text"):
                tokens, first = tokens_of(piece.column(1))
                row, of = piece.column(0).to_numpy().view(u), np.repeat(np.arange(piece.num_rows), np.diff(first))
                (table, log_base, weight), bits = often.value, used.value
                known, base, w = (np.zeros(piece.num_rows) for _ in range(3))
                for size, (h, at) in enumerate([(tokens, np.arange(len(tokens))), *runs(tokens, first, depth)], 1):
                    mine = np.flatnonzero(h % u(passes) == u(part))
                    h, at = h[mine], of[at[mine]]
                    got = table.find(h)
                    hit = np.flatnonzero(got >= 0)
                    add = lambda x: np.bincount(at[hit], weights=x[got[hit]], minlength=piece.num_rows)  # noqa: B023, E731
                    base, w, known = base + add(log_base), w + add(weight), known + add(log_base < 0)
                    rest = np.flatnonzero(got < 0)
                    if size > 1:
                        rest = rest[_within_filter(bits, h[rest])]
                    asked.append((h[rest], row[at[rest]]))
                once = np.full(piece.num_rows, part == 0)
                own.append((row, np.diff(first) * once, once.astype(i), known.astype(i), base, w))
            if sum(len(x[0]) for x in asked) >= HELD:
                g, row = _joined(asked)
                yield _packed(1, to, g, [g, row])
                asked = []
            if sum(len(x[0]) for x in own) >= HELD:
                columns = _joined(own)
                yield _packed(2, to, columns[0], columns)
                own = []
        if asked:
            g, row = _joined(asked)
            yield _packed(1, to, g, [g, row])
        if own:
            columns = _joined(own)
            yield _packed(2, to, columns[0], columns)

    def answer(batches):
        held, table, found = [], None, []
        for batch in batches:
            held.append(_unpacked(batch, 0, [u, f, f]))
            g, row = _unpacked(batch, 1, [u, u])
            own = _unpacked(batch, 2, sums)
            if len(g):
                if table is None:  # weights come first
                    key, base, w = _joined(held)
                    key, base, w = _summed_by(key, [], [base, w])
                    table = Table(key), base, w
                got = table[0].find(g)
                hit = np.flatnonzero(got >= 0)
                base, w = (x[got[hit]] for x in table[1:])
                row, known, base, w = _summed_by(row[hit], [], [(base < 0).astype(i), base, w])
                none = np.zeros(len(row), i)
                found.append((row, none, none, known, base, w))
            if len(own[0]):
                found.append(own)
            if sum(len(x[0]) for x in found) >= HELD:
                columns = _joined(found)
                yield _packed(0, to, columns[0], columns)
                found = []
        if found:
            columns = _joined(found)
            yield _packed(0, to, columns[0], columns)

    def add_up(batches):
        kept, fresh = [[np.zeros(0, t) for t in sums]], 0
        for batch in batches:
            kept.append(_unpacked(batch, 0, sums))
            fresh += len(kept[-1][0])
            if fresh >= max(HELD, len(kept[0][0])):
                row, *others = _joined(kept)
                kept, fresh = [_summed_by(row, [], others)], 0
        row, *others = _joined(kept)
        row, *others = _summed_by(row, [], others)
        yield pa.RecordBatch.from_arrays([pa.array(row.view(i)), *map(pa.array, others)], names=["row", "n_tokens", "copies", "known", "base", "w"])

    def of_weights(batch):
        (g, _, w), (word, base, left) = _unpacked(batch, 0, WEIGHT), _unpacked(batch, 1, WORD)
        g, base, w = np.concatenate([g, word]), np.concatenate([np.zeros(len(g)), base]), np.concatenate([w, left])
        mine = g % u(passes) == u(part)
        return g[mine], g[mine], base[mine], w[mine]

    together = _sent(weights, 0, to, of_weights).unionByName(rows.mapInArrow(tidily(ask), PACKED)).repartitionById(to, "to").sortWithinPartitions("kind")
    return together.mapInArrow(tidily(answer), PACKED).repartitionById(to, "to").mapInArrow(tidily(add_up), "row long, n_tokens long, copies long, known long, base double, w double")


def score(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", folds: int = FOLDS, held_out: int = HELD_OUT, depth: int = DEPTH, share: float = 0.0, entry_share: float = 0.0, table_share: float = TABLE_SHARE, hot_share: float = HOT_SHARE, strength: float = STRENGTH, passes: int = PASSES) -> DataFrame:
    """Trains on the rows outside the held-out fold and scores all rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10). A null or empty text
    is an end alone. A row with a null id is in the training part and is scored. Repeated rows count each in
    training and get one result each, the same for rows of equal id and text. An empty table gives an empty result.
    Words, runs and texts of one id are told apart by 64-bit hashes. Other columns are not read. Contexts and entries
    need ``LEAST`` occurrences, or ``share`` and ``entry_share`` of the tokens where those are given; ``depth`` is 1 to
    3. ``table_share``, ``hot_share`` and ``passes`` (in how many parts runs are counted and judged, and in one more looked up,
    against disk) have no effect on results.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth: 1 to 3")
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    fold = fold_of("id", folds)
    texts = source.where(fold != held_out).select("text")
    counts = written(_summed(texts, _word_counts))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tables = Scratch(spark)
    words, weights = grow(texts, counts, n, v, tables, depth=depth, least=max(LEAST, share * n), entry_least=max(LEAST, entry_share * n), strength=strength, passes=passes)
    log_base = F.log10((F.col("n") + 1) / F.lit(float(n + v + 1))).alias("base")
    hot = words.where(F.col("n") >= max(1, table_share * n)).select("key", log_base, "w").toArrow()  # 1 / table_share rows at most
    most = max(1, hot_share * n)
    hot_runs = _flat(weights, 0, WEIGHT, "g long, w double", lambda g, m, w: (g[m >= most], w[m >= most])).groupBy("g").agg(F.sum("w").alias("w")).toArrow()  # depth / hot_share rows at most
    column = lambda k, c: np.concatenate([np.asarray(t[c].to_numpy()) for t, c in ((hot, k), (hot_runs, c)) if c])
    often = (Table(column("key", "g").view(np.uint64)), np.concatenate([column("base", None), np.zeros(hot_runs.num_rows)]), column("w", "w"))
    used = _bits(weights, {0: WEIGHT}, FILTER_BITS + 1)
    sent = [spark.sparkContext.broadcast(x) for x in (often, used)]

    # Rows go by a hash of their content and not by their place in the table.
    row = F.xxhash64("id", "text").alias("row")
    every = weights.unionByName(tables.keep("words", [_sent(words.select("key", log_base, "w"), 1, 1, lambda batch: [(x := _columns(batch, *WORD))[0], *x])]))
    pieces = [_text_sums(source.select(row, "text"), every, *sent, depth, j, passes + 1, 16.0 * n * (depth + 1)) for j in range(passes + 1)]
    found = tables.keep("scores", pieces).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "copies", "known", "base", "w")])
    unknown = F.expr("(n_tokens - known) div copies") * F.lit(-float(np.log10(n + v + 1)))
    return source.select("id", row).join(found, "row").select(
        F.col("id").alias(doc_id),
        (fold == held_out).alias("held_out"),
        F.expr("n_tokens div copies").alias("n_tokens"),
        F.expr("known div copies").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies") + unknown).alias("base_score"),
        ((F.col("base") + F.col("w")) / F.col("copies") + unknown).alias("score"),
    )

"""Vectorised text helpers for Arrow batches: words, hashes, windows, and row-wise operators.

Everything here works on one Arrow batch at a time, cut into chunks of bounded text size, so the memory of a
task does not depend on the size of its partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from sentrail.sources.shared import shared_dir, written  # noqa: F401

CHUNK_BYTES = 1 << 20
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_R = 0x9E3779B97F4A7C15 | 1
_K = 0xD1342543DE82EF95 | 1
_MASK = (1 << 64) - 1


def byte_table(member: Callable[[int], bool]) -> np.ndarray:
    """Boolean table over byte values."""
    return np.array([member(b) for b in range(256)], dtype=bool)


#: Bytes of words ``[^\x20\x09-\x0D]+``; all bytes of non-ASCII characters belong to words.
NOT_SPACE = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
ALNUM = byte_table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


class _Powers:
    """base**i and its inverse, modulo 2**64, extended on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, m, 1 << 64))])
                self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inv, m, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(_R), _Powers(_K)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes so that every bit depends on all others."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows in them (a null is empty)."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


class Words:
    """The words of a chunk of rows: byte spans, first word of each row, and hashes on demand."""

    def __init__(self, col: pa.Array, table: np.ndarray = NOT_SPACE, lower: bool = False):
        self.data, self.offs = buffers(col)
        self.lower = lower
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        w = table[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offs] = True
        begin, end = w.copy(), w.copy()
        if n:
            begin[1:] &= ~w[:-1] | edge[1:-1]
            end[:-1] &= ~w[1:] | edge[1:-1]
        self.s = np.flatnonzero(begin)
        self.e = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.s, self.offs)  # first[r]..first[r+1]: the words of row r

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        up, down = _BYTE_POWERS.get(n + 1)
        with np.errstate(over="ignore"):
            c = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.data] * up[:n], out=c[1:])
            return mix((c[self.e] - c[self.s]) * down[self.s])

    def windows(self, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows of ``size`` words that lie in one row."""
        m = len(h) - size + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, down = _WORD_POWERS.get(len(h) + 1)
        with np.errstate(over="ignore"):
            c = np.zeros(len(h) + 1, dtype=np.uint64)
            np.cumsum(h * up[: len(h)], out=c[1:])
            w = mix((c[size:] - c[:-size]) * down[:m])
        last = np.repeat(self.first[1:], self.counts)  # end of the row of each word
        at = np.flatnonzero(np.arange(m) + size <= last[:m])
        return at, w[at]

    def joined(self, a: int, b: int, sep: bytes = b" ") -> bytes:
        """Words a..b-1 joined by one separator."""
        raw = self.data
        return sep.join(raw[i:j].tobytes() for i, j in zip(self.s[a:b], self.e[a:b], strict=True))


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each; a longer row is a slice of its own."""
    col = batch.column(batch.schema.get_field_index(text))
    _, o = buffers(col)
    a = 0
    while a < len(col):
        b = int(np.searchsorted(o, o[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), len(col))
        yield batch.slice(a, b - a)
        a = b


def tidy() -> None:
    """Gives freed memory back at the end of a task: workers live on and serve later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidily(run: Callable) -> Callable:
    """A function over batches that gives freed memory back when it ends."""

    def all_of(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return all_of


def numbered(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns renamed by position (c0, c1, ...), and the new names of some of them.

    Operators add columns of their own beside these, so no name in the input can clash; ``toDF`` gives names back.
    """
    new = [f"c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*new), [new[docs.columns.index(c)] for c in names]


def map_rows(df: DataFrame, fn: Callable, fields: list[StructField], keep: list[str], text: str = "text", also: list[str] = ()) -> DataFrame:
    """Runs ``fn(chunk) -> arrays`` (one per field, one value per row) over chunks of rows, without a shuffle.

    The result has the columns ``keep`` and then ``fields``; ``fn`` also sees ``text`` and the columns ``also``.
    """
    source = df.select(*dict.fromkeys([*keep, text, *also]))
    schema = StructType([source.schema[c] for c in keep] + fields)
    names = schema.names

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                kept = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *fn(part)], names=names)

    return source.mapInArrow(tidily(run), schema)

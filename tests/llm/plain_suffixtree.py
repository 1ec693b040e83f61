"""The suffix tree in memory, in plain form and with a symbol for rare words, for comparison on small corpora."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrail.llm._text import mix, written
from sentrail.llm.suffixtree import _ODD, DEPTH, END_WORD, STRENGTH, TABLE_SHARE, Table, _summed, _word_counts

SHARE, ENTRY_SHARE = 1e-5, 1e-6
RARE = 0  # symbol of all words that have none of their own
_ALL = (1 << 20) - 1  # stands for any next symbol


def context_hash(suffix: np.ndarray | np.uint64, symbol: np.ndarray) -> np.ndarray:
    """Hash of the context that has one more symbol in front of ``suffix`` (0 for the empty one)."""
    with np.errstate(over="ignore"):
        return mix(suffix * _ODD[1] + (symbol + 1).astype(np.uint64) * _ODD[0])


def _entry_hash(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context + (symbol + 1).astype(np.uint64) * _ODD[2])


def contexts(symbols: np.ndarray, first: np.ndarray, depth: int):
    """For each depth: hashes of the contexts of all tokens, and which tokens have one."""
    place = np.arange(len(symbols)) - np.repeat(first[:-1], np.diff(first))
    h = np.zeros(len(symbols), dtype=np.uint64)
    for d in range(1, depth + 1):
        before = np.zeros(len(symbols), dtype=np.int64)
        before[d:] = symbols[:-d]
        h = context_hash(h, before)
        yield h, place >= d


@dataclass
class Level:
    """Contexts of one depth: hashes, totals, mass left to the suffix, and entries (context and next symbol)."""

    context: np.ndarray
    total: np.ndarray
    rest: np.ndarray
    entry: np.ndarray
    count: np.ndarray
    tables: tuple | None = None

    def smooth(self, p: np.ndarray, h: np.ndarray, has: np.ndarray, symbols: np.ndarray, strength: float) -> np.ndarray:
        if self.tables is None:
            self.tables = Table(self.context), Table(self.entry)
        at = np.flatnonzero(has)
        got = self.tables[0].find(h[at])
        at, got = at[got >= 0], got[got >= 0]
        e = self.tables[1].find(_entry_hash(h[at], symbols[at]))
        n = np.where(e >= 0, self.count[e], 0) if len(self.count) else np.zeros(len(at))
        p[at] = (n + (strength + self.rest[got]) * p[at]) / (self.total[got] + strength)
        return p


@dataclass
class Tree:
    """The model: counts, symbols and levels."""

    n: int
    v: int
    word: np.ndarray  # hashes of the words in the table
    word_count: np.ndarray
    symbol: np.ndarray  # hashes of the words with a symbol; symbol k + 1 is the k-th
    share: np.ndarray  # add-one frequency of each symbol, the rare one first
    levels: list[Level] = field(default_factory=list)
    strength: float = STRENGTH
    tables: tuple | None = None

    def __post_init__(self):
        self.tables = None

    def symbols(self, tokens: np.ndarray) -> np.ndarray:
        if self.tables is None:
            self.tables = Table(self.symbol), Table(self.word)
        return self.tables[0].find(tokens) + 1

    def score(self, tokens: np.ndarray, first: np.ndarray):
        """For each row: tokens in the word table, their base score, model score without the base of the words that
        are not in the table; and (row, hash) of those."""
        y = self.symbols(tokens)
        p = self.share[y].copy()
        for level, (h, has) in zip(self.levels, contexts(y, first, len(self.levels)), strict=True):
            p = level.smooth(p, h, has, y, self.strength)
        at = self.tables[1].find(tokens)
        known = at >= 0
        base = np.zeros(len(tokens))
        base[known] = np.log10((self.word_count[at[known]] + 1) / (self.n + self.v + 1))
        model = np.log10(p)
        rare = y == RARE
        model[rare] += base[rare] - np.log10(self.share[RARE])
        start = first[:-1]
        add = lambda x: np.add.reduceat(x, start) if len(start) else np.zeros(0)
        out = np.flatnonzero(~known)
        return add(known.astype(np.int64)), add(base), add(model), np.searchsorted(first, out, side="right") - 1, tokens[out]


def _next_counts(tree, candidates, depth: int):
    """Counts of (candidate, next symbol), and of each candidate with any next symbol."""

    def count(tokens, first):
        y = tree.value.symbols(tokens)
        h, has = list(contexts(y, first, depth))[-1]
        at = np.flatnonzero(has)
        got = candidates.value.find(h[at])
        at, got = at[got >= 0], got[got >= 0]
        key, n = np.unique((got << 20) + y[at], return_counts=True)
        each, total = np.unique(got, return_counts=True)
        return np.append(key, (each << 20) + _ALL), np.append(n, total)

    return count


def _diverges(total: float, counts: np.ndarray, expected: np.ndarray) -> bool:
    """Likelihood-ratio test of next-symbol counts against shares of the suffix; what is in neither is one class."""
    counts, expected = np.append(counts, max(0, total - counts.sum())), np.append(expected, max(1e-12, 1 - expected.sum()))
    some = counts > 0
    g = 2 * (counts[some] * np.log(counts[some] / (total * expected[some]))).sum()
    k = len(counts) - 1
    return g > k + 4 * np.sqrt(2 * k) + 4


def train(docs: DataFrame, *, text: str = "text", depth: int = DEPTH, share: float = SHARE, entry_share: float = ENTRY_SHARE, table_share: float = TABLE_SHARE, strength: float = STRENGTH) -> tuple[Tree, DataFrame]:
    """Grows the tree on the texts of all rows; returns it and the table of all word counts (key, n)."""
    sc = docs.sparkSession.sparkContext
    sc.addPyFile(__file__)  # tasks import this module
    texts = docs.select(F.col(text).alias("text"))
    counts = written(_summed(texts, _word_counts))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    table = counts.where(F.col("n") >= max(1, table_share * n)).toArrow()  # 1 / table_share rows at most
    word, word_count = table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
    often = np.sort(np.flatnonzero(word_count >= max(2, share * n)))
    tree = Tree(n, v, word, word_count, word[often], np.zeros(0), [], strength)
    own = (word_count[often] + 1) / (n + v + 1)
    tree.share = np.append(max(1 / (n + v + 1), 1 - own.sum()), own)
    end = np.flatnonzero(tree.symbol == END_WORD) + 1

    found: list[dict[tuple, dict[int, int]]] = []  # by depth: symbols of a context, nearest first -> next symbol -> count
    totals: list[dict[tuple, int]] = []
    keys = [(s,) for s in range(1, len(tree.symbol) + 1) if s not in end]
    for d in range(1, depth + 1):
        if not keys:
            break
        hashes = _hash_of(keys)
        count = _summed(texts, _next_counts(sc.broadcast(tree), sc.broadcast(Table(hashes)), d))
        rows = count.where(F.col("n") >= max(2, entry_share * n)).toArrow()  # 2 / entry_share rows at most
        entries, total = {k: {} for k in keys}, {}
        for key, m in zip(rows["key"].to_pylist(), rows["n"].to_pylist(), strict=True):
            k, s = keys[key >> 20], key & _ALL
            if s == _ALL:
                total[k] = m
            else:
                entries[k][s] = m
        found.append(entries)
        totals.append(total)
        keys = sorted((s, *k) for k, e in entries.items() for s, m in e.items() if s != RARE and s not in end and m >= max(2, share * n))

    keep: list[set] = [set() for _ in found]
    for d in reversed(range(len(found))):
        for k, entry in found[d].items():
            if k in totals[d] and k not in keep[d]:
                symbols, m = np.array(sorted(entry), dtype=np.int64), totals[d][k]
                c = np.array([entry[s] for s in symbols.tolist()], dtype=float)
                if d:
                    up = found[d - 1].get(k[:-1], {})
                    expected = np.array([(up.get(s, 0) + tree.share[s]) / (totals[d - 1].get(k[:-1], 0) + 1) for s in symbols.tolist()])
                else:
                    expected = tree.share[symbols]
                if _diverges(m, c, expected):
                    for i in range(d + 1):
                        keep[i].add(k[: i + 1])
    for d, kept in enumerate(keep):
        ks = sorted(kept)
        h = _hash_of(ks)
        total = np.array([totals[d].get(k, 0) for k in ks], dtype=float)
        pairs = [(i, s, m) for i, k in enumerate(ks) for s, m in found[d].get(k, {}).items()]
        at, s, m = (np.array(x, dtype=np.int64) for x in (zip(*pairs, strict=True) if pairs else ([], [], [])))
        rest = total - np.bincount(at, weights=m, minlength=len(ks))
        tree.levels.append(Level(h, total, rest, _entry_hash(h[at], s) if len(at) else np.zeros(0, np.uint64), m.astype(float)))
    return tree, counts


def _hash_of(keys: list[tuple]) -> np.ndarray:
    h = np.zeros(len(keys), dtype=np.uint64)
    for d in range(len(keys[0]) if keys else 0):
        h = context_hash(h, np.array([k[d] for k in keys], dtype=np.int64))
    return h

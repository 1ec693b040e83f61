"""Near-duplicates by MinHash with sequential Bayesian verification.

Documents with the same set of word shingles form a class, so copies cost nothing further. Signatures of classes
are banded; classes that share a band are candidates. A candidate pair is compared in batches of signature places:
after each batch the posterior of its similarity (uniform prior) is bounded, and the pair is dropped once the
chance that it reaches the threshold is under ``miss``. Survivors are verified exactly on their full sets.

Pairs within a band are not all tried. Every band has a pivot, the class that shares most bands with others (the
text that the others are copies of, if there is one), and every class meets its heaviest pivot. Pairs within a
component need no comparison, so only bands that still hold several components go on. Their candidates are narrowed
by two bounds that no link can break. Members of a set are ranked from the rarest in these bands to the most common;
if the first member that two sets share has rank i in one of n, they share n - i at most. And one set can't be smaller
than the threshold times the other. So a class is entered under the few members that may come first, once for its
own size and, as the larger of a pair, for the sizes that its rank still allows. Copies with edits of their own rank
those first and meet nobody, however large their group is. Star rounds come first there as well: every class meets
the most central one of another component, as long as at least ``pays`` of the comparisons are links; then all pairs
that are left between components are tried. No link between components is lost.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from sentrail.llm._text import map_rows, mix, NOT_SPACE, tidily, Words, written
from sentrail.operators.components import components

SHINGLE, PERCENT, PLACES, ROWS, BATCH, MISS, PAYS = 5, 75, 128, 4, 16, 1e-6, 0.25
_RNG = np.random.default_rng(99991)
_MULTIPLIERS = _RNG.integers(0, 1 << 31, 1024, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MASKS = _RNG.integers(0, 1 << 32, 1024, dtype=np.uint32)


def shingle_sets(col: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk, and the first one of each row; a shorter text is one shingle."""
    w = Words(col, NOT_SPACE, lower=True)
    h, n = w.hashes(), w.counts
    at, shingle = w.windows(h, size)
    row = np.searchsorted(w.first, at, side="right") - 1
    for k in range(1, size):
        rows = np.flatnonzero(n == k)
        if len(rows):
            at, short = w.windows(h, k)
            whole = short[np.searchsorted(at, w.first[rows])]
            row, shingle = np.append(row, rows), np.append(shingle, mix(whole + np.uint64(k)))
    with np.errstate(over="ignore"):
        key = mix(shingle + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    once = np.sort(np.unique(key, return_index=True)[1])
    row, shingle = row[once], shingle[once]
    order = np.argsort(row, kind="stable")
    return shingle[order], np.searchsorted(row[order], np.arange(len(n) + 1))


def signatures(sets: np.ndarray, first: np.ndarray, places: int) -> np.ndarray:
    """MinHash signatures of the rows that have shingles."""
    start = first[:-1][np.diff(first) > 0]
    out = np.empty((len(start), places), dtype=np.uint32)
    if len(start):
        h = (sets >> np.uint64(32)).astype(np.uint32)
        for k in range(places):
            out[:, k] = np.minimum.reduceat((h ^ _MASKS[k]) * _MULTIPLIERS[k], start)
    return out


def set_keys(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit key of every set that isn't empty; it doesn't depend on the order."""
    size = np.diff(first)
    start = first[:-1][size > 0]
    if not len(start):
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        a = np.add.reduceat(mix(sets), start)
        b = np.add.reduceat(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), start)
        return mix(a ^ mix(b + size[size > 0].astype(np.uint64))).view(np.int64)


def needed_matches(places: int, batch: int, percent: int, miss: float) -> dict[int, int]:
    """Places compared -> least matches with which a pair of that many may still reach the threshold.

    With m of n matches and a uniform prior the similarity is Beta(m + 1, n - m + 1); the chance that it is at
    least t is a binomial tail.
    """
    t = percent / 100
    out = {}
    for n in range(batch, places + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def _describe(places: int, rows: int, size: int, text: str):
    def run(part):
        sets, first = shingle_sets(part.column(part.schema.get_field_index(text)), size)
        n = np.diff(first)
        sig = signatures(sets, first, places)
        full = n > 0
        key = np.zeros(len(n), dtype=np.int64)
        key[full] = set_keys(sets, first)
        raw = np.full(len(n), None, dtype=object)
        raw[full] = [s.tobytes() for s in sig]
        band = np.zeros((len(sig), places // rows), dtype=np.uint64)
        for b in range(places // rows):
            x = np.full(len(sig), b + 1, dtype=np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                x = mix(x + sig[:, k])
            band[:, b] = x
        offs = np.concatenate([[0], np.cumsum(full * (places // rows))])
        bands = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(band.ravel().view(np.int64)))
        return [pa.array(n, pa.int64()), pa.array(key, mask=~full), pa.array(raw, pa.binary()), bands]

    return run


def _likely(places: int, batch: int, percent: int, miss: float):
    """Keeps the pairs that the sequential test doesn't drop."""
    need = needed_matches(places, batch, percent, miss)

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(-1, places) for i in (2, 3))
            live, match = np.arange(b.num_rows), np.zeros(b.num_rows, dtype=np.int64)
            for n, least in need.items():
                match = match + (x[live, n - batch : n] == y[live, n - batch : n]).sum(1)
                ok = match >= least
                live, match = live[ok], match[ok]
            yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(live)) for i in (0, 1)], names=["a", "b"])

    return run


def _exact(percent: int):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            at = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([b.column(i).take(at) for i in (0, 1)], names=["a", "b"])

    return run


def _members(batches):
    """One row for each member of each set."""
    for b in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
        raw = b.column(1)
        n = np.array([len(v.as_buffer()) // 8 for v in raw], dtype=np.int64)
        at = pa.array(np.repeat(np.arange(len(n)), n))
        flat = np.frombuffer(b"".join(raw.to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(flat), pa.array(np.repeat(n, n))], names=["c", "e", "n"])


def _entries(place: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Where the classes of ``place`` may meet: e, k, larger, c, n, low, high.

    e is a member that may be the first shared one, k a step of sizes: a class is in that of its own size, and, as the
    larger of a pair, in those of the sizes from ``low`` to ``high`` that its partners may have.
    """
    whole = 100 + percent
    member = written(sets.join(place.select("c"), "c", "left_semi").select("c", "shingles").mapInArrow(tidily(_members), "c long, e long, n long"))
    often = member.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    ranked = member.join(often, "e", "left").withColumn("i", F.row_number().over(Window.partitionBy("c").orderBy(F.coalesce("df", F.lit(0)), "e")) - 1)
    # rest: what two sets share at most if this is the first member that they share.
    rest, low = F.col("n") - F.col("i"), F.ceil(F.col("n") * percent / 100)
    first = ranked.where(F.col("df").isNotNull() & (whole * rest >= percent * (F.col("n") + low)))
    first = first.select("c", "e", "n", low.alias("low"), F.floor(rest * whole / percent - F.col("n")).alias("high"))
    step = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(1.05)))
    sizes = F.concat(F.array(F.struct(F.lit(False).alias("larger"), step(F.col("n")).alias("k"))), F.transform(F.sequence(step(F.col("low")), step(F.greatest("low", F.least("high", "n")))), lambda k: F.struct(F.lit(True).alias("larger"), k.alias("k"))))
    return written(first.select("e", F.explode(sizes).alias("s"), "c", "n", "low", "high").select("e", "s.k", "s.larger", "c", "n", "low", "high"))


def _open_keys(entry: DataFrame, place: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries with their components, and the keys (e, k) where several meet, with the largest of those."""
    weight = place.groupBy("c_in").agg(F.count("*").alias("size"))
    entry = entry.join(place.join(weight, "c_in"), "c")
    key = entry.groupBy("e", "k").agg(F.min("c_in").alias("x"), F.max("c_in").alias("y"), F.max(F.struct("size", "c_in")).alias("major"), F.count("*").alias("rows")).where("x < y")
    return entry, key.select("e", "k", F.col("major.c_in").alias("major"), "rows")


def _with_pivots(entry: DataFrame, place: DataFrame, used: DataFrame) -> DataFrame:
    """Every class with one pivot, not in ``used``, of another component: a, b, p. One row a class at most.

    The pivot of a key is the class with the fewest rare members of those outside the largest component.
    """
    entry, key = _open_keys(entry, place)
    held = written(entry.join(key, ["e", "k"]))
    pivot = held.where("c_in != major").join(used, "c", "left_anti").groupBy("e", "k").agg(F.max(F.struct((F.col("high") - F.col("n")).alias("slack"), "c", "c_in", "n", "low", "high")).alias("p"))
    met = held.join(pivot, ["e", "k"]).where("c_in != p.c_in and n <= p.high and p.n <= high and n >= p.low and p.n >= low")
    best = met.groupBy("c").agg(F.max(F.struct("p.slack", "p.c")).alias("x"))
    return best.select(F.greatest("c", "x.c").alias("a"), F.least("c", "x.c").alias("b"), F.col("x.c").alias("p")).distinct()


def _pairs(entry: DataFrame, place: DataFrame) -> DataFrame:
    """All pairs (a, b) of classes of different components that may be linked."""
    entry, key = _open_keys(entry, place)
    key = written(key.select("e", "k", "major", F.least(F.lit(32), 1 + F.floor(F.col("rows") / 1000)).cast("int").alias("salts")))
    held = entry.join(key, ["e", "k"])
    # The largest component of a key doesn't meet itself: t = 0 is others against it, t = 1 is all against others.
    is_major = F.col("c_in") == F.col("major")
    a = held.where("larger").select("e", "k", F.explode(F.when(is_major, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("t"), F.pmod(F.xxhash64("c"), F.col("salts")).cast("int").alias("salt"), F.col("c").alias("a"), F.col("c_in").alias("a_in"), F.col("n").alias("a_n"), "low", F.col("high").alias("a_high"))
    b = held.where("not larger").select("e", "k", F.when(is_major, 0).otherwise(1).alias("t"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("c").alias("b"), F.col("c_in").alias("b_in"), F.col("n").alias("b_n"), F.col("high").alias("b_high"))
    found = a.join(b, ["e", "k", "t", "salt"]).where("a_in != b_in and b_n <= a_n and b_n >= low and b_n <= a_high and a_n <= b_high")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _merged(place: DataFrame, links: DataFrame) -> DataFrame:
    """``place`` (c, c_in) with the components that links (a, b) join."""
    ends = [place.select(F.col("c").alias(k), F.col("c_in").alias(f"{k}_in")) for k in ("a", "b")]
    edges = links.join(ends[0], "a").join(ends[1], "b").select(F.col("a_in").alias("a"), F.col("b_in").alias("b"))
    found = components(edges).select(F.col("node").alias("c_in"), "component")
    return written(place.join(found, "c_in", "left").select("c", F.coalesce("component", "c_in").alias("c_in")))


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT, places: int = PLACES, rows: int = ROWS, batch: int = BATCH, miss: float = MISS, pays: float = PAYS, with_tag: bool = False) -> DataFrame:
    """Returns doc_id, n_shingles, component_id, kept for every row, and with ``with_tag`` a hash of its text.

    component_id is the smallest doc_id that links lead to; kept is true where it is the row's own. Null, empty and
    wordless texts have no shingles, are linked with nothing and kept. Repeated rows have equal sets, so they share
    a component and, with their id the smallest, are both kept. Rows with a null id take part; they get the smallest
    other id of their component and are kept only if there is none. Other columns are not read. ``pays`` has no effect
    on results.
    """
    source = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))
    fields = [StructField("n", LongType()), StructField("c", LongType()), StructField("sig", BinaryType()), StructField("bands", ArrayType(LongType()))]
    table = written(map_rows(source, _describe(places, rows, size, "text"), fields, ["id", "tag"]))

    band = table.select("c", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low < high").select("band", "n")
    member = written(band.join(shared, "band").distinct())
    weight = member.groupBy("c").agg((F.sum("n") - F.count("*")).alias("w"))
    pivot = member.join(weight, "c").groupBy("band").agg(F.max(F.struct("w", "c")).alias("p")).select("band", F.col("p.c").alias("p"), F.col("p.w").alias("pw"))
    tried = written(member.join(pivot, "band").groupBy("c").agg(F.max(F.struct("pw", "p")).alias("x")).select("c", F.col("x.p").alias("p")))

    involved = tried.select("c")
    chosen = table.where("c is not null").join(involved, "c", "left_semi").groupBy("c").agg(F.min(F.struct("id", F.hash("sig"))).alias("x")).select("c", F.col("x.id").alias("id"))
    sig = written(table.select("c", "sig").join(involved, "c", "left_semi").groupBy("c").agg(F.any_value("sig").alias("sig")))

    def as_set(part):
        sets, first = shingle_sets(part.column(part.schema.get_field_index("text")), size)
        key = np.zeros(len(first) - 1, dtype=np.int64)
        key[np.diff(first) > 0] = set_keys(sets, first)
        return [pa.array(key), pa.array([sets[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())]

    texts = source.join(chosen, source["id"].eqNullSafe(chosen["id"])).select("c", "text")
    named = map_rows(texts, as_set, [StructField("key", LongType()), StructField("shingles", BinaryType())], ["c"])
    sets = written(named.where("c = key").dropDuplicates(["c"]).select("c", "shingles"))

    def linked(pairs: DataFrame) -> DataFrame:
        def with_both(table: DataFrame, value: str, pairs: DataFrame) -> DataFrame:
            x, y = (table.select(F.col("c").alias(k), F.col(value).alias(f"{value}_{k}")) for k in ("a", "b"))
            return pairs.join(x, "a").join(y, "b").select("a", "b", f"{value}_a", f"{value}_b")

        likely = with_both(sig, "sig", pairs).mapInArrow(tidily(_likely(places, batch, percent, miss)), "a long, b long")
        return with_both(sets, "shingles", written(likely)).mapInArrow(tidily(_exact(percent)), "a long, b long")

    place = tried.select("c", F.col("c").alias("c_in"))
    place = _merged(place, written(linked(tried.where("c != p").select(F.col("c").alias("a"), F.col("p").alias("b")))))
    held = member.select("band", "c").join(place, "c")
    several = held.groupBy("band").agg(F.min("c_in").alias("x"), F.max("c_in").alias("y")).where("x < y").select("band")
    entry = _entries(held.join(several, "band").select("c").distinct(), sets, percent)
    used = tried.select(F.col("p").alias("c")).distinct()
    while True:
        stars = written(_with_pivots(entry, place, used))
        links = written(linked(stars.select("a", "b")))
        place = _merged(place, links)
        used = written(used.unionByName(stars.select(F.col("p").alias("c"))).distinct())
        if links.count() <= pays * stars.count():  # every round that goes on joins components, so it ends
            break
    found = _merged(place, written(linked(written(_pairs(entry, place)))))

    rowsof = table.select("id", "tag", "n", "c")
    labels = rowsof.where("c is not null").groupBy("c").agg(F.min("id").alias("least")).join(found, "c", "left").select("c", "least", F.coalesce("c_in", "c").alias("component"))
    least = labels.groupBy("component").agg(F.min("least").alias("least"))
    of_class = labels.select("c", "component").join(least, "component").select("c", F.col("least").alias("component_id"))
    done = rowsof.join(of_class, "c", "left").withColumn("component_id", F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component_id")))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return done.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), *["tag"] * with_tag)


def deduplicate(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with all their columns; repeated rows of one of them all stay.

    Rows are carried as one struct, so columns of any name are kept as they are.
    """
    gone = near_duplicates(docs, text=text, doc_id=doc_id, with_tag=True, **how).where(~F.col("kept"))
    gone = gone.select(F.struct(F.col(doc_id).alias("id"), "tag").alias("gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("tag")).alias("own"))
    return rows.join(gone, F.col("own") == F.col("gone"), "left_anti").select("row.*")

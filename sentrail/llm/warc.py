"""WARC archives of pages and a two-level capture index over them.

Tasks write gzip-compressed records, one member each, into archives in the shared folder. Of equal payloads one record
is the response, all others revisit it. The index sorts the captures by reversed host and path over range partitions;
each partition writes its lines as compressed blocks and a sparse directory with one entry for each block, and one row
for each partition forms the root. A search goes down by bisection: the root names the partition, its directory the
block, the block the place of the record, which is then read by its range alone. The root has as many rows as there are
partitions, whatever the number of pages; directories and blocks are read where they are needed.

Files are named after the attempt of their task, and only those of accepted attempts are in the tables, so repeated and
lost attempts clash with nothing. The shared folder must be one that pyarrow can open.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrail.llm._text import chunks, numbered, shared_dir, tidily, written

LEAST = 0  # bytes of a payload that may be revisited
ROLL = 1 << 30  # bytes of an archive after which a task begins another
BLOCK_LINES, BLOCK_BYTES = 3000, 1 << 18
READ_AHEAD = 1 << 22  # bytes of neighbouring records that are read at once
READ_TASK = 1 << 25  # bytes of records for a task to read
DATE = "2024-01-01T00:00:00Z"
_PLACE = "skey string, cid string, file string, offset long, length long"


def capture_key(url: Column) -> Column:
    """Host labels from the last to the first, joined by commas, then the port, ``)`` and path with query.

    A-Z of the host are lower-cased; user names and fragments go. A url without ``://`` has an empty host and is kept
    whole after ``)``; a null url gives ``)``.
    """
    url = F.coalesce(url, F.lit(""))
    start = F.instr(url, "://")
    rest = F.substring_index(url.substr(start + 3, F.char_length(url)), "#", 1)
    site = F.regexp_extract(rest, "^([^/?]*)", 1)
    host = F.translate(F.element_at(F.split(site, "@"), -1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    port = F.regexp_extract(host, "(:[0-9]*)$", 1)
    labels = F.split(F.regexp_replace(host, ":[0-9]*$", ""), "\\.")
    surt = F.concat(F.array_join(F.reverse(labels), ","), port, F.lit(")"), rest.substr(F.char_length(site) + 1, F.char_length(rest)))
    return F.when(start > 0, surt).otherwise(F.concat(F.lit(")"), url))


def payload_digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(page_id: str, url: str, raw: bytes, digest: str, refers_to: str | None, refers_url: str | None, date: str) -> bytes:
    """One WARC record as a gzip member; a revisit has the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(raw)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {_line(refers_url or '')}"]
    body = http + (raw if refers_to is None else b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def _line(text: str) -> str:
    """A header value: line breaks and per cents are escaped, so that headers stay one line each."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def parse(packed: bytes) -> dict:
    """Fields of a packed record; ``payload`` is null for a revisit. Raises if lengths or the digest don't hold."""
    data = zlib.decompressobj(31).decompress(packed)
    top, _, rest = data.partition(b"\r\n\r\n")
    head = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
    body = rest[: int(head["Content-Length"])]
    if len(rest) != len(body) + 4 or len(body) != int(head["Content-Length"]):
        raise ValueError("a record's length does not hold")
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    ident = lambda x: None if x is None else x[len("<urn:page:") : -1]
    revisit = head["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("a record's payload does not have its digest")
    return {
        "record_type": head["WARC-Type"], "cid": ident(head["WARC-Record-ID"]), "url": _unline(head["WARC-Target-URI"]), "payload_bytes": size, "payload_digest": digest,
        "refers_to": ident(head.get("WARC-Refers-To")), "refers_url": _unline(head["WARC-Refers-To-Target-URI"]) if revisit else None, "payload": None if revisit else payload,
    }


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Appender:
    """A file of this task's attempt, begun anew when it is long."""

    def __init__(self, folder: str, kind: str):
        where = TaskContext.get()
        self.folder, self.stem = folder, f"part-{where.partitionId():06d}-{where.taskAttemptId()}"
        self.kind, self.count, self.out, self.name, self.size = kind, 0, None, "", 0

    def add(self, raw: bytes) -> tuple[str, int, int]:
        if self.out is None or self.size >= ROLL:
            self.close()
            store, base = _store(self.folder)
            store.create_dir(base, recursive=True)
            self.name, self.size = f"{self.stem}-{self.count}.{self.kind}", 0
            self.out = store.open_output_stream(f"{base}/{self.name}", compression=None)
            self.count += 1
        at = self.size
        self.out.write(raw)
        self.size += len(raw)
        return self.name, at, len(raw)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_archives(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, folder: str | None = None, date: str = DATE) -> tuple[str, DataFrame]:
    """Writes one record for each row of ``pages`` into archives in ``folder``.

    Payload is the html in UTF-8, a null one is empty. Of records with equal payloads (length and SHA-1) of at least
    ``least`` bytes those with the largest page_id are responses (rows that repeat both are all responses, as a record
    can't revisit itself), all others revisit it; a null page_id is smaller than any and is written as an empty id.
    Other columns are not read. Returns the folder and the place of every record: skey, cid (page_id as text), file,
    offset, length.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows, (the_id, the_url, the_html) = numbered(pages, page_id, url, html)
    raw = F.encode(F.coalesce(F.col(the_html), F.lit("")), "UTF-8")
    rows = rows.select(F.col(the_id).alias("id"), F.coalesce(F.col(the_url), F.lit("")).alias("url"), raw.alias("raw"))
    rows = rows.withColumn("sha", F.sha1("raw")).withColumn("bytes", F.octet_length("raw"))
    groups = rows.where(F.col("bytes") >= least).select("id", "url", "sha", "bytes").groupBy("sha", "bytes").agg(F.count("*").alias("n"), F.max(F.struct("id", "url")).alias("best"))
    shared = written(groups.where("n > 1").select("sha", "bytes", F.col("best.id").alias("best_id"), F.col("best.url").alias("best_url")))
    typed = rows.join(shared, ["sha", "bytes"], "left")  # both sides come straight from tables, so that Spark splits a hot payload
    again = F.col("best_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("best_id"))
    ready = typed.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("cid"), "url", capture_key(F.col("url")).alias("skey"), "raw", F.unhex("sha").alias("sha"),
        F.when(again, F.col("best_id").cast("string")).alias("best"), F.when(again, F.col("best_url")).alias("best_url"),
    )

    def run(batches):
        out = _Appender(folder, "warc.gz")
        try:
            for batch in batches:
                for part in chunks(batch, "raw", 1 << 23):
                    places = []
                    for cid, link, raw, sha, best, best_url in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("cid", "url", "raw", "sha", "best", "best_url")), strict=True):
                        places.append(out.add(record(cid, link, raw, base64.b32encode(sha).decode(), best, best_url, date)))
                    keys = [part.column(part.schema.get_field_index(c)) for c in ("skey", "cid")]
                    yield pa.RecordBatch.from_arrays([*keys, *(pa.array(x) for x in zip(*places, strict=True))], names=["skey", "cid", "file", "offset", "length"])
        finally:
            out.close()

    return folder, written(ready.mapInArrow(tidily(run), _PLACE))


@dataclass(frozen=True)
class CaptureIndex:
    """Folder of the index and its root: first key, directory file, place of the directory, of each partition in order."""

    folder: str
    archives: str
    root: tuple[tuple[tuple[str, str], str, int, int], ...]


def build_index(places: DataFrame, archives: str, *, folder: str | None = None, lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sorts captures (skey, cid, file, offset, length) into compressed blocks with sparse directories.

    The root comes to the driver: one row for each range partition that isn't empty.
    """
    spark = places.sparkSession
    folder = folder or f"{shared_dir(spark)}/captures-{uuid.uuid4().hex}"

    def run(batches):
        blocks, tables = _Appender(folder, "blocks"), _Appender(folder, "directory")
        entries, held, size = [], [], 0

        def flush():
            text = "\n".join(json.dumps(x) for x in held).encode()
            entries.append([held[0][:2], held[-1][:2], *blocks.add(zlib.compress(text, 6))])

        try:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.append(row)
                    size += len(row[0])
                    if len(held) >= lines or size >= BLOCK_BYTES:
                        flush()
                        held, size = [], 0
            if held:
                flush()
            if entries:
                place = tables.add(zlib.compress(json.dumps(entries).encode(), 6))
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*entries[0][0], *place)], names=["skey", "cid", "file", "offset", "length"])
        finally:
            blocks.close()
            tables.close()

    order = places.select("skey", "cid", "file", "offset", "length").repartitionByRange("skey", "cid").sortWithinPartitions("skey", "cid", "file", "offset")
    found = written(order.mapInArrow(tidily(run), _PLACE)).orderBy("skey", "cid").collect()
    return CaptureIndex(folder, archives, tuple(((r.skey, r.cid), r.file, r.offset, r.length) for r in found))


class _Searcher:
    """Searches of one task, whose last directory and last block stay at hand."""

    def __init__(self, index: CaptureIndex):
        self.index = index
        self.firsts = [x[0] for x in index.root]
        self.store, self.base = _store(index.folder)
        self.directory = functools.lru_cache(maxsize=2)(self._directory)
        self.block = functools.lru_cache(maxsize=2)(self._block)

    def _read(self, file: str, offset: int, length: int) -> bytes:
        with self.store.open_input_file(f"{self.base}/{file}") as f:
            return zlib.decompress(f.read_at(length, offset))

    def _directory(self, part: int) -> tuple[list, list]:
        entries = json.loads(self._read(*self.index.root[part][1:]))
        return [tuple(e[0]) for e in entries], entries

    def _block(self, file: str, offset: int, length: int) -> tuple[list, list]:
        rows = [json.loads(x) for x in self._read(file, offset, length).split(b"\n")]
        return [tuple(r[:2]) for r in rows], rows

    def find(self, skey: str, cid: str | None) -> Iterator[list]:
        """All captures of a key, or of a key and an id, in order. They may span blocks and partitions."""
        low = (skey, cid or "")
        fits = (lambda k: k == low) if cid is not None else (lambda k: k[0] == skey)
        part = max(bisect.bisect_left(self.firsts, low) - 1, 0)
        while part < len(self.firsts):
            firsts, entries = self.directory(part)
            if part and firsts[0] > low and not fits(firsts[0]):
                return
            b = max(bisect.bisect_left(firsts, low) - 1, 0)
            while b < len(firsts):
                keys, rows = self.block(*entries[b][2:])
                i = bisect.bisect_left(keys, low)
                while i < len(keys) and fits(keys[i]):
                    yield rows[i]
                    i += 1
                if i < len(keys):
                    return
                b += 1
            part += 1


def search(index: CaptureIndex, queries: DataFrame) -> DataFrame:
    """Places of the captures that queries (skey, cid) name; a null cid asks for all captures of the key.

    Queries are sorted by key over range partitions, so that a task reads each directory and block of its range once;
    equal queries are answered once. A key that was not captured gives no row.
    """

    def run(batches):
        if not index.root:
            return
        searcher, last = _Searcher(index), None
        for batch in batches:
            found = []
            for query in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if query != last:
                    found += searcher.find(*query)
                    last = query
                if len(found) >= BLOCK_LINES:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=["skey", "cid", "file", "offset", "length"])
                    found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=["skey", "cid", "file", "offset", "length"])

    return queries.where("skey is not null").select("skey", "cid").repartitionByRange("skey", "cid").sortWithinPartitions("skey", "cid").mapInArrow(tidily(run), _PLACE)


def read_records(index: CaptureIndex, places: DataFrame, payloads: bool = False) -> DataFrame:
    """Reads records by their ranges, neighbours of one archive together, and checks lengths and digests.

    ``places`` should be a written table, as it is read twice. Rows are few bytes each, records many; so tasks are made by
    the bytes of the records.
    """
    tasks = -(-(places.agg(F.sum("length")).first()[0] or 1) // READ_TASK)
    schema = "cid string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, refers_url string" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]
    folder = index.archives

    def run(batches):
        store, base = _store(folder)
        open_name, handle = None, None
        try:
            for batch in batches:
                rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
                a = 0
                while a < len(rows):
                    b, (file, start, length) = a + 1, rows[a]
                    end = start + length
                    while b < len(rows) and rows[b][0] == file and start <= rows[b][1] <= end and rows[b][1] + rows[b][2] - start <= READ_AHEAD:
                        end = max(end, rows[b][1] + rows[b][2])
                        b += 1
                    if file != open_name:
                        if handle is not None:
                            handle.close()
                        handle, open_name = store.open_input_file(f"{base}/{file}"), file
                    data = handle.read_at(end - start, start)
                    found = [parse(data[o - start : o - start + n]) for _, o, n in rows[a:b]]
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], k) for c, k in zip(names, kinds, strict=True)], names=names)
                    a = b
        finally:
            if handle is not None:
                handle.close()

    return places.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(tidily(run), schema)


def payloads(index: CaptureIndex, queries: DataFrame) -> DataFrame:
    """Url, cid and full payload of the queried captures (skey, cid); revisits are followed through the index.

    Each response that revisits refer to is looked up and read once, however many refer to it; the join is of written
    tables, so that Spark splits a response that very many refer to.
    """
    records = written(read_records(index, written(search(index, queries)), payloads=True))
    revisits = records.where("record_type = 'revisit'").select("cid", "url", "refers_to", "refers_url")
    asked = revisits.select(capture_key(F.col("refers_url")).alias("skey"), F.col("refers_to").alias("cid")).distinct()
    found = written(read_records(index, written(search(index, asked)), payloads=True).where("record_type = 'response'").select("cid", "url", "payload").dropDuplicates(["cid", "url"]))
    followed = revisits.join(found.select(F.col("cid").alias("refers_to"), F.col("url").alias("refers_url"), "payload"), ["refers_to", "refers_url"])
    return records.where("record_type = 'response'").select("cid", "url", "payload").unionByName(followed.select("cid", "url", "payload"))


def round_trip(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """Archives all pages, indexes the captures, and reads each page's record back through the index.

    Returns page_id, payload_bytes, payload_digest (base32 of SHA-1), record_type and refers_to for each row, as the
    archives have them. Empty tables give no rows.
    """
    archives, places = write_archives(pages, page_id=page_id, url=url, html=html, least=least)
    index = build_index(places, archives)
    rows, (the_id, the_url) = numbered(pages, page_id, url)
    kind = rows.schema[the_id].dataType
    queries = rows.select(capture_key(F.col(the_url)).alias("skey"), F.coalesce(F.col(the_id).cast("string"), F.lit("")).alias("cid"))
    found = read_records(index, written(search(index, queries)))
    as_id = lambda c: F.when(F.col(c) != "", F.col(c).cast(kind))
    return found.select(as_id("cid").alias(page_id), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"))

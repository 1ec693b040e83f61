"""Packing by power-of-two decomposition.

A document of n tokens becomes n // 1024 pieces of 1024 tokens and, for the rest, one piece for each binary digit
of its length, longest first. Each piece is a sequence of its own in the bucket of its length, so batches have
equal lengths, nothing is padded and no sequence crosses documents.

Pieces are cut where the documents are read and written once; sequences are then numbered by a running count over
the (length, task) totals, so no task ever sees more rows than there are tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from sentrail.llm._text import chunks, tidily, written
from sentrail.llm._tokens import encoder, vocabulary

LONGEST = 1024
END = 0


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def cut_pieces(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", longest: int = LONGEST, end: int = END, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: the document, start, length, ids_crc32, doc_tokens, [ids], task and place."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    path = path or vocabulary()
    source = docs.select(doc_id, text)
    fields = [StructField(c, LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    fields += [StructField("ids", ArrayType(IntegerType()))] * with_ids + [StructField("task", LongType()), StructField("place", LongType())]
    schema = StructType([StructField("doc_id", source.schema[doc_id].dataType), *fields])

    def run(batches):
        task, seen, enc = TaskContext.get().partitionId(), {}, encoder(path)
        for batch in batches:
            for part in chunks(batch, text):
                row, start, length, crc, total, ids, place = [], [], [], [], [], [], []
                for r, value in enumerate(part.column(part.schema.get_field_index(text)).to_pylist()):
                    tokens = np.append(enc.ids(value).astype("<u4"), np.uint32(end))
                    view, at = memoryview(tokens), 0
                    for k in piece_lengths(len(tokens), longest):
                        row.append(r)
                        start.append(at)
                        length.append(k)
                        crc.append(zlib.crc32(view[at : at + k]))
                        total.append(len(tokens))
                        place.append(seen.get(k, 0))
                        seen[k] = place[-1] + 1
                        if with_ids:
                            ids.append(tokens[at : at + k].astype(np.int32))
                        at += k
                key = part.column(part.schema.get_field_index(doc_id)).take(pa.array(row, pa.int64()))
                longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                more = [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([key, *longs, *more, pa.array([task] * len(row), pa.int64()), pa.array(place, pa.int64())], names=schema.names)

    return source.mapInArrow(tidily(run), schema)


def pack(docs: DataFrame, **how) -> DataFrame:
    """Packs all documents; returns one row for each piece with its sequence_id and its offset there (always 0).

    A null text counts as empty and is packed as its end token. A null doc_id is carried through; repeated rows are
    packed each. Empty tables give an empty result. Only the id and text columns are read, so others cannot clash.
    ``with_ids`` adds the token ids. Sequence ids are unique; those of one length differ by multiples of the number
    of lengths.
    """
    longest = how.get("longest", LONGEST)
    pieces = written(cut_pieces(docs, **how))
    totals = pieces.groupBy("length", "task").agg((F.max("place") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    lengths = longest.bit_length()
    number = (F.col("base") + F.col("place")) * lengths + F.log2("length").cast("int")
    return pieces.join(base, ["length", "task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if how.get("with_ids") else []), number.cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )

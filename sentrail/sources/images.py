"""Image files: which of them are taken in, and lines of text from the words that a reader found in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The largest file, types that are taken, and how files of images begin.
MOST_BYTES = 8 * 1024 * 1024
TYPES = ["image/png", "image/jpeg", "image/jpg", "image/webp", "image/bmp"]
MAGIC = ["89504E470D0A1A0A", "FFD8FF", "424D", "474946383761", "474946383961"]
LOW_CONFIDENCE = 60
_BY_NAME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "bmp": "image/bmp", "gif": "image/gif"}


def refusal(content_type: Column, content: Column, length: Column | None = None) -> Column:
    """Why a file is refused: empty, too large, unsupported type or not an image; null if it isn't.

    The type's parameters and letter case don't count; a renamed file is found by its first bytes.
    """
    size = F.octet_length(content) if length is None else length
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    head = F.hex(F.substring(content, 1, 13))
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250") & (F.length(head) > 24)
    image = reduce(lambda a, b: a | b, [head.startswith(m) for m in MAGIC]) | webp
    return F.when(F.coalesce(size, F.lit(0)) <= 0, "empty").when(size > MOST_BYTES, "too large").when(~kind.isin(TYPES), "unsupported type").when(~F.coalesce(image, F.lit(False)), "not an image")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, reason) of the files under ``path``; the type is that of the name's ending.

    Contents of files over the limit are not read: their lengths are known from the listing. Files of no bytes are not in
    what Spark lists, so they give no row.
    """
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    small, large = source.load(path).where(F.col("length") <= MOST_BYTES), source.load(path).where(F.col("length") > MOST_BYTES)
    ending = F.lower(F.element_at(F.split("path", r"\."), -1))
    kind = F.create_map(*[F.lit(x) for e in _BY_NAME.items() for x in e])[ending]
    taken = small.select("path", "length", "content", refusal(kind, F.col("content"), F.col("length")).alias("reason"))
    return taken.unionByName(large.select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit("too large").alias("reason")))


def lines_of(words: DataFrame) -> DataFrame:
    """(image_id, text, n_words, mean_confidence, low) from words that were read.

    words: image_id, block, par, line, word_no, word, conf. Blank words and those of a null or negative confidence are
    dropped. Words of a line are joined by spaces in order of word_no (equal ones in order of the words), lines by line
    breaks in order of block, paragraph and line. An image without words has an empty text and confidence 0.
    """
    bare = F.btrim("word", F.lit(" \t\r\n\x0b\x0c"))
    rows = words.select("image_id", "block", "par", "line", "word_no", bare.alias("word"), F.col("conf").cast("double").alias("conf"))
    good = (F.col("word") != "") & (F.col("conf") >= 0)
    counted = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    inner = counted.groupBy("image_id", "block", "par", "line").agg(
        F.array_sort(F.collect_list(F.when(F.col("good"), F.struct("word_no", "word")))).alias("ws"), F.count_if("good").alias("n"), F.sum(F.when(F.col("good"), F.col("conf"))).alias("sum")
    )
    line = F.struct("block", "par", "line", F.array_join(F.transform("ws", lambda w: w["word"]), " ").alias("text"))
    found = inner.groupBy("image_id").agg(F.array_sort(F.collect_list(F.when(F.col("n") > 0, line))).alias("ls"), F.sum("n").alias("n_words"), F.sum("sum").alias("sum"))
    mean = F.when(F.col("n_words") > 0, F.col("sum") / F.col("n_words")).otherwise(F.lit(0.0))
    return found.select("image_id", F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("text"), "n_words", mean.alias("mean_confidence"), (mean < LOW_CONFIDENCE).alias("low"))

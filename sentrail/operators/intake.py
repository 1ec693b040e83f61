"""Intake: checks with a reason for each refused row, and one message table of all kinds of input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrail.operators.entities import host_of

# Limits and refused schemes.
MOST_TEXT, LEAST_URL, MOST_URL = 8000, 3, 2048
REFUSED_SCHEMES = ["javascript:", "data:", "file:", "vbscript:"]
BLANK = r"^[\s\x0B\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x0B\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, BLANK, "")


def text_reason(text: Column) -> Column:
    """Why a text is refused, null if it isn't."""
    return F.when(text.isNull() | (strip(text) == ""), "empty").when(F.char_length(text) > MOST_TEXT, "too long")


def url_reason(url: Column) -> Column:
    """Why a url is refused, null if it isn't."""
    bare = strip(url)
    length = F.char_length(url)
    return (
        F.when(url.isNull() | (length < LEAST_URL), "too short")
        .when(length > MOST_URL, "too long")
        .when(reduce(lambda a, b: a | b, [F.lower(bare).startswith(s) for s in REFUSED_SCHEMES]), "unsupported scheme")
        .when(~F.contains(host_of(bare), F.lit(".")), "no host")
    )


def checked(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, refused rows with ``reason``). A column of that name is replaced in the refused ones."""
    return df.where(reason.isNull()), df.where(reason.isNotNull()).withColumn("reason", reason)


def unified(texts: DataFrame, urls: DataFrame, images: DataFrame, codes: DataFrame) -> DataFrame:
    """One message table: id, input_type, text, extra_urls, corrected, needs_input.

    texts: id, text. urls: id, url, context. images: id, ocr, override, payloads. codes: id, payloads. A user's own text
    comes before that read from an image, and a url that was found in one stands in for a text. Rows with neither
    need input and have a null text. Nulls and blanks are no text; payloads that are null or empty are none.
    """
    filled = lambda c: F.when(strip(c) != "", strip(c))
    none = F.array().cast("array<string>")
    listed = F.coalesce("payloads", none)
    links = F.filter(listed, lambda p: F.lower(p).rlike(r"^(https?://|www\.)"))
    row = lambda df, kind, text, extra, corrected=F.lit(False): df.select("id", F.lit(kind).alias("input_type"), text.alias("text"), extra.alias("extra_urls"), corrected.alias("corrected"))
    url = filled(F.col("url"))
    own = filled(F.col("override"))
    parts = [
        row(texts, "text", filled(F.col("text")), none),
        row(urls, "url", F.concat_ws("\n", filled(F.col("context")), url), F.array_compact(F.array(url))),
        row(images, "image", F.coalesce(own, F.when(F.col("ocr") != "", F.col("ocr")), F.get(links, F.lit(0))), F.array_distinct(links), own.isNotNull()),
        row(codes, "qr", F.array_join(listed, "\n"), F.array_distinct(links)),
    ]
    df = reduce(DataFrame.unionByName, parts).withColumn("text", F.when(F.col("text") != "", F.col("text")))
    return df.withColumn("needs_input", F.col("text").isNull())


def payload_kind(payload: Column) -> Column:
    """url, upi or text: what a code holds."""
    low = F.lower(payload)
    return F.when(low.rlike(r"^(https?://|www\.)"), "url").when(low.startswith("upi://"), "upi").when(payload.isNotNull(), "text")

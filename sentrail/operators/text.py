"""Message text: normalisation, folding, language, fingerprints, redaction. All native columns but NFC."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sentrail.functions import fixed
from sentrail.operators import matcher

MARK = "\u0001"
# What must survive normalisation byte for byte (links, addresses, payment handles, long numbers).
PROTECTED = [
    r"https?://\S+",
    r"\bwww\.\S+",
    r"\b[\w.+-]+@[\w-]+\.[\w.]+\b",
    r"\b[\w.\-]{2,}@(?:upi|ybl|okaxis|oksbi|okhdfcbank|okicici|paytm|apl|ibl|axl|fbl)\b",
    r"\+?\d[\d\-\s]{6,}\d",
]
PROTECT = "(?i)" + "|".join(PROTECTED)
WORD = r"[a-z஀-௿]{3,}"
VOLATILE = r"(?i)\d+|https?://\S+|www\.\S+"


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


def nfc(text: Column) -> Column:
    """Unicode NFC; only texts with other than ASCII characters reach Python."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), _nfc(F.when(text.rlike("[^\\x00-\\x7F]"), text))).otherwise(text)


def protect(text: Column) -> tuple[Column, Column]:
    """The text with a mark for every protected span, and the spans in order."""
    return F.regexp_replace(text, F.lit(PROTECT), F.lit(MARK)), F.regexp_extract_all(text, F.lit(PROTECT), F.lit(0))


def restore(masked: Column, spans: Column) -> Column:
    """Puts the spans back for the marks."""
    parts = F.split(masked, MARK, -1)
    filled = F.zip_with(parts, spans, lambda p, s: F.concat(F.coalesce(p, F.lit("")), F.coalesce(s, F.lit(""))))
    return F.array_join(filled, "")


def collapse_elongation(text: Column) -> Column:
    """Three or more of a letter become two."""
    return F.regexp_replace(text, r"(\p{L})\1{2,}", "$1$1")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\t\\u00A0]+", " ")


def normalize(text: Column) -> Column:
    """Elongations and spaces collapsed outside of protected spans, and trimmed."""
    masked, spans = protect(text)
    return F.btrim(restore(collapse_spaces(collapse_elongation(masked)), spans), F.lit(" \t\r\n "))


def tanglish_pattern(source: str) -> str:
    return "(?i)" + (re.escape(source).replace("\\ ", " ") if " " in source else rf"\b{re.escape(source)}\b")


def longest_first(words) -> list[str]:
    return sorted(words, key=len, reverse=True)


def fold_tanglish(lower: Column) -> Column:
    """Romanised Tamil in a lower-case text becomes its English concept, longest entries first."""
    return matcher.folded(lower, tamil=False)["text"]


def fold_tamil(text: Column) -> Column:
    """Each Tamil entry gets its concept behind it, in order of the list; texts without Tamil stay in the JVM."""
    tamil = text.rlike("[\\u0B80-\\u0BFF]")
    return F.when(tamil, matcher.folded(F.when(tamil, text), tanglish=False)["text"]).otherwise(text)


def fold_audit(text: Column) -> Column:
    """Struct of ``text``, the lower-case analysis text with concepts in it, and ``replaced`` (source, target, kind).

    Protected spans stay as they are.
    """
    masked, spans = protect(text)
    done = matcher.folded(F.lower(masked))
    whole = F.btrim(F.regexp_replace(restore(done["text"], spans), r"\s{2,}", " "), F.lit(" \t\r\n"))
    return F.struct(whole.alias("text"), done["replaced"].alias("replaced"))


def fold(text: Column) -> Column:
    """The analysis text of ``fold_audit`` alone."""
    return fold_audit(text)["text"]


def tanglish_hits(text: Column) -> Column:
    """Entries of the romanised list that occur in the text, longest first."""
    return matcher.tanglish_entries(text)


def script_counts(text: Column) -> Column:
    """Letters, Tamil characters and Latin letters."""
    # What is left without runs of other characters; counting matches makes a string of each.
    count = lambda p: F.char_length(F.regexp_replace(text, p, "")).cast("int")
    return F.struct(count(r"\P{L}+").alias("letters"), count(r"[^\x{0B80}-\x{0BFF}]+").alias("tamil"), count("[^A-Za-z]+").alias("latin"))


def language(messages: DataFrame, text: str = "text") -> DataFrame:
    """Adds letters, tamil, latin, english_share, tanglish (hits), language, language_label, code_switched and
    language_confidence. A null or blank text is undetermined."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z']+"), F.lit(0))
    df = messages.withColumns({"_script": script_counts(F.col(text)), "tanglish": tanglish_hits(F.col(text)), "_words": words})
    english = F.size(F.filter("_words", lambda w: w.isin(list(fixed.ENGLISH_STOPWORDS))))
    df = df.withColumns(
        {
            "letters": F.col("_script.letters"),
            "tamil": F.col("_script.tamil"),
            "latin": F.col("_script.latin"),
            "english_share": F.when(F.size("_words") > 0, english / F.size("_words")).otherwise(F.lit(0.0)),
        }
    ).drop("_script", "_words")
    total = F.greatest("letters", F.lit(1))
    tamil_share, latin_share, hits = F.col("tamil") / total, F.col("latin") / total, F.size("tanglish")
    blank = F.col(text).isNull() | (F.btrim(F.col(text), F.lit(" \t\r\n")) == "")
    ladder = [
        (blank, "und", "Undetermined", F.lit(0.0), F.lit(False)),
        ((tamil_share >= 0.6) & (latin_share < 0.15), "ta", "Tamil", F.lit(0.95), (hits > 0) | (latin_share > 0.05)),
        ((F.col("tamil") > 0) & (F.col("latin") > 0), "ta-en", "Tanglish (Tamil-English code-switch)", F.lit(0.9), F.lit(True)),
        ((hits > 0) & ((F.col("english_share") < 0.55) | (hits >= 2)), "ta-en", "Tanglish (romanized Tamil)", F.least(F.lit(0.9), 0.55 + 0.1 * hits), F.lit(True)),
        (F.col("latin") > 0, "en", "English", F.when(F.col("english_share") > 0.2, F.lit(0.8)).otherwise(F.lit(0.6)), F.lit(False)),
    ]

    def pick(i: int, last: Column) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return reduce(lambda rest, step: F.when(step[0], lit(step[i])).otherwise(rest), reversed(ladder), last)

    return df.withColumns(
        {
            "language": pick(1, F.lit("und")),
            "language_label": pick(2, F.lit("Undetermined")),
            "language_confidence": F.round(pick(3, F.lit(0.3)), 2),
            "code_switched": pick(4, F.lit(False)),
        }
    )


def template_words(text: Column) -> Column:
    """Words of the text without its digits and links."""
    skeleton = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(VOLATILE), F.lit(" "))
    return F.regexp_extract_all(skeleton, F.lit(WORD), F.lit(0))


def fingerprint(text: Column) -> Column:
    """Hash of the sorted distinct template words: equal for messages that differ in digits and links."""
    words = F.array_sort(F.array_distinct(template_words(text)))
    return F.substring(F.sha2(F.array_join(words, " "), 256), 1, 32)


def skeleton(text: Column) -> Column:
    """The text with 0 for the digits from 1 to 8, which no pattern or word for language, folding or signals names by itself.

    So texts of one skeleton have the same language and the same signals at the same places, and signals that show no 0
    show the same.
    """
    return F.translate(text, "12345678", "0" * 8)


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct runs of n template words; the distinct words of a shorter text."""
    words = template_words(text)
    run = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.transform(F.array(words), lambda w: F.array_distinct(F.when(F.size(w) < n, w).otherwise(run(w))))[0]


def jaccard(a: Column, b: Column) -> Column:
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def redact(text: Column, length: int = 180) -> Column:
    """Masks phone numbers, addresses and long digit runs, then cuts the text."""
    out = F.regexp_replace(text, r"(?<!\d)([6-9]\d{2})\d{5}(\d{2})(?!\d)", "$1*****$2")
    out = F.regexp_replace(out, r"\b([A-Za-z0-9._%+-]{2})[A-Za-z0-9._%+-]*@", "$1***@")
    out = F.regexp_replace(out, r"\b(\d{4})\d{4,11}(\d{2})\b", "$1****$2")
    return F.when(F.char_length(out) > length, F.concat(F.substring(out, 1, length), F.lit("…"))).otherwise(out)


def evidence_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def evidence_span(original: Column, folded: Column, pattern: str) -> Column:
    """What a pattern matched: the fragment as it stands in the original, else the folded text around it."""
    fragment = F.regexp_extract(folded, "(?i)" + pattern, 0)
    at = F.instr(F.lower(original), F.lower(fragment))
    where = F.instr(folded, fragment)
    begin = F.greatest(F.lit(1), where - 24)
    window = F.btrim(F.substr(folded, begin, where + F.char_length(fragment) + 24 - begin))
    return F.when(fragment == "", F.lit(None)).when(at > 0, F.substr(original, at, F.char_length(fragment))).otherwise(window)

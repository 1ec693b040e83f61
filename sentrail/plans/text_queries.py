"""Queries over message text, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrail.functions import fixed
from sentrail.operators import text as T
from sentrail.sources.tables import MSG_SQL, messages, read

MSG = f"WITH msg AS ({MSG_SQL})"
_Q = lambda s: "'" + s.replace("'", "''") + "'"


def text_ws(spark, sf):
    return messages(spark, sf).select("msg_id", T.collapse_spaces(F.replace("text", F.lit(". "), F.lit(".\t  "))).alias("text_ws"))


def text_nfc(spark, sf):
    return messages(spark, sf).select("msg_id", T.nfc(F.col("text")).alias("text_nfc"))


def text_collapse(spark, sf):
    return messages(spark, sf).select("msg_id", T.collapse_elongation(F.replace("text", F.lit("a"), F.lit("aaaa"))).alias("text_collapse"))


def protect_spans(spark, sf):
    masked, spans = T.protect(F.col("text"))
    return messages(spark, sf).select("msg_id", F.array_join(spans, "|").alias("spans"), F.replace(masked, F.lit(T.MARK), F.lit("#")).alias("masked"))


def fold_tanglish(spark, sf):
    return messages(spark, sf).select("msg_id", T.fold_tanglish(F.lower("text")).alias("folded"))


def fold_tamil(spark, sf):
    return messages(spark, sf).select("msg_id", T.fold_tamil(F.col("text")).alias("folded"))


def script_profile(spark, sf):
    return messages(spark, sf).select("msg_id", T.script_counts(F.col("text")).alias("s")).select("msg_id", "s.tamil", "s.latin")


def lang_features(spark, sf):
    df = T.language(messages(spark, sf))
    return df.select("msg_id", F.size("tanglish").cast("int").alias("n_tanglish"), F.round("english_share", 6).alias("english_share"))


def lang_detect(spark, sf):
    return T.language(messages(spark, sf)).select("msg_id", "language", "language_label", "code_switched", "language_confidence")


def lang_counts(spark, sf):
    return T.language(messages(spark, sf)).groupBy("language", "code_switched").agg(F.count("*").alias("n"))


def fingerprint(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


def fingerprint_messages(spark, sf):
    return messages(spark, sf).groupBy(T.fingerprint(F.col("text")).alias("fingerprint")).agg(F.count("*").alias("n"), F.min("msg_id").alias("first_id"))


def shingles(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(T.shingles(F.col("text"))).alias("n_shingles"))


def jaccard_pairs(spark, sf):
    """Neighbouring turns of a conversation."""
    turns = read(spark, sf, "conversations").select("conv_id", "turn", T.shingles(F.col("text")).alias("s"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("t"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("s"), F.col("t")), 9).alias("jaccard"))


def redact(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.redact(F.col("text")).alias("redacted"))


def evidence_hash(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.evidence_hash(F.col("text")).alias("evidence_hash"))


def evidence_span(spark, sf):
    return messages(spark, sf).select("msg_id", F.transform(F.array(T.fold(F.col("text"))), lambda f: T.evidence_span(F.col("text"), f, r"\b(?:immediately|blocked|expired|arrest)\b"))[0].alias("span"))


_PROT = "|".join(T.PROTECTED)
_TANGLISH_SQL = "lower(text)"
for _s in T.longest_first(fixed.TANGLISH):
    _TANGLISH_SQL = f"regexp_replace({_TANGLISH_SQL}, {_Q(T.tanglish_pattern(_s)[4:])}, {_Q(' ' + fixed.TANGLISH[_s] + ' ')}, 'gi')"
_TAMIL_SQL = "text"
for _s, _t in fixed.TAMIL.items():
    _TAMIL_SQL = f"replace({_TAMIL_SQL}, '{_s}', ' {_s} {_t} ')"
_HITS = " + ".join(f"CAST(regexp_matches(' ' || lower(text) || ' ', {_Q(T.tanglish_pattern(s)[4:])}) AS INT)" for s in fixed.TANGLISH)
_STOP = ", ".join(map(_Q, fixed.ENGLISH_STOPWORDS))
_LANG = f"""f AS (
  SELECT msg_id, {_HITS} AS hits, regexp_extract_all(lower(text), '[a-z'']+') AS w, len(regexp_extract_all(text, '\\p{{L}}')) AS letters,
         len(regexp_extract_all(text, '[\\x{{0B80}}-\\x{{0BFF}}]')) AS tamil, len(regexp_extract_all(text, '[A-Za-z]')) AS latin FROM msg
), g AS (
  SELECT *, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x IN ({_STOP}))) / len(w) ELSE 0 END AS english, tamil / greatest(letters, 1) AS ts, latin / greatest(letters, 1) AS ls FROM f
), l AS (
  SELECT *, CASE WHEN ts >= 0.6 AND ls < 0.15 THEN 1 WHEN tamil > 0 AND latin > 0 THEN 2 WHEN hits > 0 AND (english < 0.55 OR hits >= 2) THEN 3 WHEN latin > 0 THEN 4 ELSE 5 END AS k FROM g
), d AS (
  SELECT msg_id, CASE k WHEN 1 THEN 'ta' WHEN 2 THEN 'ta-en' WHEN 3 THEN 'ta-en' WHEN 4 THEN 'en' ELSE 'und' END AS language,
    CASE k WHEN 1 THEN 'Tamil' WHEN 2 THEN 'Tanglish (Tamil-English code-switch)' WHEN 3 THEN 'Tanglish (romanized Tamil)' WHEN 4 THEN 'English' ELSE 'Undetermined' END AS language_label,
    CASE k WHEN 1 THEN hits > 0 OR ls > 0.05 WHEN 2 THEN true WHEN 3 THEN true ELSE false END AS code_switched,
    CAST(CASE k WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN least(0.9, 0.55 + 0.1 * hits) WHEN 4 THEN CASE WHEN english > 0.2 THEN 0.8 ELSE 0.6 END ELSE 0.3 END AS DOUBLE) AS language_confidence FROM l
)"""
_WORDS = r"regexp_extract_all(regexp_replace(lower(text), '\d+|https?://\S+|www\.\S+', ' ', 'gi'), '[a-z\x{0B80}-\x{0BFF}]{3,}')"
_SHINGLES = f"(SELECT *, CASE WHEN len(w) < 3 THEN list_distinct(w) ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS s FROM (SELECT *, {_WORDS} AS w FROM %s))"

QUERIES = {f.__name__: f for f in (text_ws, text_nfc, text_collapse, protect_spans, fold_tanglish, fold_tamil, script_profile, lang_features, lang_detect, lang_counts, fingerprint, fingerprint_messages, shingles, jaccard_pairs, redact, evidence_hash, evidence_span)}

ORACLE_SQL = {
    "text_ws": rf"{MSG} SELECT msg_id, regexp_replace(replace(text, '. ', '.' || chr(9) || '  '), '[ \t\x{{00A0}}]+', ' ', 'g') AS text_ws FROM msg",
    "text_nfc": f"{MSG} SELECT msg_id, nfc_normalize(text) AS text_nfc FROM msg",
    "text_collapse": f"{MSG} SELECT msg_id, replace(regexp_replace(replace(text, 'a', 'aaaa'), 'a{{3,}}', 'aa', 'g'), 'ttt', 'tt') AS text_collapse FROM msg",
    "protect_spans": f"{MSG} SELECT msg_id, array_to_string(regexp_extract_all(text, {_Q('(?i)' + _PROT)}), '|') AS spans, regexp_replace(text, {_Q(_PROT)}, '#', 'gi') AS masked FROM msg",
    "fold_tanglish": f"{MSG} SELECT msg_id, {_TANGLISH_SQL} AS folded FROM msg",
    "fold_tamil": f"{MSG} SELECT msg_id, {_TAMIL_SQL} AS folded FROM msg",
    "script_profile": f"{MSG}, {_LANG} SELECT msg_id, CAST(tamil AS INT) AS tamil, CAST(latin AS INT) AS latin FROM f",
    "lang_features": f"{MSG}, {_LANG} SELECT msg_id, CAST(hits AS INT) AS n_tanglish, round(CAST(english AS DOUBLE), 6) AS english_share FROM g",
    "lang_detect": f"{MSG}, {_LANG} SELECT * FROM d",
    "lang_counts": f"{MSG}, {_LANG} SELECT language, code_switched, count(*) AS n FROM d GROUP BY ALL",
    "fingerprint": f"SELECT doc_id, substr(sha256(array_to_string(list_sort(list_distinct({_WORDS})), ' ')), 1, 32) AS fingerprint FROM documents",
    "fingerprint_messages": f"{MSG} SELECT substr(sha256(array_to_string(list_sort(list_distinct({_WORDS})), ' ')), 1, 32) AS fingerprint, count(*) AS n, min(msg_id) AS first_id FROM msg GROUP BY 1",
    "shingles": f"SELECT doc_id, CAST(len(s) AS INT) AS n_shingles FROM {_SHINGLES % 'documents'}",
    "jaccard_pairs": f"WITH t AS {_SHINGLES % 'conversations'} SELECT a.conv_id, a.turn, round(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0.0 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) END, 9) AS jaccard FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
    "redact": r"""SELECT doc_id, CASE WHEN length(t) > 180 THEN substr(t, 1, 180) || '…' ELSE t END AS redacted FROM (
        SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(^|\D)([6-9]\d{2})\d{5}(\d{2})(\D|$)', '\1\2*****\3\4', 'g'),
          '\b([A-Za-z0-9._%+-]{2})[A-Za-z0-9._%+-]*@', '\1***@', 'g'), '\b(\d{4})\d{4,11}(\d{2})\b', '\1****\2', 'g') AS t FROM documents)""",
    "evidence_hash": "SELECT doc_id, sha256(text) AS evidence_hash FROM documents",
}

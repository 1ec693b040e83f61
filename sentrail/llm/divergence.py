"""Quality rules by distribution divergence, in SQL functions alone.

A document's character classes and common words are counted into two histograms. Each language has a reference: the
summed histograms of its documents that pass the base rules and are not far from a first reference made the same way
of all that pass them, so junk hardly shapes it. A document goes if the Jensen-Shannon distance to its
language's reference is over a limit in either histogram; histograms of too few characters or words are not judged.

Features are computed row by row without a shuffle and written once; the references are a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrail.llm._text import written

# Common words by language.
COMMON = {
    "en": "the of and to a in is that it was for on are with as be by this from".split(),
    "fr": "de la le et les des en un du une que qui dans pour par sur au est".split(),
    "de": "der die und das den von zu mit dem nicht als auf ein eine ist im sich auch".split(),
    "es": "de la que el en y los se del las un por con para una su al lo".split(),
}
#: Character classes that are counted by pattern; the last class is every other character of a word.
CLASSES = ["[A-Z]", "[0-9]", "[#*$%&|<>]", "[.,;:!?'\"()\\-]", "[^\\x00-\\x7F]"]
SPACE = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED = 300, 60
CLASS_LIMIT, WORD_LIMIT = 0.22, 0.3


def _let(value: Column, body) -> Column:
    """Binds a value, so that it is computed once and not wherever ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words in windows of five that occur twice or more; windows are hashed first, and compared as text if hashes repeat."""
    index = F.sequence(F.lit(0), F.size(words) - 5)
    hashes = F.transform(index, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))

    def exact() -> Column:
        pairs = F.array_sort(F.transform(index, lambda i: F.struct(F.array_join(F.slice(words, i + 1, 5), " ").alias("g"), i.alias("i"))))

        def covered(p: Column) -> Column:
            same = lambda j, k: F.get(p, j)["g"] == F.get(p, k)["g"]
            again = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
            starts = F.array_sort(F.transform(again, lambda j: F.get(p, j)["i"]))
            return _let(starts, lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(s, k + 1) - x, F.lit(5)))), F.lit(0), lambda a, b: a + b))

        return _let(pairs, covered)

    repeated = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) < 5, F.lit(0)).when(repeated, exact()).otherwise(F.lit(0)).cast("long")


def features(docs: DataFrame, *, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """The columns ``keep``, lang, n_words, the base counts, and the histograms ``classes`` and ``common``."""
    known = F.when(F.col(lang).isin(list(COMMON)), F.col(lang))
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))

    def measure(w: Column) -> Column:
        joined = F.lower(F.concat(F.lit(" "), F.array_join(w, "  "), F.lit(" ")))

        def count(j: Column, word: str) -> Column:
            return ((F.octet_length(j) - F.octet_length(F.replace(j, F.lit(f" {word} "), F.lit("")))) / (len(word) + 2)).cast("long")

        def counts(listed: list[str]):
            return lambda j: F.array(*[count(j, x) for x in listed])

        common = F.lit(None).cast("array<long>")
        for code, listed in COMMON.items():
            common = F.when(known == code, _let(joined, counts(listed))).otherwise(common)
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated_words(w).alias("n_repeat_words"),
            common.alias("hits"),
        )

    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    source = docs.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
        known.alias("lang"),
        _let(words, measure).alias("m"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.array(*[F.regexp_count(t, F.lit(c)).cast("long") for c in CLASSES]).alias("counted"),
    )
    rest = lambda total, parts: F.concat(parts, F.array(total - F.aggregate(parts, F.lit(0).cast("long"), lambda a, b: a + b)))
    return source.select(
        *[F.col(f"k{i}").alias(f"k{i}") for i in range(len(keep))],
        "lang",
        "m.n_words",
        "m.word_chars",
        F.col("counted")[2].alias("n_symbols"),
        "n_dup_lines",
        "m.n_repeat_words",
        rest(F.col("m.word_chars"), F.col("counted")).alias("classes"),
        rest(F.col("m.n_words"), F.col("m.hits")).alias("common"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of counts with positive totals."""
    total = lambda h: F.aggregate(h, F.lit(0).cast("long"), lambda a, b: a + b)
    share = lambda h: _let(total(h), lambda n: F.transform(h, lambda x: x / n))
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    terms = F.zip_with(share(p), share(q), lambda x, y: (part(x, y) + part(y, x)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)))


def _summed(column: str, size: int) -> Column:
    return F.array(*[F.sum(F.col(column)[i]) for i in range(size)])


def _references(table: DataFrame) -> DataFrame:
    """Summed histograms by language: a row for each known language at most."""
    size = max(map(len, COMMON.values())) + 1
    sums = table.where(F.col("lang").isNotNull()).groupBy("lang").agg(_summed("classes", len(CLASSES) + 1).alias("all_classes"), F.array(*[F.sum(F.get("common", F.lit(i))) for i in range(size)]).alias("sums"))
    return sums.select("lang", "all_classes", F.filter("sums", lambda x: x.isNotNull()).alias("all_common"))


def _measured(table: DataFrame, references: DataFrame, min_chars: int, min_words: int) -> DataFrame:
    """Distances to the references, null where there is nothing to judge."""
    found = table.join(F.broadcast(references), "lang", "left")
    by_class = F.when((F.col("word_chars") >= min_chars) & F.col("all_classes").isNotNull(), js_distance(F.col("classes"), F.col("all_classes")))
    by_word = F.when((F.col("n_words") >= min_words) & F.col("all_common").isNotNull(), js_distance(F.col("common"), F.col("all_common")))
    return found.withColumns({"class_distance": by_class, "word_distance": by_word}).drop("all_classes", "all_common")


def _far(class_limit: float, word_limit: float) -> Column:
    return (F.coalesce("class_distance", F.lit(0.0)) > class_limit) | (F.coalesce("word_distance", F.lit(0.0)) > word_limit)


def judge(
    docs: DataFrame,
    *,
    keep: list[str],
    text: str = "text",
    lang: str = "lang",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    min_chars_judged: int = MIN_CHARS_JUDGED,
    min_words_judged: int = MIN_WORDS_JUDGED,
    class_limit: float = CLASS_LIMIT,
    word_limit: float = WORD_LIMIT,
) -> DataFrame:
    """The columns ``keep``, the base counts, base_failed, kept, class_distance and word_distance.

    kept is false if the base rules fail or a distance is over its limit. A distance is null, and not held against
    the document, if the text is too short, the language is null or not known, or its reference is empty. A null text
    has no words and fails the base rules. Repeated rows are judged one by one; an empty table gives an empty result;
    other columns are not read, and columns of ``keep`` may have any names but those of the result.
    """
    table = written(features(docs, keep=keep, text=text, lang=lang))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    table = table.withColumn("base_failed", failed)
    first = _measured(table, _references(table.where(~failed)), min_chars_judged, min_words_judged)
    clean = first.where(~_far(class_limit, word_limit) & ~F.col("base_failed"))
    judged = _measured(table, _references(clean), min_chars_judged, min_words_judged)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance"]
    judged = judged.withColumn("kept", ~F.col("base_failed") & ~_far(class_limit, word_limit))
    return judged.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names, "kept")

"""URL filter: rules first, then naive Bayes over segmented host and path tokens.

Concatenated names are split by a unigram Viterbi: the pieces of a run of letters are looked up in the word counts of
the pages' visible text (a join, so the vocabulary may grow), and the best split of the whole run is found, however long
it is. Only distinct runs are segmented. The naive Bayes model is multinomial and learns from the urls that a rule
judges, allowed and blocked ones alike; it judges the others.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrail.llm._text import tidily, written

# The rules, as action, host and path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
LONGEST = 64  # letters of a word; longer runs of a page's text are no words
STARTS = 4096  # places of a run of letters whose pieces are laid out at once
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMBER = "<num>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct of action and rule of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        found = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def word_counts(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """(word, n) of the visible text of all pages, A-Z lower-cased, words of at most LONGEST letters."""
    seen = F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>", " "), "<[^>]*>|&[a-zA-Z]+;", " ")
    words = F.explode(F.regexp_extract_all(F.translate(seen, _UPPER, _LOWER), F.lit("\\p{L}+"), F.lit(0)))
    return pages.select(words.alias("word")).where(F.char_length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))


def best_split(chunk: str, known: dict[str, int], total: int) -> list[str]:
    """The most likely split under a unigram model; an unknown piece may have any length and gets less the longer it is."""
    longest = max(map(len, known), default=0)
    begin, letter = math.log(10 / max(total, 1)), math.log(10)
    score, back, unknown, since = [0.0], [0], -math.inf, 0
    for j in range(1, len(chunk) + 1):
        if score[j - 1] + begin > unknown:
            unknown, since = score[j - 1] + begin, j - 1
        unknown -= letter
        best, at = unknown, since
        for i in range(max(0, j - longest), j):
            n = known.get(chunk[i:j])
            if n and score[i] + math.log(n / total) > best:
                best, at = score[i] + math.log(n / total), i
        score.append(best)
        back.append(at)
    out, j = [], len(chunk)
    while j:
        out.append(chunk[back[j] : j])
        j = back[j]
    return out[::-1]


def segment(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """(chunk, words) for the distinct values of ``chunk``, of any length."""
    chunks = chunks.select("chunk").where("chunk is not null").distinct().withColumn("key", F.sha2("chunk", 256))
    chunks = written(chunks)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def pieces(batches):
        for batch in batches:
            for key, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a in range(0, len(chunk), STARTS):
                    found = {chunk[i:j] for i in range(a, min(a + STARTS, len(chunk))) for j in range(i + 1, min(i + LONGEST, len(chunk)) + 1)}
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(found)), pa.array(found, pa.string())], names=["key", "word"])

    piece = chunks.select("key", "chunk").mapInArrow(tidily(pieces), "key string, word string")
    known = piece.join(counts, "word").groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def run(batches):
        for batch in batches:
            got = [best_split(c, {x["word"]: x["n"] for x in k or ()}, total) for c, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.string()))], names=["chunk", "words"])

    return chunks.join(known, "key", "left").select("chunk", "known").mapInArrow(tidily(run), "chunk string, words array<string>")


def url_key(host: str = "host", path: str = "path") -> Column:
    """What stands for a host and path in the tables of their tokens, however long they are."""
    return F.unhex(F.sha2(F.concat(F.col(host), F.lit("/"), F.col(path)), 256))


def tokens(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, part, token) of distinct urls (key, host, path): words of runs of letters, and one token for any number."""

    def chunks_of(part: str) -> Column:
        found = F.regexp_extract_all(F.translate(part, _UPPER, _LOWER), F.lit("\\p{L}+|\\p{N}+"), F.lit(0))
        return F.transform(found, lambda x: F.struct(F.lit(part).alias("part"), F.when(x.rlike("^\\p{N}"), F.lit(NUMBER)).otherwise(x).alias("chunk")))

    chunk = urls.select("key", F.explode(F.concat(chunks_of("host"), chunks_of("path"))).alias("c")).select("key", "c.part", "c.chunk")
    split = segment(chunk.where(F.col("chunk") != NUMBER).select("chunk"), counts)
    return chunk.join(split, "chunk", "left").select("key", "part", F.explode(F.coalesce("words", F.array("chunk"))).alias("token"))


def bayes_weights(token: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(part, token, weight): add-one log odds of block against allow, and the log odds of the classes.

    labels: key, spam (true for a blocked url). A token that no labelled url has, has no weight.
    """
    known = token.join(labels, "key")
    of_class = written(known.groupBy("part", "token").agg(F.count_if("spam").alias("b"), F.count_if(~F.col("spam")).alias("a")))
    v, b, a = of_class.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))).first()
    urls = labels.join(token.select("key").distinct(), "key", "left_semi").agg(F.count_if("spam"), F.count_if(~F.col("spam"))).first()
    weight = F.log((F.col("b") + 1) / (b + v)) - F.log((F.col("a") + 1) / (a + v))
    return of_class.select("part", "token", weight.alias("weight")), math.log((urls[0] + 0.5) / (urls[1] + 0.5))


def log_odds(token: DataFrame, weights: DataFrame, prior: float) -> DataFrame:
    """(key, log_odds) of every url with a token; a token without a weight counts nothing."""
    return token.join(weights, ["part", "token"], "left").groupBy("key").agg((F.coalesce(F.sum("weight"), F.lit(0.0)) + prior).alias("log_odds"))


def rule_labels(urls: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(key, spam) of the urls (key, host, path) that a rule judges."""
    return urls.select("key", (fitting_rule(F.col("host"), F.col("path"), rules)["action"] == "block").alias("spam")).where("spam is not null")


def judge(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Returns page_id, host, path, rule, verdict and log_odds (of block, by the model) for every row.

    A rule's verdict stands whatever the model says; without a rule, log_odds over 0 blocks. A null url, one without
    ``://`` and one without tokens have log_odds null and are allowed if no rule fits. Null html has no words. Repeated
    rows are each judged; an empty table gives an empty result; other columns are not read.
    """
    host, path = host_and_path(F.coalesce(F.col(url), F.lit("")))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("key", url_key())
    some = (F.col("host") != "") | (F.col("path") != "")
    urls = written(rows.where(some).select("key", "host", "path").dropDuplicates(["key"]))
    counts = written(word_counts(pages, html=html))
    token = written(tokens(urls, counts))
    odds = written(log_odds(token, *bayes_weights(token, rule_labels(urls, rules))))
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    known = F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))
    both = rows.where(some).join(odds, "key", "left").unionByName(rows.where(~some).withColumn("log_odds", F.lit(None).cast("double")))
    judged = both.withColumn("_rule", rule)
    return judged.select(F.col("page_id").alias(page_id), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.action", known).alias("verdict"), "log_odds")

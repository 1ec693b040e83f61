"""URL filter against a plain version."""

import itertools
import math
import re
from collections import Counter

from sentrail.llm import urlfilter as uf

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(uf._UPPER, uf._LOWER)


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fits = [(a, r) for a, r in uf.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits, key=lambda x: len(x[1])) if fits else None


def brute(rows):
    """rows: [(page_id, url, html)]"""
    words = Counter()
    for _, _, html in rows:
        text = re.sub(r"<[^>]*>|&[a-zA-Z]+;", " ", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", html or ""))
        words.update(w for w in re.findall(r"[^\W\d_]+", text.translate(LOWER)) if len(w) <= uf.LONGEST)
    total = sum(words.values())
    split = {}

    def tokens(part, text):
        for c in re.findall(r"[^\W\d_]+|\d+", text.translate(LOWER)):
            if c[0].isdigit():
                yield part, uf.NUMBER
            else:
                if c not in split:
                    split[c] = uf.best_split(c, words, total)
                yield from ((part, w) for w in split[c])

    urls = {u: [*tokens("host", u[0]), *tokens("path", u[1])] for u in {parse(r[1]) for r in rows}}
    spam = {u: rule(*u)[0] == "block" for u, t in urls.items() if t and rule(*u)}
    count = {k: Counter(x for u, s in spam.items() if s == k for x in urls[u]) for k in (True, False)}
    v = len(set(count[True]) | set(count[False]))
    n = {k: sum(count[k].values()) + v for k in count}
    prior = math.log((sum(spam.values()) + 0.5) / (len(spam) - sum(spam.values()) + 0.5))
    out = []
    for i, url, _ in rows:
        h, p = parse(url)
        t = urls[(h, p)]
        odds = prior + sum(math.log((count[True][x] + 1) / n[True]) - math.log((count[False][x] + 1) / n[False]) for x in t if count[True][x] + count[False][x]) if t else None
        r = rule(h, p)
        out.append((i, h, p, r and r[1], r[0] if r else ("block" if odds is not None and odds > 0 else "allow"), odds))
    return out


def same(got, want):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r[:3])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all((x[5] is None) == (y[5] is None) and (x[5] is None or abs(x[5] - y[5]) < 1e-6) for x, y in zip(got, want, strict=True))


def test_real(spark):
    """The model blocks urls that no rule judges, and allows others."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = uf.judge(pages).collect()
    same(got, brute([(r.page_id, r.url, r.html) for r in pages.collect()]))


def test_learns_from_rules(spark):
    """What goes with blocked urls is blocked elsewhere, by words within concatenated names; no word is known beforehand."""
    text = "<p>" + "zork blim garden flower " * 20 + "</p>"
    rows = [(k, f"http://zorkblim{k}.example.com/en/{k}", text) for k in range(30)] + [(100 + k, f"http://gardenflower{k}.example.com/xx/{k}", text) for k in range(30)]
    rows += [(200, "http://blimzork.org/1", text), (201, "http://flowergarden.org/1", text), (202, "http://zorkzork.info", text)]
    got = {r.page_id: (r.rule, r.verdict) for r in uf.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[200] == (None, "block") and got[202] == (None, "block") and got[201] == (None, "allow") and got[0] == ("example.com/en/", "block")


def test_held_out_accuracy(spark):
    """Urls of a fold that was not learnt from get their rules' verdicts from the model."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host, path = uf.host_and_path(uf.F.col("url"))
    urls = uf.written(pages.select(host.alias("host"), path.alias("path")).distinct().withColumn("key", uf.url_key()))
    token = uf.written(uf.tokens(urls, uf.word_counts(pages)))
    labels = uf.rule_labels(urls).withColumn("held", uf.F.pmod(uf.F.crc32("key"), uf.F.lit(5)) == 0)
    odds = uf.log_odds(token, *uf.bayes_weights(token, labels.where("not held").drop("held")))
    judged = labels.where("held").join(odds, "key").collect()
    right = sum((r.log_odds > 0) == r.spam for r in judged)
    assert len(judged) > 200 and right >= 0.95 * len(judged), (right, len(judged))


def test_very_long_urls(spark):
    """Runs of letters far longer than any word are split whole; what is unknown is one piece."""
    rows = [(1, "http://a.org/" + "spamfarm" * 20_000, "spam farm " * 9), (2, "http://b.org/" + "q" * 100_000, None), (3, "http://" + "x" * 1_000_000 + ".org/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert len(uf.judge(pages).collect()) == 3
    words = {r.chunk[:9]: r.words for r in uf.segment(pages.select(uf.F.regexp_extract("url", "/([a-z]{9,})$", 1).alias("chunk")), uf.word_counts(pages)).collect()}
    assert words["spamfarms"] == ["spam", "farm"] * 20_000 and words["qqqqqqqqq"] == ["q" * 100_000]


def test_cases(spark):
    rows = [
        (1, "HTTP://WWW.Example.COM/en/a?x#y", "<p>Cheap pills and casino</p>"),
        (2, "http://example.com/EN/", None),
        (3, "http://cheappills.org/buy/12", "<script>var x</script>cheap cheap pills"),
        (4, None, "buy"),
        (5, "no scheme", ""),
        (6, "x://", "x"),
        (7, "http://a.com", "x"),
        (8, "http://a.com?/en/", "x"),
        (9, "http://foo.net/es/1", "x"),
        (10, "http://xnet/es/1", "x"),
        (None, "http://net/fr/", "x"),
        (3, "http://cheappills.org/buy/12", "x"),
        (11, "http://ü.org/é://x", "x"),
        (12, "http://" + "z" * 300 + ".org/", "x"),
    ]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string")
    got = uf.judge(pages).collect()
    same(got, brute(rows))
    assert next(r for r in got if r.page_id == 1).rule == "www.example.com/en/"
    assert uf.judge(pages.limit(0)).count() == 0


def test_best_split():
    known = {"spam": 5, "farm": 3, "far": 1, "ms": 1, "a": 9}
    cost = lambda ws: sum(math.log(known[w] / 50) if w in known else math.log(10 / 50) - len(w) * math.log(10) for w in ws)
    for chunk in ["spamfarm", "farms", "aaa", "qspamq"]:
        cuts = [c for k in range(len(chunk)) for c in itertools.combinations(range(1, len(chunk)), k)]
        best = max(cost([chunk[i:j] for i, j in zip((0, *c), (*c, len(chunk)), strict=True)]) for c in cuts)
        assert abs(cost(uf.best_split(chunk, known, 50)) - best) < 1e-9

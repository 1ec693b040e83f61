"""The dictionary matcher against plain searches, and folding against plain replacements."""

import random
import re

import pytest

from sentrail.functions import fixed
from sentrail.operators import matcher as M
from sentrail.operators import text as T


@pytest.mark.parametrize(("pattern", "literals"), [(r"\bkyc\b", ["kyc"]), (r"(ab|cde)x?", ["ab", "cde"]), (r"a.{0,9}longer\d+", ["longer"]), (r"\d+", []), (r"(x|\d)y", ["y"]), (r"(?:foo)+bar?", ["foo"]), (r"A(B)?", ["a"])])
def test_needed(pattern, literals):
    assert M.needed(pattern) == literals


def test_matches_are_those_of_plain_search():
    m, rng = M._signals(), random.Random(2)
    words = [w for _, _, r in m.rules for w in re.findall(r"[a-z]+|\d+", re.sub(r"\\[a-z]", " ", r.pattern))]
    for _ in range(600):
        text = " ".join(rng.choice(words) if rng.random() < 0.8 else rng.choice(["Rs", "₹", "5%", "UPI", "İ", "ſ"]) for _ in range(rng.randrange(25)))
        text = text.upper() if rng.random() < 0.3 else text
        assert [(g, i) for g, i, _ in m.matches(text)] == [(g, i) for g, i, r in m.rules if r.search(text)]


def test_signals(spark):
    """Evidence is the original's fragment with its place, else the folded text around; nulls have none."""
    rows = [("Pay NOW", "pay now"), ("udane vaanga", "x" * 40 + " immediately come " + "y" * 40), (None, None), ("", "")]
    df = spark.createDataFrame(rows, "text string, folded string")
    got = [r.s for r in df.select(M.signals(df["text"], df["folded"]).alias("s")).collect()]
    now = [s for s in got[0].found if s.family == "urgency"][0]
    assert (now.evidence, now.start, now.stop) == ("NOW", 4, 7) and got[0].counts["urgency"] == 1
    late = [s for s in got[1].found if s.family == "urgency"][0]
    assert late.evidence == "x" * 23 + " immediately come " + "y" * 18 and late.start == -1
    assert not got[2].found and not got[3].found


def replaced(text):
    out = []
    for s in sorted(fixed.TANGLISH, key=len, reverse=True):
        rule = re.compile(re.escape(s) if " " in s else rf"\b{re.escape(s)}\b", re.IGNORECASE)
        if rule.search(text):
            text = rule.sub(f" {fixed.TANGLISH[s]} ", text)
            out.append((s, fixed.TANGLISH[s], "tanglish"))
    for s, t in fixed.TAMIL.items():
        if s in text:
            text = text.replace(s, f" {s} {t} ")
            out.append((s, t, "tamil"))
    return text, out


def test_fold_and_audit(spark):
    rng = random.Random(3)
    words = [*fixed.TANGLISH, *fixed.TAMIL, "hello", "unga,", "x", "http://udane.com/a"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", ", ", ""]) for _ in range(rng.randrange(9))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string")
    for r in df.select("t", M.folded(df["t"]).alias("f")).collect():
        want = replaced(r.t) if r.t is not None else (None, None)
        assert (r.f and r.f.text or r.t, r.f and [tuple(x) for x in r.f.replaced] or want[1]) == (want[0], want[1])
    got = df.select(T.fold_audit(df["t"]).alias("f")).where("t like '%udane.com%'").first().f
    assert "http://udane.com/a" in got.text


def test_entries(spark):
    df = spark.createDataFrame([("Udane, unga UDANE",), ("xudane",), (None,)], "t string")
    got = [r.e for r in df.select(M.tanglish_entries(df["t"]).alias("e")).collect()]
    assert got[0] == [s for s in T.longest_first(fixed.TANGLISH) if re.search(rf"\b{re.escape(s)}\b", "udane, unga udane")] and got[1:] == [[], []]


def test_copies_in_a_batch_are_judged_once():
    """Every row gets what its text has, nulls too, and each distinct row is judged once."""
    import pyarrow as pa

    seen = []

    def build(rows):
        seen.extend(rows)
        return pa.array([{"n": [f"{a}{b}"], "m": [("k", 1)]} for a, b in rows], pa.struct([("n", pa.list_(pa.string())), ("m", pa.map_(pa.string(), pa.int32()))]))

    a, b = ["x", "y", "x", None, "x", None], ["1", "1", "1", "2", None, "2"]
    got = M.once(build, pa.array(a), pa.array(b)).to_pylist()
    assert [r["n"] for r in got] == [[f"{x}{y}"] for x, y in zip(a, b)] and seen == [("x", "1"), ("y", "1"), (None, "2"), ("x", None)]

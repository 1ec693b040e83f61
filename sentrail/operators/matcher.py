"""Dictionaries of patterns over texts in one pass, in Arrow batches.

A chain of hundreds of regular expressions as nested columns costs more to plan than to run, and gives no places. Here
every pattern is reduced to literals of which a match must have one; a text is searched for the literals first, and only
patterns whose literal it has are tried. Matches carry their places and the fragment of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrail.functions import fixed

SIGNAL = "array<struct<family: string, pattern: int, evidence: string, start: int, stop: int>>"
REPLACED = "array<struct<source: string, target: string, kind: string>>"
AROUND = 24  # characters of the folded text on both sides of a match that the original does not have


def needed(pattern: str) -> list[str]:
    """Lower-case literals of which every match of ``pattern`` (letter case ignored) has one; empty if none is known."""

    def of(items) -> list[str]:
        best: list[str] = []
        run = ""

        def offer(found: list[str]) -> None:
            nonlocal best
            if found and min(map(len, found)) > min(map(len, best), default=0):
                best = found

        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                run += chr(value).lower()
                continue
            offer([run] if run else [])
            run = ""
            if name == "SUBPATTERN":
                offer(of(value[3]))
            elif name == "BRANCH":
                parts = [of(x) for x in value[1]]
                offer([x for p in parts for x in p] if all(parts) else [])
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                offer(of(value[2]))
        offer([run] if run else [])
        return best

    return of(re._parser.parse(pattern, re.IGNORECASE))


def lowered(text: str) -> str:
    """Lower case, with the letters that case-blind patterns take for s, i and k."""
    low = text.lower()
    return low if low.isascii() else low.replace("ſ", "s").replace("ı", "i").replace("i̇", "i")


class Matcher:
    """Patterns in groups, tried in order."""

    def __init__(self, groups: dict[str, list[str]]):
        self.groups = list(groups)
        self.rules = [(g, i, re.compile(p, re.IGNORECASE)) for g, ps in groups.items() for i, p in enumerate(ps)]
        self.by_literal: dict[str, list[int]] = {}
        self.always = []
        for n, (_, _, rule) in enumerate(self.rules):
            literals = needed(rule.pattern)
            for x in literals:
                self.by_literal.setdefault(x, []).append(n)
            if not literals:
                self.always.append(n)

    def matches(self, text: str) -> Iterable[tuple[str, int, re.Match]]:
        """Group, place in the group and first match of each pattern that the text has."""
        low = lowered(text)
        likely = {n for x, ns in self.by_literal.items() if x in low for n in ns}
        for n in sorted(likely.union(self.always)):
            group, i, rule = self.rules[n]
            if m := rule.search(text):
                yield group, i, m


def span(original: str, folded: str, m: re.Match) -> tuple[str, int, int]:
    """What a match on the folded text shows: the fragment as the original has it, else the folded text around it."""
    at = original.lower().find(m[0].lower())
    if at >= 0:
        return original[at : at + len(m[0])], at, at + len(m[0])
    return folded[max(0, m.start() - AROUND) : m.end() + AROUND].strip(), -1, -1


def once(build: Callable[[list[tuple]], pa.Array], *columns: pa.Array) -> pa.Array:
    """``build`` for the distinct rows of a batch, laid out for all its rows: many messages are copies of a template."""
    places: dict[tuple, int] = {}
    rows = [places.setdefault(row, len(places)) for row in zip(*(c.to_pylist() for c in columns), strict=True)]
    found = build(list(places))
    return found if len(places) == len(rows) else found.take(pa.array(rows, pa.int32()))


@lru_cache
def _signals() -> Matcher:
    classes = {f"class:{k}": v["patterns"] for k, v in fixed.SCAM_CLASSES.items() if v["patterns"]}
    return Matcher(fixed.INTENTS | {"benign": fixed.BENIGN} | classes)


def signals(original: Column, folded: Column) -> Column:
    """Struct of ``found`` (intent and benign signals in order, one for each pattern) and ``counts`` by group.

    Groups are the intent families, ``benign`` and ``class:`` with the name of a scam class. A null text has no signals.
    """

    def build(rows: list[tuple]) -> pa.Array:
        matcher = _signals()
        out = []
        for original, text in rows:
            found, counts = [], {}
            for group, i, m in matcher.matches(text or ""):
                counts[group] = counts.get(group, 0) + 1
                if not group.startswith("class:"):
                    evidence, start, stop = span(original or "", text, m)
                    found.append({"family": group, "pattern": i, "evidence": evidence, "start": start, "stop": stop})
            out.append({"found": found, "counts": list(counts.items())})
        signal = pa.list_(pa.struct([("family", pa.string()), ("pattern", pa.int32()), ("evidence", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        return pa.array(out, pa.struct([("found", signal), ("counts", pa.map_(pa.string(), pa.int32()))]))

    def run(originals: pa.Array, texts: pa.Array) -> pa.Array:
        return once(build, originals, texts)

    return F.arrow_udf(run, f"struct<found: {SIGNAL}, counts: map<string, int>>")(original, folded)


@lru_cache
def _tanglish() -> list[tuple[str, re.Pattern | None, str]]:
    """Romanised entries, longest first; phrases match anywhere, words as wholes."""
    order = sorted(fixed.TANGLISH, key=len, reverse=True)
    return [(s, None if " " in s else re.compile(rf"\b{re.escape(s)}\b"), f" {fixed.TANGLISH[s]} ") for s in order]


def fold_words(masked: str, tanglish: bool = True, tamil: bool = True) -> tuple[str, list[dict]]:
    """Concepts in place of romanised entries and behind Tamil ones, and what was replaced, in order."""
    text, replaced = masked, []
    for source, rule, target in _tanglish() if tanglish else []:
        if source in text:
            new = text.replace(source, target) if rule is None else rule.sub(target, text)
            if new != text:
                replaced.append({"source": source, "target": target.strip(), "kind": "tanglish"})
                text = new
    for source, target in fixed.TAMIL.items() if tamil else []:
        if source in text:
            text = text.replace(source, f" {source} {target} ")
            replaced.append({"source": source, "target": target, "kind": "tamil"})
    return text, replaced


def folded(masked: Column, tanglish: bool = True, tamil: bool = True) -> Column:
    """Struct of ``text`` and ``replaced`` for lower-case texts; both null for a null text."""

    def build(texts: list[tuple]) -> pa.Array:
        rows = [None if t is None else dict(zip(("text", "replaced"), fold_words(t, tanglish, tamil), strict=True)) for (t,) in texts]
        change = pa.list_(pa.struct([("source", pa.string()), ("target", pa.string()), ("kind", pa.string())]))
        return pa.array(rows, pa.struct([("text", pa.string()), ("replaced", change)]))

    def run(texts: pa.Array) -> pa.Array:
        return once(build, texts)

    return F.arrow_udf(run, f"struct<text: string, replaced: {REPLACED}>")(masked)


def tanglish_entries(text: Column) -> Column:
    """Romanised entries that the text has, longest first; none for a null text."""

    def build(texts: list[tuple]) -> pa.Array:
        out = []
        for (t,) in texts:
            low = f" {(t or '').lower()} "
            out.append([s for s, rule, _ in _tanglish() if s in low and (rule is None or rule.search(low))])
        return pa.array(out, pa.list_(pa.string()))

    def run(texts: pa.Array) -> pa.Array:
        return once(build, texts)

    return F.arrow_udf(run, "array<string>")(text)

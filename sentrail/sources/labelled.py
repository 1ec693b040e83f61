"""Labelled messages as lines of JSON: a scan with a quarantine, and the sink."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["text", "label", "split", "template_id", "provenance", "generator"]
_SCHEMA = ", ".join(f"{c} string" for c in [*FIELDS, "_broken"])


def scan_labelled(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of the files of lines at ``path``.

    Blank lines are skipped. Rows have the fields as text, null where a line lacks one; further fields are ignored.
    Quarantine has line and reason: ``not json``, or ``no text`` or ``no label`` for a line where that is missing or null.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "line").where(F.col("line").rlike(r"\S"))
    read = F.from_json("line", _SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = lines.select("line", read.alias("r")).select("line", "r.*")
    reason = F.when(F.col("_broken").isNotNull(), "not json").when(F.col("text").isNull(), "no text").when(F.col("label").isNull(), "no label")
    judged = rows.withColumn("reason", reason)
    return judged.where("reason is null").select(*FIELDS), judged.where("reason is not null").select("line", "reason")


def write_labelled(rows: DataFrame, path: str) -> None:
    """Writes one JSON object for each row; columns that ``rows`` lacks and nulls are left out."""
    rows.select(*[c for c in FIELDS if c in rows.columns]).write.mode("overwrite").json(path)


def leaked(rows: DataFrame, key: str = "template_id", split: str = "split") -> DataFrame:
    """Templates that both the train and the test split have; none is as it should be. Null templates are none."""
    of = lambda name: rows.where((F.col(split) == name) & F.col(key).isNotNull()).select(key)
    return of("train").intersect(of("test"))


def filled(template: Column, turn: Column, slots: dict[str, list[str]]) -> Column:
    """The template with a value for every ``{slot}``, slot by slot and from left to right.

    The value's place in its list is the turn and the length of the text so far, modulo the list; every slot that is
    filled moves the turn on by one. Values must have no slots in them.
    """
    state = F.struct(template.alias("text"), turn.cast("int").alias("turn"))
    for name, values in slots.items():
        token = "{" + name + "}"
        state = _fill(state, token, values)
    return state["text"]


def _fill(state: Column, token: str, values: list[str]) -> Column:
    listed = F.array(*[F.lit(v) for v in values])

    def step(acc: Column, _: Column) -> Column:
        text, turn = acc["text"], acc["turn"]
        at = F.instr(text, token)
        value = F.get(listed, (turn + F.char_length(text)) % len(values))
        new = F.concat(F.substr(text, F.lit(1), at - 1), value, F.substr(text, at + len(token)))
        return F.struct(new.alias("text"), (turn + 1).alias("turn"))

    # A lambda's variable holds the state, so that it is computed once however often it is used.
    return F.transform(F.array(state), lambda s: _times(s, token, step))[0]


def _times(state: Column, token: str, step) -> Column:
    n = F.regexp_count(state["text"], F.lit(re.escape(token)))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), state, step)).otherwise(state)


def generate(templates: DataFrame, slots: dict[str, list[str]], variants: int = 4) -> DataFrame:
    """(text, label, split, template_id): ``variants`` texts of every template.

    templates: label, split, number, template. Variant v of a template starts at turn 7 * number + 3 * v. A null template
    gives null texts.
    """
    rows = templates.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    ident = F.concat_ws(":", "label", "split", F.col("number").cast("string"))
    return rows.select(filled(F.col("template"), F.col("number") * 7 + F.col("v") * 3, slots).alias("text"), "label", "split", ident.alias("template_id"))

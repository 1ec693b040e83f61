"""Intent families, scam classes and the message part of the risk score, over the folded text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrail.functions import fixed
from sentrail.operators import matcher

CLASSES = [k for k in fixed.SCAM_CLASSES if k != "legitimate"]
# From which confidence a model's class counts, and by how much.
PROMOTED_FROM, PROMOTED_BY, MODEL_FROM, MODEL_POINTS = 0.5, 1.5, 0.45, 8.0


def families(messages: DataFrame, folded: str = "folded", text: str = "text") -> DataFrame:
    """Adds ``signals`` (family, pattern, evidence, start, stop), a count of matched patterns for each intent family,
    n_benign and n_classes_hit (patterns of each scam class).

    Evidence comes from the column ``text`` where there is one, else from the folded text.
    """
    found = messages.withColumn("_found", matcher.signals(F.col(text if text in messages.columns else folded), F.col(folded)))
    count = lambda group: F.coalesce(F.try_element_at("_found.counts", F.lit(group)), F.lit(0))
    counts = {f"n_{name}": count(name) for name in [*fixed.INTENTS, "benign"]}
    hits = F.map_from_arrays(F.array(*[F.lit(c) for c in CLASSES]), F.array(*[count(f"class:{c}") for c in CLASSES]))
    return found.withColumns({"signals": F.col("_found.found"), **counts, "n_classes_hit": hits}).drop("_found")


def scam_class(messages: DataFrame) -> DataFrame:
    """Adds class_scores (classes with a matched pattern), scam_category and top_score.

    A score is the matched patterns of a class and 0.75 for each related family that is present; of equal scores the
    first class of the list counts.
    """
    scores = []
    for name in CLASSES:
        related = reduce(lambda a, b: a + b, [F.when(F.col(f"n_{f}") > 0, 0.75).otherwise(0.0) for f in fixed.SCAM_CLASSES[name]["intents"]], F.lit(0.0))
        n = F.element_at("n_classes_hit", F.lit(name))
        scores.append(F.when(n > 0, F.struct(F.lit(name).alias("name"), (n + related).cast("double").alias("score"))))
    return _best(messages.withColumn("class_scores", F.array_compact(F.array(*scores))))


def _best(df: DataFrame) -> DataFrame:
    place = F.map_from_arrays(F.array(*[F.lit(c) for c in CLASSES]), F.array(*[F.lit(-i) for i in range(len(CLASSES))]))
    best = F.array_max(F.transform("class_scores", lambda s: F.struct(s["score"].alias("score"), F.element_at(place, s["name"]).alias("order"), s["name"].alias("name"))))
    df = df.withColumn("_best", best)
    return df.withColumns({"scam_category": F.coalesce("_best.name", F.lit("legitimate")), "top_score": F.coalesce("_best.score", F.lit(0.0))}).drop("_best")


def promote(messages: DataFrame, predictions: DataFrame, key: str = "msg_id") -> DataFrame:
    """Fuses a model's class into the class scores and picks the best class again.

    predictions: ``key``, label, confidence, at most one row for each message; a message without one keeps its class. A
    class other than legitimate of a confidence of 0.5 and more gains 1.5 times the confidence, whether rules saw it or
    not; nothing is ever taken from a class that rules saw. A class that rules did not see comes behind theirs, so of
    equal scores the rules' class counts. Adds model_label and model_confidence.
    """
    given = predictions.select(key, F.col("label").alias("model_label"), F.col("confidence").alias("model_confidence"))
    df = messages.join(given, key, "left")
    gains = F.coalesce((F.col("model_confidence") >= PROMOTED_FROM) & (F.col("model_label") != "legitimate"), F.lit(False))
    by = PROMOTED_BY * F.col("model_confidence")
    seen = F.exists("class_scores", lambda s: s["name"] == F.col("model_label"))
    raised = F.transform("class_scores", lambda s: F.struct(s["name"].alias("name"), F.when(s["name"] == F.col("model_label"), s["score"] + by).otherwise(s["score"]).alias("score")))
    added = F.array_append(F.col("class_scores"), F.struct(F.col("model_label").alias("name"), by.cast("double").alias("score")))
    df = df.withColumn("class_scores", F.when(~gains, F.col("class_scores")).when(seen, raised).otherwise(added))
    first = F.array_max(F.transform("class_scores", lambda s, i: F.struct(s["score"].alias("score"), (-i).alias("order"), s["name"].alias("name"))))
    df = df.withColumn("_best", first)
    return df.withColumns({"scam_category": F.coalesce("_best.name", F.lit("legitimate")), "top_score": F.coalesce("_best.score", F.lit(0.0))}).drop("_best")


def family_weight(family: str) -> Column:
    n = F.col(f"n_{family}")
    return F.round(F.when(n > 0, fixed.INTENT_WEIGHTS[family] * (1 + 0.25 * F.least(F.lit(2), n - 1))).otherwise(0.0), 2)


def template_weight() -> Column:
    return F.round(F.when(F.col("top_score") > 0, F.least(F.lit(11.0), 4.5 + 1.8 * F.col("top_score"))).otherwise(0.0), 2)


def message_points(messages: DataFrame) -> DataFrame:
    """Adds intent_points (families and class, capped), benign_credit, message_score and band."""
    total = reduce(lambda a, b: a + b, [family_weight(f) for f in fixed.INTENTS])
    df = messages.withColumns({"intent_points": F.least(F.lit(float(fixed.FAMILY_CAPS["message_intent"])), total + template_weight()), "benign_credit": F.least(F.lit(10.0), 4.0 * F.col("n_benign"))})
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.col("intent_points") - F.col("benign_credit")))).cast("int")
    df = df.withColumn("message_score", score)
    return df.withColumn("band", band(F.col("message_score")))


def band(score: Column) -> Column:
    return F.when(score < 25, "LOW").when(score < 50, "CAUTION").when(score < 75, "HIGH").otherwise("CRITICAL")

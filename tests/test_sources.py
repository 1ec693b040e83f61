"""Sources and sinks on small files and tables."""

import datetime as dt
import json

from pyspark.sql import functions as F

from sentrail.operators import entities as E
from sentrail.operators import fusion as R
from sentrail.sources import images, labelled, sinks


def test_scan_labelled(spark, tmp_path):
    good = {"text": "a\nb", "label": "x", "split": "train", "template_id": "1"}
    lines = [json.dumps(good), "", "   ", "{broken", "[1]", json.dumps({"text": "t"}), json.dumps({"label": "x"}), json.dumps(good | {"more": 1, "text": "é"})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines), encoding="utf-8")
    rows, refused = labelled.scan_labelled(spark, f"file://{tmp_path}/in")
    assert sorted((r.text, r.label, r.split, r.generator) for r in rows.collect()) == [("a\nb", "x", "train", None), ("é", "x", "train", None)]
    reasons = sorted((r.reason, r.line) for r in refused.collect())
    assert [x for x, _ in reasons].count("no text") >= 1 and ("no label", lines[5]) in reasons and ("not json", "{broken") in reasons and len(reasons) == 4
    labelled.write_labelled(rows, f"file://{tmp_path}/out")
    again, none = labelled.scan_labelled(spark, f"file://{tmp_path}/out")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str) and none.count() == 0
    both = spark.createDataFrame([("1", "train"), ("1", "test"), ("2", "test"), (None, "train"), (None, "test"), ("1", "train")], "template_id string, split string")
    assert [r.template_id for r in labelled.leaked(both).collect()] == ["1"]


def test_images(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"0" * 32
    files = {"a.png": png, "b.JPG": b"\xff\xd8\xff12", "c.exe": png, "d.png": b"MZ\x90\x00 fake exe", "f.webp": b"RIFF1234WEBPx", "g.webp": b"RIFF1234WEBP", "h.gif": b"GIF89a", "i.bmp": b"BM", "j.png": b"\x89PNG\r\n\x1a\n" + b"0" * images.MOST_BYTES, "none": png}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: r.reason for r in images.read_images(spark, f"file://{tmp_path}").select("path", "reason").collect()}
    assert got == {"a.png": None, "b.JPG": None, "c.exe": "unsupported type", "d.png": "not an image", "f.webp": None, "g.webp": "not an image", "h.gif": "unsupported type", "i.bmp": None, "j.png": "too large", "none": "unsupported type"}
    odd = spark.createDataFrame([(None, bytearray(png)), ("IMAGE/PNG; a=b", bytearray(png)), ("image/png", None)], "kind string, content binary")
    assert [r.why for r in odd.select(images.refusal(F.col("kind"), F.col("content")).alias("why")).collect()] == ["unsupported type", None, "empty"]


def test_ocr_lines(spark):
    """Blocks, paragraphs and lines in order; blanks, nulls and negative confidences go; ties are in order of the words."""
    rows = [
        (1, 2, 1, 1, 0, "last", 50.0), (1, 1, 2, 1, 0, "third", 90.0), (1, 1, 1, 2, 1, "b", 70.0), (1, 1, 1, 2, 1, "a", 70.0), (1, 1, 1, 2, 0, " first ", 80.0), (1, 1, 1, 2, 3, "  ", 99.0),
        (1, 1, 1, 2, 4, None, 99.0), (1, 1, 1, 1, 0, "gone", -1.0), (1, 1, 1, 9, 0, "gone", None), (2, 1, 1, 1, 0, "", 10.0), (3, 1, 1, 10, 0, "ten", 59.0), (3, 1, 1, 9, 0, "nine", 60.0),
    ]
    words = spark.createDataFrame(rows, "image_id long, block int, par int, line int, word_no int, word string, conf double")
    got = {r.image_id: (r.text, r.n_words, r.mean_confidence, r.low) for r in images.lines_of(words).collect()}
    assert got == {1: ("first a b\nthird\nlast", 5, 72.0, False), 2: ("", 0, 0.0, True), 3: ("nine\nten", 2, 59.5, True)}
    assert images.lines_of(words.limit(0)).count() == 0


def test_fan_out(spark, tmp_path):
    """A batch that is written again changes nothing; a batch that changes is replaced alone."""
    at = lambda n: dt.datetime(2024, 1, n)
    rows = spark.createDataFrame([(1, "x" * 3000, at(1), 7, "d1"), (2, None, at(2), 0, "d1"), (3, "é", at(3), 9, "d2")], "msg_id long, text string, created_at timestamp, risk_score int, batch string")
    factors = spark.createDataFrame([(1, "message_intent", "f", 2.5, "o", "e" * 300, "rule", 0), (3, "url_technical", "g", 1.0, "o", None, "rule", 1), (99, "url_technical", "g", 1.0, "o", None, "rule", 1)], R.FACTOR)
    entities = spark.createDataFrame([(1, "upi", "h1", "A", "raw" * 99, 0.9), (3, "upi", "h1", "B", "raw", 0.9), (3, "url", "h2", "C", "u", 0.8), (1, "upi", "h1", "A", "r", 0.9)], "msg_id long, type string, hash string, display string, raw string, confidence double")
    folder = f"file://{tmp_path}/out"
    state = lambda: {t: sorted(map(str, sinks.read_table(spark, folder, t).collect())) for t in sinks.TABLES}
    sinks.fan_out(rows, factors, entities, folder)
    first = state()
    assert [len(first[t]) for t in sinks.TABLES] == [3, 2, 3, 3, 4]
    sinks.fan_out(rows.where("batch = 'd1'"), factors, entities, folder)
    assert state() == first
    got = {r.entity_id: (r.display_value, r.first_seen, r.last_seen, r.sighting_count) for r in sinks.registry_of(spark, folder).collect()}
    assert got == {"h1": ("A", at(1), at(3), 3), "h2": ("C", at(3), at(3), 1)}
    kept = sinks.read_table(spark, folder, "evidence").where("msg_id = 1").first()
    assert len(kept.redacted_value) == 2000 and sinks.read_table(spark, folder, "risk_factors").agg(F.max(F.length("evidence_span"))).first()[0] == 255
    assert sinks.analysis(spark, folder, 3).first().risk_score == 9 and sinks.analysis(spark, folder, 3, of="d1").count() == 0 and sinks.analysis(spark, folder, 4).count() == 0
    sinks.fan_out(rows.where("batch = 'd2'").withColumn("risk_score", F.lit(1)), factors, entities, folder)
    again = state()
    assert again["analyses"] != first["analyses"] and again["evidence"] == first["evidence"] and sinks.analysis(spark, folder, 1).first().risk_score == 7


def test_generate(spark):
    """Against a plain filling of slots; a slot may be there several times or not at all."""
    slots = {"a": ["x", "yy", "zzz"], "b.c": ["$1", "\\"]}

    def plain(text, turn):
        for name, values in slots.items():
            while "{" + name + "}" in text:
                text = text.replace("{" + name + "}", values[(turn + len(text)) % len(values)], 1)
                turn += 1
        return text

    templates = ["{a} and {a}, {b.c}", "none", "{b.c}{a}{a}{a}é", "{bxc} {", ""]
    rows = spark.createDataFrame([("l", "train", n, t) for n, t in enumerate([*templates, None])], "label string, split string, number int, template string")
    got = sorted((r.template_id, r.text or "") for r in labelled.generate(rows, slots, variants=3).collect())
    want = sorted((f"l:train:{n}", plain(t, n * 7 + v * 3) if t is not None else "") for n, t in enumerate([*templates, None]) for v in range(3))
    assert got == want


def test_entities_in_the_row_of_their_message(spark):
    """Arrays of entities, made rows when they are written, are the entities of ``extract``; copies of a text have them too."""
    rows = spark.createDataFrame([(1, "Pay a.b@ybl now"), (2, None), (3, "Pay a.b@ybl now"), (4, "call 9876543210, see http://x.top/a")], "msg_id long, text string")
    cols = ["msg_id", "type", "hash", "display", "raw", "confidence"]
    got = E.with_hashes(rows.select("msg_id", E.found_in(F.col("text")).alias("found")), "found", "msg_id").select(*cols).collect()
    assert sorted(got) == sorted(E.extract(rows).select(*cols).collect()) and {r.msg_id for r in got} == {1, 3, 4}

"""Quality rules: the DataFrame form against its SQL on a fixture of odd cases."""

import duckdb
import pandas as pd

from sentrail.llm import divergence
from sentrail.llm.oracles import ORACLE_SQL

SF = "/root/testdata/sf0.001"


def both(spark, docs):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = [tuple(r) for r in divergence.judge(docs, keep=["doc_id"]).select(*names).collect()]
    con = duckdb.connect()
    rows = docs.select("doc_id", "text", "lang").collect()
    con.register("documents", pd.DataFrame([tuple(r) for r in rows], columns=["doc_id", "text", "lang"]).astype({"doc_id": "Int64"}))
    want = con.execute(f"select {', '.join(names)} from ({ORACLE_SQL['op2_divergence'].rstrip().rstrip(';')})").fetchall()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    return {r[0]: r for r in got}


def test_odd_cases(spark):
    """Nulls, empty and long texts, unknown languages, both minimum lengths, ties of windows."""
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(80).collect()
    clean = next(r for r in real if r.text and len(r.text) > 2000)
    rows = [tuple(r) for r in real]
    rows += [(9001, None, clean.lang), (9002, "", clean.lang), (9003, " \n\t ", None), (9004, clean.text, None), (9005, clean.text, "xx"), (9006, clean.text * 40, clean.lang)]
    rows += [(9007, clean.text[:300], clean.lang), (9008, clean.text[:299], clean.lang), (9009, " ".join(clean.text.split()[:60]), clean.lang), (9010, " ".join(clean.text.split()[:59]), clean.lang)]
    rows += [(9011, "#$ % |" * 200, clean.lang), (9012, "a b c d e f a b c d e\na b c d e\n\na b c d e", clean.lang), (9013, "ä ö " * 100, clean.lang), (9015, clean.text, clean.lang), (9014, "w", clean.lang)]
    got = both(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got[9001][1:] == (0, 0, 0, 0, 0, True, False)
    assert not got[9011][7]


def test_clashes_and_empty(spark):
    names = "doc_id long, text string, lang string, n_words string, kept string, `a.b` int"
    docs = spark.createDataFrame([(1, "one two", "en", "u", "v", 3)], names)
    got = divergence.judge(docs.unionByName(docs), keep=["doc_id", "a.b"])
    assert [r.doc_id for r in got.collect()] == [1, 1] and got.columns[:2] == ["doc_id", "a.b"]
    assert divergence.judge(docs.limit(0), keep=["doc_id"]).count() == 0

"""Token ids against the tokenizers library; packing and separator scan against plain loops."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrail.llm import packing, sepscan
from sentrail.llm._tokens import Encoder, vocabulary

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a", " a", "a ", "a  b", "a\nb c", "a \n b", "\n x", "it's  ok", "x  y", "漢字 テスト 𝒳", "<|endoftext|> x", "a <|endoftext|>b  <|endoftext|><|endoftext|>", "<|endoftext|", "<|endoftext|>", "don't !! ##a1b2", "word " * 3000]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids(spark, reference):
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    enc = Encoder(vocabulary())
    for text in texts + ODD:
        assert enc.ids(text).tolist() == reference(text)


def cases(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "no id", None), (3, " a", "again"), (99, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string")


def test_pack(spark, reference):
    docs = cases(spark)
    got = packing.pack(docs, with_ids=True).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.offset == 0 and len(r.ids) == r.length and r.length <= 1024 and r.length & (r.length - 1) == 0 for r in got)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    for i, text in enumerate(ODD):
        if i != 3:
            mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
            assert [x for r in mine for x in r.ids] == [*reference(text), 0]
            assert [r.start for r in mine] == np.cumsum([0, *[r.length for r in mine]]).tolist()[:-1]
            assert {r.doc_tokens for r in mine} == {len(reference(text)) + 1}
            assert [r.length for r in mine] == packing.piece_lengths(mine[0].doc_tokens)
    assert [(r.start, r.length) for r in got if r.doc_id == 99] == [(0, 1)]
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block,run", [(1, 1), (3, 2), (7, 1000), (1 << 20, 1024)])
def test_scan(spark, tmp_path, block, run):
    rng = np.random.default_rng(block)
    want = []
    for k, n in enumerate([0, 1, 50, 333]):
        ids = rng.integers(0, 5, n).astype("<u2")  # 4 is the separator
        (tmp_path / f"f{k}.bin").write_bytes(ids.tobytes())
        start, doc = 0, 0
        for i, x in enumerate([*ids, None]):
            if x == 4 or (x is None and i > start):
                want.append((f"f{k}.bin", doc, start, i - start, x == 4))
                start, doc = i + 1, doc + 1
    files = spark.createDataFrame([(str(p), p.stat().st_size) for p in tmp_path.iterdir()] * 2 + [(None, 4)], sepscan.FILE)
    got = sepscan.scan_token_files(files, separator=4, block=block, run=run).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_count(spark):
    """In token files the separator's own string is ordinary text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = cases(spark)
    got = sepscan.count_tokens(docs)
    want = [(r.doc_id or -1, len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got.collect()) == sorted(want)
    assert got.where(~F.col("closed")).count() == 0
    assert sepscan.count_tokens(docs.limit(0)).count() == 0

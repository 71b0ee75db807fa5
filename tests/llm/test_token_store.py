import glob
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from foliant.llm import token_store as ts

TEXTS = [
    "", "plain words, here.", "  two  spaces \n mixed\t\ttabs \n\n", "it's we'll 12 34 5x<|endoftext|> after", "a <|endoftext|>  b",
    "naïve café 日本語 😀 été x   y", "trailing ", " leading", "\n b", "a\x1c b \x1d", "don't  'stop", "one.\nTwo, three\n\nfour\n five\n", "a.\nb!\n.c d.; e? é, 5, x-,", ".", "\n", "a\nb", "x" * 3000, "word " * 5000,
]


def want(rows):
    t = Tokenizer.from_file(ts.VOCABULARY)
    start, out = 0, []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_units_give_the_ids_of_whole_texts():
    t = Tokenizer.from_file(ts.VOCABULARY)
    coder = ts.ByteLevelEncoder(ts.VOCABULARY, remembered=3)
    for _ in range(2):
        got = [np.frombuffer(x, "<i4").tolist() for x in coder.encode(TEXTS)]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in TEXTS]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip(spark, tmp_path, encoding):
    rows = [(7 * i % 13, x) for i, x in enumerate(TEXTS)] + [(100, None), (None, "no id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(d, x, 1, "c") for d, x in rows], "doc_id long, text string, start int, tokens string").repartition(3)
    path = f"{tmp_path}/store"
    ts.write_token_store(docs, path, encoding=encoding)
    got = [tuple(r) for r in ts.token_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == want(rows)
    some = ts.read_token_store(spark, path, "doc_id", "n_tokens", first=4, last=6)
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in some.collect()) == sorted(w[:3] for w in want(rows) if w[0] in (4, 5, 6))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan and "GreaterThanOrEqual(doc_id,4)" in plan
    column = next(c for f in glob.glob(f"{path}/*.parquet") for g in [pq.ParquetFile(f).metadata] if g.num_row_groups for c in [g.row_group(0).column(4)])
    assert column.has_offset_index
    assert any("DICTIONARY" in e for e in column.encodings) == (encoding == "dictionary")
    assert any("DELTA" in e for e in column.encodings) == (encoding == "delta")


def test_empty(spark, tmp_path):
    ts.write_token_store(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/s")
    assert ts.token_digests(spark, f"{tmp_path}/s").collect() == []

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import packing
from foliant.llm.token_store import VOCABULARY


def plain_best_fit(items, capacity):
    """(length, source bit, cluster bit) in order: the tightest compatible bin, by a scan over all bins."""
    bins, out = [], []
    for n, s, c in items:
        fit = [i for i, (left, ss, cc) in enumerate(bins) if left >= n and not ss & s and not cc & c]
        if not fit:
            bins.append((capacity, 0, 0))
            fit = [len(bins) - 1]
        i = min(fit, key=lambda i: bins[i][0])
        left, ss, cc = bins[i]
        out.append(left)
        bins[i] = (left - n, ss | s, cc | c)
    return out, len(bins)


def test_successor_search_is_best_fit():
    rng = random.Random(0)
    for _ in range(30):
        items = [(rng.randrange(1, 60), rng.choice([0, 1, 1, 1, 2, 4]), rng.choice([0, 0, 1, 2])) for _ in range(200)]
        packer = packing.Packer(100)
        left = [100 - packer.place(*x)[1] for x in items]
        want, bins = plain_best_fit(items, 100)
        assert left == want and len(packer.residual) == bins


def check(rows, got, capacity, lengths):
    whole, bins = defaultdict(int), defaultdict(list)
    for r in got:
        whole[r.doc_id] += r.n_tokens
        bins[r.bin_id].append(r)
        assert r.doc_start == r.part * capacity and r.n_tokens > 0
    want = defaultdict(int)
    for (d, _, _), n in zip(rows, lengths, strict=True):
        want[d] += n
    assert whole == want
    for own in bins.values():
        own.sort(key=lambda r: r.bin_start)
        end = 0
        for r in own:
            assert r.bin_start == end
            end += r.n_tokens
        assert end <= capacity
        sources = [r.source for r in own if r.source is not None]
        assert len(sources) == len(set(sources))
    return bins


@pytest.mark.parametrize("shard_rows", [4096, 40])
def test_operator(spark, shard_rows):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["tea", "cup", "leaf"], k=rng.randrange(0, 90))), rng.choice(["hot", "hot", "a", "b", None])) for i in range(300)]
    rows += [(400, None, "a"), (401, "", None), (None, "no id", "b"), (402, "long " * 1000, "a"), (403, "long " * 1000, None), (7, *rows[7][1:]), (7, *rows[7][1:])]
    rows += [(500 + i, "The same  text", None) for i in range(20)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, shard int, n long").repartition(4)
    t = Tokenizer.from_file(VOCABULARY)
    lengths = [len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, _ in rows]
    got = packing.pack_documents(docs, 128, shard_rows=shard_rows).collect()
    bins = check(rows, got, 128, lengths)
    for own in bins.values():
        ids = [r.doc_id for r in own]
        assert sum(d is not None and d >= 500 for d in ids) <= 1 and ids.count(7) <= 1 and ids.count(402) <= 1
    assert sorted(got, key=str) == sorted(packing.pack_documents(docs.repartition(2), 128, shard_rows=shard_rows).collect(), key=str)


def test_lengths_given_and_empty(spark):
    docs = spark.createDataFrame([(1, "x", "s", 5), (2, "y", "t", 6)], "doc_id long, text string, source string, size int")
    got = packing.pack_documents(docs, 11, length=F.col("size")).collect()
    assert {r.bin_id for r in got} == {got[0].bin_id} and [r.n_tokens for r in got] == [6, 5]
    assert packing.pack_documents(docs.limit(0)).collect() == []

import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliant.llm import bpe

LIBRARY = Tokenizer.from_file(bpe.VOCABULARY)
LIBRARY.no_truncation()
LIBRARY.no_padding()
TEXTS = [
    "", "Plain words, HERE.", "  two  spaces \n mixed\t\ttabs \n\n", "it's we'll 12 345x<|endoftext|>after<|startoftext|> b", "a\x1c b\x1d\x1ec",
    "\u2003a\u3000b\u00a0c\u1680d\u2028e\u0085f", "naïve CAFÉ 日本語 😀 été x y İI ΣΑΣ", "don't 'stop 've", "x" * 3000, "ab" * 500 + " " + "é" * 200, "word " * 3000, "@@##$$ a1b2", "́ ​ z",
]


def check(coder, text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    [ids] = coder.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert coder.decode(np.frombuffer(ids, "<u4")) == LIBRARY.decode(want, skip_special_tokens=False)
    values, at, data, ends = coder.round_trip(pa.array([text]))
    assert values.tolist() == want and at.tolist() == [0, len(want)]
    assert data[min(1, ends[1]) :].tobytes().decode() == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(text):
    check(bpe.coder(bpe.VOCABULARY), text)


@given(st.text(st.sampled_from("aAbeéE't's \n,.1<|>endofxtsr日ßΣ́"), max_size=60))
@settings(max_examples=400, deadline=None)
def test_random_texts(text):
    check(bpe.coder(bpe.VOCABULARY), text)


def test_small_memory_changes_nothing():
    coder, rng = bpe.ForcedBoundaryBPE(bpe.VOCABULARY, remembered=2), random.Random(0)
    for _ in range(50):
        check(coder, " ".join("".join(rng.choices("abcdehinorst", k=rng.randrange(1, 90))) for _ in range(8)))


def test_cuts_are_made_and_certain():
    coder = bpe.coder(bpe.VOCABULARY)
    data = np.frombuffer(b"qxjzkvwq", np.uint8)
    starts, final = coder.fragments(data, np.array([4, 4]))
    assert len(starts) > 2 and final.sum() == 2 and final[-1]
    tokens = [t.removesuffix("</w>") for t in LIBRARY.get_vocab()]
    for a in set(starts.tolist()) - {0, 4}:
        assert not any(chr(data[a - 1]) + chr(data[a]) in token for token in tokens)


def test_one_by_one_and_side_by_side_agree():
    coder, rng = bpe.coder(bpe.VOCABULARY), random.Random(1)
    words = ["".join(rng.choices("abcdehinorst", k=rng.randrange(1, 60))) for _ in range(400)]
    ids = [coder.plain[np.frombuffer(w.encode(), np.uint8)] for w in words]
    flat, n = coder.merge(np.concatenate(ids), np.array(list(map(len, ids))))
    got = np.split(flat, np.cumsum(n)[:-1])
    assert [g.tolist() for g in got] == [coder.merge_one(i.tolist()) for i in ids]


def test_operator(spark):
    rows = [(i % 9, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (4, None)]
    docs = spark.createDataFrame([(d, t, 0, "t") for d, t in rows], "doc_id long, text string, n_tokens int, tokens string").repartition(3)
    want = sorted((d is None, d or 0, len(i), sha256(np.array(i, "<u4").tobytes()).hexdigest(), sha256(LIBRARY.decode(i, skip_special_tokens=False).encode()).hexdigest()) for d, t in rows for i in [LIBRARY.encode(t or "", add_special_tokens=False).ids])
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in bpe.bpe_digests(docs).collect()) == want
    assert sum(len(r.tokens) for r in bpe.bpe_round_trip(docs).collect()) == sum(w[2] for w in want)
    assert bpe.bpe_digests(docs.limit(0)).collect() == []

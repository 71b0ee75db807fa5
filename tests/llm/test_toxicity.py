import random
import zlib

import numpy as np
import pytest

from foliant.llm import toxicity

BAD = ["grobble", "fnarded", "splotchy"]


def corpus(n=1200, seed=3):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        own = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(rng.randrange(5, 120))]
        toxic = rng.random() < 0.15
        if toxic:
            own[:: len(own) // 4 + 1] = rng.choices(BAD, k=len(own[:: len(own) // 4 + 1]))
        docs.append((i, " ".join(own)))
        if i % 2:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus()
    truth = {d: any(b in t for b in BAD) for d, t in docs}
    wrong = [(d, q, 1 - t if is_held_out(d) else t) for d, q, t in labels]  # labels of held-out rows must not matter
    frame = spark.createDataFrame([(d, t, "en", 0.1) for d, t in docs], "doc_id long, text string, lang string, score double")
    got = toxicity.toxicity_scores(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    same = toxicity.toxicity_scores(frame, spark.createDataFrame(wrong, "doc_id long, quality int, toxic int")).collect()
    assert sorted(got) == sorted(same)
    assert len(got) == len(docs) and all(r.held_out == is_held_out(r.doc_id) and r.predicted == (r.score >= 0.7) for r in got)
    unseen = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in unseen]) > 0.97


def test_awkward_rows(spark):
    docs, labels = corpus(400)
    rows = docs + [(900, None), (901, ""), (902, " "), (None, "grobble"), (5, docs[5][1]), (903, "word " * 40_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(1, 0, None), (None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(frame, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[900].score == by_id[901].score == by_id[902].score < 0.7 and by_id[None].held_out
    kept = toxicity.drop_toxic(frame, marks)
    assert kept.columns == frame.columns and kept.count() == sum(r.score < 0.7 for r in got)


@pytest.mark.parametrize("labels", [[], [(1, 0, 0), (2, 0, 0)]])
def test_nothing_to_learn(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity_scores(docs, marks).collect()} == {0}
    assert toxicity.toxicity_scores(docs.limit(0), marks).collect() == []


def test_risk_is_corrected_for_the_prior():
    # One feature, on in every positive and in a fifth of the unlabelled texts: with prior 0.2 those are the positives.
    positive = np.r_[np.ones(100, bool), np.zeros(500, bool)]
    rows = np.r_[np.arange(100), 100 + np.arange(100)]
    weights, bias, _ = toxicity.fit_nnpu(rows, np.zeros(200, int), np.zeros(600), positive, 0.2, 1)
    assert bias < -1 and bias + weights[0] > 1

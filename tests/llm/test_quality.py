import math
import random
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import quality


def plain_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search("[^\x20\x09-\x0d]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [None, "", " \n\t", "a b c", "x y z w v " * 3, "line one here\nline one here\n\n \n \nother\nline one here ", "a\x1cb é   c\x85d #*$%&|<> end", "w " * 9000]


@pytest.mark.parametrize("text", TEXTS)
def test_base_counts(text):
    assert quality.base_counts(text or "", quality.split(text or "")) == plain_counts(text)


def test_random_base_counts():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choices(["a", "b", " ", "\n", "a b a b a", "#", "\t"], k=rng.randrange(60)))
        assert quality.base_counts(text, quality.split(text)) == plain_counts(text)


def plain_grams(text):
    """Five bytes that end at each byte of the folded text, by its definition."""
    folded = re.sub(rb"[\x09-\x0d]", b" ", re.sub(rb"[0-9]", b"0", (text or "").encode()))
    folded = re.sub(rb"([\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f])\1+", rb"\1", b" " + folded)[1:]
    whole = b"    " + folded
    return [tuple(whole[i : i + 5]) for i in range(len(folded))]


def plain_discounts(counts):
    n = [sum(c == i for c in counts) for i in range(5)]
    if not (n[1] and n[2]):
        return [0, 0.5, 0.5, 0.5]
    y = n[1] / (n[1] + 2 * n[2])
    raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
    return [0, *(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))]


def plain_model(counts):
    """Modified Kneser-Ney by its definition, over tuples of bytes; returns a function from gram to probability."""
    levels = {5: Counter(counts)}
    for k in (4, 3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    d = {k: plain_discounts(list(c.values())) for k, c in levels.items()}
    after = {k: defaultdict(list) for k in levels}
    for k, c in levels.items():
        for g, n in c.items():
            after[k][g[:-1]].append(n)

    @lru_cache(None)
    def p(g):
        k = len(g)
        below = p(g[1:]) if k > 1 else 1 / 256
        same = after[k].get(g[:-1])
        if not same:
            return below
        n = levels[k].get(g, 0)
        return (n - d[k][min(n, 3)]) / sum(same) + sum(d[k][min(x, 3)] for x in same) / sum(same) * below

    return p


def test_model_is_modified_kneser_ney():
    rng = random.Random(1)
    rows = [" ".join("".join(rng.choices("abcé#", weights=[5, 3, 2, 1, 1], k=rng.randrange(1, 6))) for _ in range(30)) for _ in range(20)]
    key, ends = quality.grams(pa.array(rows))
    packed = lambda g: int.from_bytes(bytes(g), "big")
    assert key.tolist() == [packed(g) for t in rows for g in plain_grams(t)] and ends[-1] == len(key)
    counts = Counter(g for t in rows for g in plain_grams(t))
    model = quality.Perplexity.build(["en"], np.zeros(len(counts), int), np.array([packed(g) for g in counts]), np.array(list(counts.values())))
    p = plain_model(counts)
    for text in ["a", "abc ccé", "zz top", "#a##a# ", "Ab\n\tAB 12", "abcabc9"]:
        key, _ = quality.grams(pa.array([text]))
        assert -model.losses("en", key) == pytest.approx([math.log(p(g)) for g in plain_grams(text)], rel=1e-4)
    assert sorted(model.hashes.tolist()) == model.hashes.tolist() and len(set(model.hashes.tolist())) == len(model.hashes)


@pytest.mark.parametrize("text", [*TEXTS, "a##!!!--b  \n\n 0123 日本語日本語 ßß", "  lead"])
def test_folding(text):
    key, ends = quality.grams(pa.array(["x  ", text, " y"], pa.string()))
    want = [int.from_bytes(bytes(g), "big") for g in plain_grams(text)]
    assert key[ends[1] : ends[2]].tolist() == want


def test_a_pruned_model_backs_off(spark):
    rows = [(i, prose(random.Random(i), ["th", "an", "er"], 60), "en") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole, small = quality.train(docs), quality.train(docs, most=50)
    assert len(small.hashes) < len(whole.hashes)
    key, _ = quality.grams(pa.array([rows[0][1]]))
    assert 0 < quality.Perplexity.losses(whole, "en", key).sum() < small.losses("en", key).sum() < 8 * len(key)


def prose(rng, syllables, n):
    return " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n))


def corpus():
    rng, rows = random.Random(9), []
    for i in range(240):
        lang, syllables = (("en", ["th", "an", "er", "on"]), ("de", ["sch", "un", "ei", "ge"]))[i % 2]
        rows.append((i, prose(rng, syllables, rng.randrange(15, 300)), lang))
    rows += [(1000 + i, re.sub(" ", "### ", rows[20 + i][1]), rows[20 + i][2]) for i in range(3)]  # signs after every word
    salad = lambda: " ".join(rng.choices(["than", "an", "than", "than"], k=1) + rng.sample(["than", "anan", "than", "anth", "than"], 5))
    rows += [(1100 + i, " ".join(salad() for _ in range(60)), "en") for i in range(2)]  # nothing but the commonest words
    rows += [(2000, "", "en"), (2001, None, "en"), (2002, rows[0][1], None), (2003, "th an " * 40, "EN-us"), (None, rows[1][1], "de")]
    return rows


def test_verdicts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, lang string, n_words int, loss string").repartition(5)
    got = quality.quality_verdicts(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    counts = defaultdict(list)
    for d, t, _ in rows:
        r = by_id[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
        counts["junk" if d is not None and 1000 <= d < 2000 else "base" if r.base_failed else "clean"].append(r.kept)
    assert not any(counts["junk"]) and counts["base"]
    # A band of 2.5 deviations above the middle leaves out about one clean document in a hundred.
    assert sum(counts["clean"]) >= 0.97 * len(counts["clean"])
    assert all(by_id[d].perplexity > by_id[d].upper for d in (1000, 1001, 1002)) and all(by_id[d].perplexity < by_id[d].lower for d in (1100, 1101))
    kept = quality.drop_low_quality(docs)
    assert kept.columns == docs.columns
    key = lambda d: (d is None, d)
    assert sorted((r.doc_id for r in kept.collect()), key=key) == sorted((r.doc_id for r in got if r.kept), key=key)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.quality_verdicts(docs).collect() == [] and quality.drop_low_quality(docs).collect() == []


def plain_language(lang):
    m = re.match("^([a-z]{2,3})(?![a-z])", (lang or "").lower())
    return m[1] if m else "und"


def test_verdicts_as_brute_force(spark):
    """Models, perplexities, bands and verdicts computed from their definitions, without Spark or arrays."""
    rng, rows = random.Random(21), []
    for i in range(150):
        lang, syllables = (("en", ["th", "an", "er"]), ("de", ["sch", "un", "ei"]), (None, ["ka", "Lo"]))[i % 3]
        text = prose(rng, syllables, rng.randrange(5, 80))
        if i % 20 == 7:
            text = text.replace(" ", "## ") if i % 40 == 7 else text.upper()
        rows.append((i, text, lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}

    counts = defaultdict(Counter)
    for _, t, lang in rows:
        counts[plain_language(lang)].update(plain_grams(t))
    models, x, failed = {lang: plain_model(c) for lang, c in counts.items()}, {}, {}
    for d, t, lang in rows:
        own = plain_grams(t)
        x[d] = -sum(math.log(models[plain_language(lang)](g)) for g in own) / len(own)
        n, *_, repeated = plain_counts(t)
        failed[d] = n < 10 or 100 * repeated > 20 * n
        assert got[d].perplexity == pytest.approx(math.exp(x[d]), rel=1e-4) and got[d].base_failed == failed[d]
    middle = lambda v: sorted(v)[math.ceil(len(v) / 2) - 1]
    for lang in counts:
        own = [(d, len(t.split())) for d, t, g in rows if plain_language(g) == lang]
        mid = middle([x[d] for d, _ in own if not failed[d]])
        off = {d: (x[d] - mid) * math.sqrt(n) for d, n in own if not failed[d]}
        low, high = (w * max(1.4826 * middle([abs(o) for o in off.values() if s * o > 0]), 0.05) for s, w in ((-1, 5.0), (1, 2.5)))
        for d, n in own:
            assert got[d].kept == (not failed[d] and mid - low / math.sqrt(n) <= x[d] <= mid + high / math.sqrt(n))
            assert got[d].lower == pytest.approx(math.exp(mid - low / math.sqrt(n)), rel=1e-3)
            assert got[d].upper == pytest.approx(math.exp(mid + high / math.sqrt(n)), rel=1e-3)
    assert 0 < sum(r.kept for r in got.values()) < len(rows)


def test_verdicts_are_those_of_the_whole_model_whatever_workers_hold(spark):
    """N-grams that workers don't hold count by their own probabilities, not by back-off."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    verdicts = lambda most: sorted((r.asDict() for r in quality.quality_verdicts(docs, most=most).collect()), key=str)
    whole = verdicts(quality.MAX_GRAMS)
    for most in (0, 60):
        model, rest = quality.fit(docs, most)
        assert len(model.hashes) <= most and not rest.isEmpty()
        for a, b in zip(whole, verdicts(most), strict=True):
            assert {k: v for k, v in a.items() if not isinstance(v, float)} == {k: v for k, v in b.items() if not isinstance(v, float)}
            assert [b[k] for k in ("perplexity", "lower", "upper") if a[k] is not None] == pytest.approx([a[k] for k in ("perplexity", "lower", "upper") if a[k] is not None], rel=1e-4)
        kept = sorted(map(str, (r.doc_id for r in quality.drop_low_quality(docs, most=most).collect())))
        assert kept == sorted(str(r["doc_id"]) for r in whole if r["kept"])

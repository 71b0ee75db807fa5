import random
import re
from itertools import combinations

import numpy as np

import corpus_pipeline
from foliant.llm import near_duplicates as nd
from foliant.llm.components import smallest_reachable
from foliant.llm.simhash import simhash_dedup


def plain_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def plain_components(rows):
    """Smallest id reachable over pairs of a Jaccard similarity of at least 0.8, by comparing all pairs."""
    sets, root = {d: plain_set(t) for d, t in rows}, {d: d for d, _ in rows}
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if 10 * both >= 8 * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {d: low if r == high else r for d, r in root.items()}
    return root


def family_rows():
    rng, rows = random.Random(4), []
    for i in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        rows.append((i * 100, " ".join(words)))
        for j in range(1, 1 + i % 7):  # copies of copies, with more and more words changed
            for _ in range(rng.randrange(1, 1 + len(words) // 60 + i % 3)):
                words[rng.randrange(len(words))] = "changed"
            rows.append((i * 100 + j, " ".join(words)))
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (9003, "One two"), (9004, "one TWO"), (9005, "one two three")]


def test_groups_as_brute_force(spark):
    rows = family_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows] + [(None, rows[0][1], "x"), (*rows[1], "x")], "doc_id long, text string, node string").repartition(4)
    got = nd.near_duplicate_groups(docs).collect()
    want = plain_components(rows)
    assert len(got) == len(rows) + 1 and {r.doc_id: r.component_id for r in got} == want
    assert 60 < len(set(want.values())) < len(rows) - 40
    kept = nd.near_duplicate_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, *sorted(set(want.values()))]


def test_stage_drops_copies_with_a_few_words_changed(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    near = [*words[:100], "another", *words[101:200], "word", *words[201:]]  # 10 of 296 shingles: similarity 0.93
    far = [x if i % 20 else "another" for i, x in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicate_dedup(docs).collect() == []


def test_rows_repeated_under_one_id_lose_no_text(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(3, a, 1), (5, a, 2), (5, b, 3), (5, b, 4), (7, b, 5)], "doc_id long, text string, part int")
    for dedup in (nd.near_duplicate_dedup, simhash_dedup):
        assert sorted((r.doc_id, r.text == a) for r in dedup(docs).collect()) == [(3, True), (5, False)]


def test_candidates_come_from_the_gray_index_and_large_groups_in_blocks(spark):
    """Near copies of one text that are similar by 0.5 to 0.95 are compared in blocks, as by brute force; only the index yields candidates."""
    rng, rows = random.Random(12), []
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 2, 6, 9])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_components(rows)
    assert 3 < len(set(want.values())) < 140
    for block in (8, 40, 512):
        assert {r.doc_id: r.component_id for r in nd.near_duplicate_groups(docs, block=block).collect()} == want
    route, prints = np.zeros(len(rows), np.int64), nd.fingerprints([nd.shingles(t) for _, t in rows])
    node = np.arange(len(rows))
    for limit in (5, 20, 40, nd.bit_limit(80)):
        near = {(a, b) for a in range(150) for b in range(150) if np.bitwise_count(prints[a] ^ prints[b]).sum() <= limit}
        edges = nd.candidate_forest(route, node, prints, limit)
        assert len(edges[0]) < len(rows)
        parts = lambda u, v: sorted(map(tuple, np.stack(smallest_reachable(np.array(u, int), np.array(v, int)), axis=1).tolist()))
        some = [(a, b) for a, b in near if a != b]
        assert parts(*edges) == parts([a for a, _ in some], [b for _, b in some])


def test_fingerprints_are_majorities_and_similar_sets_stay_within_the_limit():
    rng = random.Random(2)
    sets = [np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)) for n in (1, 2, 5, 254, 255, 256, 700)]
    for own, print_ in zip(sets, nd.fingerprints(sets), strict=True):
        for word in range(nd.WIDTH):
            hashed = [int(x) for x in nd._mixed((own ^ nd._flips[word]) * nd._factors[word])]
            assert int(print_[word]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))
    missed, met, recall = 0, 0, []
    bits, masks = nd.layout(200_000)
    chosen = nd.route_masks(bits, masks)
    for _ in range(400):
        n = rng.randrange(10, 400)
        every = np.unique(np.array([rng.getrandbits(64) for _ in range(10 * n)], np.uint64))
        a, b = nd.fingerprints([every[: 9 * n], every[n:]])  # 8 of 10: similarity 0.8
        missed += np.bitwise_count(a ^ b).sum() > nd.bit_limit(80)
        met += not ((a ^ b) & chosen).any(axis=1).all()
        recall.append(1 - (1 - (1 - int(np.bitwise_count(a ^ b).sum()) / 256) ** bits) ** masks)
    assert not missed and met >= 399 and sum(recall) / 400 > 0.9999


def test_the_filter_passes_all_its_ids(spark):
    ids = [random.Random(5).getrandbits(64) - (1 << 63) for _ in range(500)] + [-1, 0, 63, 1 << 40]
    words = nd._filter(spark.createDataFrame([(i,) for i in ids], "id long"))
    assert nd._passes(words, np.array(ids)).all() and nd._passes(words, np.arange(1000, 2000)).sum() < 20

from collections import Counter

import numpy as np
import pytest

from foliant.llm import embedding_dedup as ed


def brute(rows, threshold=0.93):
    ok = [v is not None and lab is not None and i is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    root = {i: i for i, _, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = Counter()
    for a, (i, _, la) in enumerate(rows):
        for b, (j, _, lb) in enumerate(rows[:a]):
            if ok[a] and ok[b] and la == lb and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                n[a] += 1
                n[b] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i is None, i or 0, n[a], None if i is None else find(i), i is not None and find(i) == i) for a, (i, _, _) in enumerate(rows))


def vectors(seed=0, n=500, dim=32):
    rng, rows = np.random.default_rng(seed), []
    while len(rows) < n:
        base = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 6)):
            v = base + rng.standard_normal(dim) * rng.choice([0, 0.1, 0.2, 0.3])
            rows.append((len(rows) * 7 % 1009, (v * rng.choice([0.5, 1, 3])).astype(np.float32).tolist(), int(rng.integers(2))))
    return rows


def run(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, n_links int").repartition(3)
    got = ed.embedding_groups(frame, **options).collect()
    return sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got)


@pytest.mark.parametrize("block", [2048, 3])
def test_as_brute_force(spark, block):
    rows = vectors()
    assert run(spark, rows, block=block, recall=0.999999) == brute(rows)


def test_awkward_rows(spark):
    v = [1.0, 2.0, 0.0]
    rows = [(5, v, 1), (3, [2.0, 4.0, 0.0], 1), (9, v, 2), (1, v, None), (2, None, 1), (4, [0.0, 0.0, 0.0], 1), (6, [float("nan"), 1.0, 1.0], 1), (7, [float("inf"), 1.0, 1.0], 1), (8, [None, 1.0, 2.0], 1), (10, [], 1), (11, [1.0, 2.0], 1), (None, v, 1), (12, v, 2), (12, v, 2), (13, [1e-30, 2e-30, 0.0], 1), (14, [3e38, 3e38, 3e38], 1)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_hot_group_of_near_copies(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(16)
    rows = [(i, (base + 0.15 * rng.standard_normal(16)).astype(np.float32).tolist(), 1) for i in range(400)] + [(1000 + i, base.tolist(), 1) for i in range(150)]
    assert run(spark, rows, block=64, recall=0.999999) == brute(rows)


def test_layout_reaches_the_recall():
    for n in (10, 10_000, 10**8):
        width, k, tables = ed.layout(n)
        assert 1 - (1 - ed.collision(np.sqrt(2 - 2 * 0.93), width) ** k) ** tables >= ed.RECALL


@pytest.mark.parametrize("n, dim", [(10_000, 16), (10_000, 64), (10**6, 32)])
def test_recall_of_pairs_just_above_the_threshold(n, dim):
    """Pairs at cosines from 0.93 to 0.94, hashed as the operator hashes for n vectors: found in some table."""
    rng = np.random.default_rng(dim)
    a = rng.standard_normal((3000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((3000, dim))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.93, 0.94, (3000, 1))
    b = cosine * a + np.sqrt(1 - cosine**2) * side
    layout = ed.layout(n)
    assert (ed.codes(a, *layout) == ed.codes(b, *layout)).any(axis=1).mean() >= 0.99


def test_links_found_as_shipped(spark):
    rows = vectors(seed=5, n=700)
    got, want = run(spark, rows), brute(rows)
    assert sum(w[2] for w in want) > 700
    assert sum(g[2] for g in got) >= 0.99 * sum(w[2] for w in want) and all(g[2] <= w[2] for g, w in zip(got, want, strict=True))


def test_chance_mates_stay_bounded_at_every_size():
    for n in (10**6, 10**9, 10**11):
        width, k, tables = ed.layout(n)
        assert n * tables * ed.collision(np.sqrt(2), width) ** k <= ed.CHANCE

import random
import re

import numpy as np
import pytest
import xxhash

from foliant.llm import simhash
from foliant.llm.components import connected_components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    spans = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def plain_components(prints, ids):
    """prints and ids of equal length; the smallest reachable id of each."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return [best.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("text", ["", " \t\n", "one", "One two", "a b c", "A É b c d e f", "x " * 5000, None])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == plain_fingerprint(text)


def family(rng, n):
    """Fingerprints of which many lie within a few bits of one another."""
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            out.add(x)
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)[:n]


def test_index_finds_every_pair():
    rng = random.Random(1)
    prints = np.array(family(rng, 600), np.uint64)
    route = np.array([rng.randrange(3) for _ in prints])
    index = simhash.GrayIndex(route, prints)
    found = set()
    for i, j in index.links(2):
        found |= {frozenset(map(int, p)) for p in zip(index.prints[i], index.prints[j], strict=True)}
    want = {
        frozenset((int(a), int(b)))
        for i, a in enumerate(prints)
        for j, b in enumerate(prints[:i])
        if route[i] == route[j] and (int(a) ^ int(b)).bit_count() <= 2
    }
    assert want and found == want


@pytest.mark.parametrize("route_rows", [4096, 3])
def test_links_connect_as_brute_force(spark, route_rows):
    prints = family(random.Random(2), 300)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.simhash_links(spark.createDataFrame([(p,) for p in signed], "fp long"), route_rows=route_rows)
    got = dict(connected_components(links).collect())
    assert [got.get(p, p) for p in signed] == plain_components(prints, signed)


def test_groups_on_awkward_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base), (9, base + " tail"), (7, None), (8, ""), (1, "alone here now"), (1, "alone here now"), (None, base), (2, "ALONE here NOW")]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, fp string, component_id string")
    got = simhash.simhash_groups(docs).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    want = plain_components(prints, [d for d, _ in rows])
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=key) == sorted(
        ((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, want, strict=True)), key=key
    )
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted(
        (d is None, d) for d in {d for (d, _), c in zip(rows, want, strict=True) if d is None or d == c}
    )


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(docs).collect() == []


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(7, 7), (3, 4)], "a long, b long").repartition(8)
    got = connected_components(edges).collect()
    assert len(got) == 301 and {r.component for r in got} == {0}

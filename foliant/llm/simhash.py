"""SimHash near-duplicates through a Gray-order hierarchical index.

Every fingerprint is routed by six masks of 32 bits (two of four 16-bit blocks): of two fingerprints that differ in at
most two bits, at least two blocks agree, so the pair meets under some mask and the search is exact.  Inside a route
the distinct fingerprints are sorted by Gray rank, neighbours are grouped, and each group becomes a node holding the
bits its members share (mask and pattern).  A search descends from pairs of upper nodes, adds the differences on bits
that became shared at each level, and drops the whole pair of groups once they exceed the limit.

Links found in a task leave it as a spanning forest, never as all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, forest
from .runtime import materialise, texts

WORDS_PER_SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Members of a node of the index.
FANOUT = 8
#: A route with more distinct fingerprints is split by the next set of masks.
ROUTE_ROWS = 4096
#: Rows sorted into one index at a time, and node pairs expanded at a time: these bound a task's memory.
CHUNK, FRONTIER = 50_000, 2_000_000


def fingerprint(text: str, width: int = WORDS_PER_SHINGLE) -> int:
    """SimHash of a whole text over lower-cased (A-Z) word shingles, repeats included; no words: 0."""
    words = text.encode().lower().split()
    if len(words) > width:
        spans = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    elif words:
        spans = [b" ".join(words)]
    else:
        return 0
    hashed = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in spans), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashed), 65_536):
        part = hashed[i : i + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashed), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter(map(fingerprint, texts(batch.column(1))), np.uint64, batch.num_rows)
        more = batch.schema.names[2:]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *more])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def gray_order(route: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Order by route and Gray rank; of prints with several words the first word is the highest."""
    if prints.ndim == 1:
        return np.lexsort((gray_rank(prints), route))
    ranks = [gray_rank(prints[:, 0])]
    for word in range(1, prints.shape[1]):  # the rank goes on from the last bit of the word before
        ranks.append(gray_rank(prints[:, word]) ^ -(ranks[-1] & np.uint64(1)))
    return np.lexsort((*ranks[::-1], route))


def ones(x: np.ndarray) -> np.ndarray:
    """Number of bits set in each fingerprint."""
    return np.bitwise_count(x) if x.ndim == 1 else np.bitwise_count(x).sum(1, dtype=np.int64)


class GrayIndex:
    """Hierarchical index over fingerprints (a word, or a row of words), each with a route; links are sought within a route.

    ``levels[0]`` holds the fingerprints themselves (all bits in the mask), the last level one node a route.
    """

    def __init__(self, route: np.ndarray, prints: np.ndarray):
        self.order = gray_order(route, prints)
        self.prints, route = prints[self.order], route[self.order]
        self.route = route
        self.levels = [(np.full(prints.shape, ~np.uint64(0)), self.prints)]
        self.children: list[np.ndarray] = []  # of level k + 1: where each node's children start in level k
        while len(route) and (route[1:] == route[:-1]).any():
            starts = np.flatnonzero(np.r_[True, route[1:] != route[:-1]])
            rank = np.arange(len(route)) - np.repeat(starts, np.diff(np.r_[starts, len(route)]))
            first = np.flatnonzero(rank % FANOUT == 0)
            mask, pattern = self.levels[-1]
            all_ones = np.bitwise_and.reduceat(pattern, first)
            any_ones = np.bitwise_or.reduceat(pattern, first)
            shared = np.bitwise_and.reduceat(mask, first) & ~(all_ones ^ any_ones)
            self.levels.append((shared, all_ones & shared))
            self.children.append(np.r_[first, len(route)])
            route = route[first]

    def _shared(self, part: np.ndarray) -> list[np.ndarray]:
        """For each level the part that all fingerprints below a node are in, or -1."""
        out = [part]
        for start in self.children:
            low, high = (f.reduceat(out[-1], start[:-1]) for f in (np.minimum, np.maximum))
            out.append(np.where(low == high, low, -1))
        return out

    def links(self, limit: int, part: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i < j) of fingerprints of one route that differ in at most ``limit`` bits, in blocks.

        With ``part``, a number for each position, links inside a part are not sought.
        """
        top = len(self.levels) - 1
        frontier = FRONTIER // self.prints[:1].size if self.prints.ndim > 1 and len(self.prints) else FRONTIER
        shared = self._shared(part) if part is not None else None
        nodes = np.arange(len(self.levels[top][0]))
        stack = [(top, nodes, nodes, np.zeros(len(nodes), np.int64))]
        while stack:
            level, a, b, differ = stack.pop()
            if level == 0:
                yield a, b
                continue
            if len(a) > frontier // FANOUT**2 and len(a) > 1:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half], differ[:half]), (level, a[half:], b[half:], differ[half:])]
                continue
            start = self.children[level - 1]
            na, nb = start[a + 1] - start[a], start[b + 1] - start[b]
            pair = np.repeat(np.arange(len(a)), na * nb)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            x, y = start[a][pair] + at // nb[pair], start[b][pair] + at % nb[pair]
            once = (x < y) | ((x == y) & (level > 1))
            if shared is not None:
                once &= (shared[level - 1][x] != shared[level - 1][y]) | (shared[level - 1][x] < 0)
            x, y, pair = x[once], y[once], pair[once]
            mask, pattern = self.levels[level - 1]
            above = self.levels[level][0]
            new = mask[x] & mask[y] & ~(above[a] & above[b])[pair]  # bits not yet counted further up
            differ = differ[pair] + ones((pattern[x] ^ pattern[y]) & new)
            near = differ <= limit
            stack.append((level - 1, x[near], y[near], differ[near]))


def _masks(bits: list[int], blocks: int, agree: int) -> list[int]:
    """Masks over ``bits`` for every choice of ``agree`` of ``blocks`` runs."""
    runs = np.array_split(np.array(bits), blocks)
    return [sum(1 << int(b) for run in chosen for b in run) for chosen in combinations(runs, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _link(limit: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(route: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
            index, u, v = GrayIndex(route, prints), np.zeros(0, np.int64), np.zeros(0, np.int64)
            signed = index.prints.view(np.int64)
            for i, j in index.links(limit):
                u, v = forest(np.concatenate([u, signed[i]]), np.concatenate([v, signed[j]]))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            t, key, fp = (batch.column(k).to_numpy() for k in range(3))
            held.append(np.stack([t.astype(np.int64), key, fp]))
            n += batch.num_rows
            if n >= CHUNK:  # whole routes only: the last one may go on in the next batch
                rows = np.concatenate(held, axis=1)
                change = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]))
                cut = change[-1] + 1 if len(change) else 0
                yield from found(*_routes(rows[:, :cut]))
                held, n = [rows[:, cut:]], rows.shape[1] - cut
        if held:
            yield from found(*_routes(np.concatenate(held, axis=1)))

    return link


def _routes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    change = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
    return np.cumsum(np.r_[0, change]) if rows.shape[1] else np.zeros(0, np.int64), rows[2].view(np.uint64)


def _routed(rows: DataFrame, masks: dict[int, dict[int, int]]) -> DataFrame:
    """A row for each fingerprint and new mask; ``masks`` gives, for each t of ``rows``, the new t and their masks."""

    def structs(new: dict[int, int]) -> str:
        return "array(" + ", ".join(f"struct({t} AS t, fp & {_signed(m)}L AS key)" for t, m in new.items()) + ")"

    choice = " ".join(f"WHEN {t} THEN {structs(new)}" for t, new in masks.items())
    return rows.selectExpr("fp", f"inline(CASE t {choice} END) AS (t, key)").select("t", "key", "fp")


def simhash_links(prints: DataFrame, limit: int = MAX_BITS, route_rows: int = ROUTE_ROWS) -> DataFrame:
    """Edges ``(u, v)`` that connect the distinct fingerprints ``fp`` as links of at most ``limit`` (2) bits do.

    A route with more than ``route_rows`` fingerprints is divided by masks over its free bits, of which one in three
    runs must agree as well.  The three levels fix 32, 10 and 7 bits at least, so that no route can hold more than
    2**15 distinct fingerprints, whatever the data; nothing is capped.
    """
    if limit != 2:
        raise ValueError("the masks are laid out for links of at most 2 differing bits")
    bits = range(64)
    level = dict(enumerate(_masks(list(bits), 4, 2)))
    routed, parts = _routed(prints.selectExpr("0 AS t", "fp"), {0: level}), []
    for _ in range(2):
        sizes = routed.groupBy("t", "key").count()
        large = materialise(sizes.where(F.col("count") > route_rows).select("t", "key"), "large-routes")
        if large.isEmpty():
            break
        parts.append(routed.join(large, ["t", "key"], "left_anti"))
        ids = count(max(level) + 1)
        finer = {t: {next(ids): m | x for x in _masks([b for b in bits if not m >> b & 1], 3, 1)} for t, m in level.items()}
        routed = materialise(_routed(routed.join(large, ["t", "key"], "left_semi"), finer), "finer-routes")
        level = {t: m for new in finer.values() for t, m in new.items()}
    dealt = reduce(DataFrame.union, [*parts, routed]).repartition("t", "key").sortWithinPartitions("t", "key")
    return dealt.mapInArrow(_link(limit), "u long, v long")


def simhash_groups(docs: DataFrame, limit: int = MAX_BITS, *more: Column) -> DataFrame:
    """Fingerprint and component of every row of ``docs`` (columns ``doc_id``, ``text``; others are ignored).

    Returns ``doc_id, fingerprint, component_id``: a row for each input row, repeated rows included.  A null or empty
    text, or one without words, has the zero fingerprint, which links like any other.  ``component_id`` is the smallest
    doc_id reachable over links of at most ``limit`` differing bits; a null doc_id never is one, and a component of
    rows without ids has a null ``component_id``.  An empty table gives an empty table.  ``more`` are long columns that
    go with the rows.
    """
    extra = [c for c in docs.select(*more).columns] if more else []
    schema = "doc_id long, fp long" + "".join(f", {c} long" for c in extra)
    own = materialise(docs.select("doc_id", "text", *more).mapInArrow(_fingerprints, schema), "fingerprints")
    prints = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = connected_components(simhash_links(prints.select("fp"), limit))
    linked = prints.join(roots, prints.fp == roots.node).select("fp", "component", "first_id")
    smallest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    joined = linked.join(smallest, "component").select("fp", "component_id")
    ids = materialise(prints.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("id")), "ids")
    return own.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("id").alias("component_id"), *extra
    )


def simhash_dedup(docs: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """``docs``, with all its columns, less the rows whose component holds a row with a smaller doc_id.

    One row of each component stays: of those with its smallest doc_id the one with the smallest fingerprint and text.
    A row without doc_id can't be told from others and stays.
    """
    groups = simhash_groups(docs.withColumn("text", F.coalesce("text", F.lit(""))), limit, F.xxhash64("text").alias("h"))
    return one_of_each(docs, groups.select("doc_id", "h", F.col("component_id").alias("part"), F.col("fingerprint").alias("rank")))


def one_of_each(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """``docs`` less all rows but one of each part of ``placed``, whose ``doc_id, h`` name rows by id and hash of the text.

    Of rows that are equal in both, one stays.
    """
    named = placed.where("doc_id IS NOT NULL")
    keep = named.groupBy("part").agg(F.min(F.struct("doc_id", "rank", "h")).alias("first"), F.count("*").alias("n"))
    keep = materialise(keep.select("first.doc_id", "first.h", "n"), "kept-rows")
    own = docs.withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    on = (own["doc_id"] == keep["doc_id"]) & (own["_h"] == keep["h"])
    stay = own.join(keep, on, "left_semi")
    again = named.groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h")
    again = materialise(again, "repeated-rows")
    if not again.isEmpty():
        double = (stay["doc_id"] == again["doc_id"]) & (stay["_h"] == again["h"])
        stay = stay.join(again, double, "left_anti").unionByName(stay.join(again, double, "left_semi").dropDuplicates(["doc_id", "_h"]))
    return stay.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))

"""Near-duplicates: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash through the Gray-order hierarchical index, as for op1, in general width and limit.  A set
has a fingerprint of 256 bits; two sets at 0.8 differ in about 15 in a hundred, unrelated ones in half.  Fingerprints are
routed by masks of random bits, of which there are enough for a pair at 0.8 to meet with probability 0.9999, and each
route is searched for fingerprints within a limit that such pairs keep.  A task gives out a spanning forest of what it
finds, so that no pair of a group becomes a row.

Candidate components are then compared exactly, on the whole sets, inside tasks: large ones first in blocks that all hold
the component's smallest node, then, between the parts that this leaves apart, as pairs of blocks.  Nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components, smallest_reachable
from .runtime import materialise, texts
from .simhash import FANOUT, GrayIndex, one_of_each, ones

WORDS_PER_SHINGLE, SEED = 5, 42
#: Similarity in percent.
LEAST = 80
#: Words of 64 bits in a fingerprint.
WIDTH = 4
#: Probability that a pair at the least similarity meets in a route, and fingerprints expected in a route by chance.
RECALL, CHANCE = 0.9999, 512
#: Limit in standard deviations above the bits that differ in the mean, and what small sets differ in besides (share of
#: bits: a bit is a majority, which an even number of shingles may miss).
DEVIATIONS, SMALL = 4.5, 0.01
#: Share of bits above the mean for which masks are laid out, as pairs that differ in more bits than most meet less often.
SPREAD = 0.035
#: Rows sorted into one index at a time, and shingles fingerprinted at a time: these bound a task's memory.
CHUNK, SHINGLES = 50_000, 100_000
#: Documents of a block, and their shingles.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Bits of the filter that tells which texts are needed again; where it gets full, more texts pass, and a join drops them.
FILTER_BITS = 26

_rng = np.random.default_rng(SEED)
_flips, _factors = _rng.integers(0, 1 << 64, WIDTH, np.uint64), _rng.integers(0, 1 << 64, WIDTH, np.uint64) | np.uint64(1)
_BYTES = np.uint64(0x0101010101010101)
PRINT = [f"fp{i}" for i in range(WIDTH)]
PRINT_SCHEMA = ", ".join(f"{c} long" for c in PRINT)


def shingles(text: str, width: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct lower-cased (A-Z) shingles of a whole text; a shorter text is one shingle."""
    words = text.encode().lower().split()
    spans = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) > width else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in spans), np.uint64))


def similar(both: np.ndarray, a: int, b: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Whether sets of these sizes, with ``both`` shingles in common, are similar."""
    return 100 * both >= least * (a + b - both)


def differing(least: int) -> float:
    """Share of bits in which the fingerprints of two sets of one size and of the least similarity differ in the mean."""
    return math.acos(2 * least / (100 + least)) / math.pi


def bit_limit(least: int) -> int:
    share, bits = differing(least), 64 * WIDTH
    return math.ceil(bits * (share + SMALL) + DEVIATIONS * math.sqrt(bits * share * (1 - share)))


def layout(n: int, least: int = LEAST) -> tuple[int, int]:
    """Bits of a mask, and masks, for n fingerprints."""
    bits = max(8, math.ceil(math.log2(max(n, 1) / CHANCE)))
    meet = (1 - differing(least) - SPREAD) ** bits
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - meet)))


def route_masks(bits: int, masks: int) -> np.ndarray:
    """Rows of words with ``bits`` random bits set; a set of more masks begins with those of a smaller one."""
    rng, out = np.random.default_rng([SEED, bits]), np.zeros((masks, WIDTH), np.uint64)
    for row in out:
        for bit in rng.choice(64 * WIDTH, bits, replace=False).tolist():
            row[bit // 64] |= np.uint64(1 << bit % 64)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prints(sets: list[np.ndarray]) -> np.ndarray:
    sizes = np.array(list(map(len, sets)))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # Bits are counted in the bytes of a word, 255 shingles at most at a time.
    runs = np.concatenate([np.arange(a, b, 255) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    first = np.searchsorted(runs, starts)
    every, out = np.concatenate(sets), np.zeros((len(sets), WIDTH), np.uint64)
    for word in range(WIDTH):
        hashed = _mixed((every ^ _flips[word]) * _factors[word])
        for shift in range(8):
            packed = np.add.reduceat((hashed >> np.uint64(shift)) & _BYTES, runs)
            counts = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
            over = (2 * counts > sizes[:, None]).astype(np.uint8)
            out[:, word] |= over.reshape(-1).view(np.uint64) << np.uint64(shift)
    return out


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of each set (none is empty), a row of words: a bit is 1 if set in over half of the hashes."""
    out, held, size = [np.zeros((0, WIDTH), np.uint64)], [], 0
    for own in sets:
        held.append(own)
        size += len(own)
        if size > SHINGLES:
            out.append(_prints(held))
            held, size = [], 0
    return np.concatenate([*out, _prints(held)]) if held else np.concatenate(out)


def _node(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            sets = list(map(shingles, texts(some.column(1))))
            prints = fingerprints(sets).view(np.int64)
            columns = [some.column(0), some.column(2), pa.array(map(_node, sets), pa.int64()), pa.array(map(len, sets), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(c)) for c in prints.T)], names=["doc_id", "h", "node", "n", *PRINT])


def _filter(ids: DataFrame) -> np.ndarray:
    """Bits set at the lowest bits of the ids (``id``), as words: at most 2**(FILTER_BITS - 6) rows come to the driver."""
    at = F.col("id").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bit = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    rows = ids.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _passes(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = ids & ((1 << FILTER_BITS) - 1)
    return words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1


def _sets(words: np.ndarray):
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1).filter(pa.array(_passes(words, batch.column(0).to_numpy())))
            for at in range(0, len(text), 500):
                sets = list(map(shingles, texts(text.slice(at, 500))))
                columns = [pa.array(map(_node, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "held"])

    return sets_of


def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in names], axis=1)


def _routed(bits: int, masks: int):
    """A row for each fingerprint and mask; keys of different masks differ as well."""

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = route_masks(bits, masks)
        for batch in batches:
            prints = np.ascontiguousarray(_columns(batch, PRINT)).view(np.uint64)
            for t in range(masks):
                key = np.full(len(prints), t, np.uint64)
                for word in range(WIDTH):
                    key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + (prints[:, word] & chosen[t, word]))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(batch.column(c) for c in ["node", *PRINT])], names=["key", "node", *PRINT])

    return routed


def candidate_forest(route: np.ndarray, node: np.ndarray, prints: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect nodes as do the pairs of one route that differ in at most ``limit`` bits.

    Neighbours in Gray order are joined first; the index then only looks between the parts that this leaves.
    """
    index = GrayIndex(route, prints)
    left, right = [], []
    for step in range(1, FANOUT + 1):
        some = np.flatnonzero(index.route[step:] == index.route[:-step])
        some = some[ones(index.prints[some] ^ index.prints[some + step]) <= limit]
        left.append(some)
        right.append(some + step)

    def joined() -> np.ndarray:
        part = np.arange(len(node))
        found, root = smallest_reachable(np.concatenate(left), np.concatenate(right))
        part[found] = root
        off = np.flatnonzero(part != np.arange(len(part)))
        left[:], right[:] = [off], [part[off]]
        return part

    for i, j in index.links(limit, joined()):
        left.append(i)
        right.append(j)
        if len(left) > 50:
            joined()
    joined()
    own = node[index.order]
    return own[left[0]], own[right[0]]


def _candidates(limit: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            route = np.cumsum(np.r_[0, rows[1:, 0] != rows[:-1, 0]]) if len(rows) else np.zeros(0, np.int64)
            # Most fingerprints are alone in their route.
            size = np.bincount(route) if len(route) else route
            rows, route = rows[size[route] > 1], route[size[route] > 1]
            if len(rows):
                u, v = candidate_forest(route, rows[:, 1], np.ascontiguousarray(rows[:, 2:]).view(np.uint64), limit)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            held.append(_columns(batch, ["key", "node", *PRINT]))
            n += batch.num_rows
            if n >= CHUNK:  # whole routes only: the last one may go on in the next batch
                rows = np.concatenate(held)
                change = np.flatnonzero(rows[1:, 0] != rows[:-1, 0])
                cut = change[-1] + 1 if len(change) else 0
                yield from found(rows[:cut])
                held, n = [rows[cut:]], len(rows) - cut
        if held:
            yield from found(np.concatenate(held))

    return link


class _Block:
    """Sets of one group with their places in its list of shingles."""

    def __init__(self, rows: list[dict[str, np.ndarray]]):
        self.block, self.node, self.part, self.n = (np.concatenate([r[c] for r in rows]) for c in ("block", "node", "part", "n"))
        self.prints = np.concatenate([r["prints"] for r in rows])
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for r in rows for x in r["held"]]
        self.codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.distinct = int(self.codes.max()) + 1
        self.starts = np.cumsum(self.n) - self.n

    def own(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of some rows, and where those of each begin."""
        n = self.n[some]
        starts = np.cumsum(n) - n
        return self.codes[np.repeat(self.starts[some] - starts, n) + np.arange(n.sum())], starts

    def links(self, i: int, j: int, least: int, limit: int) -> tuple[list[int], list[int]]:
        """Similar pairs that connect what those between the blocks i and j, of different parts, connect."""
        part = np.unique(self.part, return_inverse=True)[1]
        right = np.flatnonzero(self.block == j)
        prints, held, starts = self.prints[right], *self.own(right)
        marked = np.zeros(self.distinct, bool)
        u: list[int] = []
        v: list[int] = []
        for x in np.flatnonzero(self.block == i).tolist():
            near = (part[right] != part[x]) & (ones(prints ^ self.prints[x]) <= limit)
            near &= 100 * np.minimum(self.n[right], self.n[x]) >= least * np.maximum(self.n[right], self.n[x])
            some = np.flatnonzero(near)
            if not len(some):
                continue
            mine = self.codes[self.starts[x] : self.starts[x] + self.n[x]]
            marked[mine] = True
            if 4 * len(some) < len(right):
                own, at = self.own(right[some])
                both = np.add.reduceat(marked[own], at, dtype=np.int64)
            else:
                both = np.add.reduceat(marked[held], starts, dtype=np.int64)[some]
            marked[mine] = False
            linked = right[some[similar(both, self.n[x], self.n[right[some]], least)]]
            parts, at = np.unique(part[linked], return_index=True)
            for y in linked[at].tolist():
                u.append(int(self.node[x]))
                v.append(int(self.node[y]))
            part[np.isin(part, parts)] = part[x]
        return u, v


GROUP = ["cc", "i", "j"]


def _compare(least: int, limit: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict]]:
        """Runs of rows with one group, which may go on in the next batch."""
        for batch in batches:
            keys = _columns(batch, GROUP)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, batch.num_rows]
            rows = {c: batch.column(c).to_numpy() for c in ("block", "node", "part", "n")}
            rows["prints"] = np.ascontiguousarray(_columns(batch, PRINT)).view(np.uint64)
            held = batch.column("held")
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a < b:
                    yield tuple(keys[a].tolist()), {c: x[a:b] for c, x in rows.items()} | {"held": held.slice(a, b - a)}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), parts in groupby(pieces(batches), lambda p: p[0]):
            u, v = _Block([rows for _, rows in parts]).links(i, j, least, limit)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return compare


def _compared(dealt: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Links ``(u, v)`` of rows that are dealt to groups and blocks.  Sets may be repeated, or of nodes that aren't dealt."""
    rows = dealt.join(sets, "node").select(*GROUP, "block", "node", "part", "n", *PRINT, "held")
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_compare(least, bit_limit(least)), "u long, v long")


def _blocks(block: int):
    """Number of blocks that a group needs for its documents and their shingles."""
    return F.greatest(F.ceil(F.sum("size") / block), F.ceil(F.sum("weight") / BLOCK_SHINGLES)).cast("int")


def _first_blocks(members: DataFrame, block: int) -> DataFrame:
    """Blocks of each component, all with its smallest node, so that a cluster around that one costs its size."""
    sized = members.select("cc", F.lit(1).alias("size"), F.col("n").alias("weight"))
    own = members.join(sized.groupBy("cc").agg(_blocks(block).alias("blocks")), "cc")
    every, one = F.sequence(F.lit(0), F.col("blocks") - 1), F.array(F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    own = own.withColumn("i", F.explode(F.when(F.col("node") == F.col("cc"), every).otherwise(one)))
    return own.withColumns({"j": F.col("i"), "block": F.col("i"), "part": F.col("node")})


def _second_blocks(members: DataFrame, block: int) -> DataFrame:
    """Pairs of blocks of each component between its parts (``part``).

    A part larger than a block has blocks of its own, which are not held against each other; smaller ones share blocks.
    """
    sized = members.select("cc", "part", F.lit(1).alias("size"), F.col("n").alias("weight"))
    parts = materialise(sized.groupBy("cc", "part").agg(_blocks(block).alias("blocks"), F.sum("size").alias("size"), F.sum("weight").alias("weight")), "parts")
    large, small = parts.where("blocks > 1"), parts.where("blocks = 1")
    before = F.sum("blocks").over(Window.partitionBy("cc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    large = materialise(large.select("cc", "part", "blocks", F.coalesce(before, F.lit(0)).cast("int").alias("low")), "large-parts")
    own = large.groupBy("cc").agg(F.sum("blocks").cast("int").alias("first"))
    shared = small.groupBy("cc").agg(_blocks(block).alias("shared"))
    counts = own.join(shared, "cc", "full").select("cc", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("first", "shared")))
    placed = members.join(materialise(counts, "block-counts"), "cc").join(large, ["cc", "part"], "left")
    at = F.coalesce(F.col("low") + F.pmod(F.xxhash64("node"), "blocks"), F.col("first") + F.pmod(F.xxhash64("part"), "shared")).cast("int")
    every = F.sequence(F.lit(0), F.col("first") + F.col("shared") - 1)
    others = F.filter(every, lambda x: F.col("low").isNull() | (x < F.col("low")) | (x >= F.col("low") + F.col("blocks")))
    placed = placed.withColumn("block", at).withColumn("other", F.explode(others))
    return placed.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})


def near_duplicate_groups(docs: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """``doc_id, component_id, h, node`` (hashes of text and shingle set) for every row of ``docs`` (``doc_id``, ``text``; others are ignored) that has a doc_id.

    ``component_id`` is the smallest doc_id reachable over pairs of at least ``least`` percent similarity.  Null and
    empty texts, and those without words, are alike; a text of up to five words is one shingle.  Repeated rows are all
    returned; an empty table gives an empty one.
    """
    docs = docs.where("doc_id IS NOT NULL")
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text", own.alias("h")).mapInArrow(_sketch, f"doc_id long, h long, node long, n long, {PRINT_SCHEMA}")
    rows = materialise(rows, "sketches")
    first = F.min(F.struct("doc_id", "h")).alias("first")
    nodes = rows.groupBy("node").agg(first, *(F.first(c).alias(c) for c in ("n", *PRINT)))
    nodes = materialise(nodes.select("node", F.col("first.doc_id").alias("first_id"), F.xxhash64("first.doc_id", "first.h").alias("id"), "n", *PRINT), "nodes")

    routed = nodes.select("node", *PRINT).mapInArrow(_routed(*layout(nodes.count(), least)), f"key long, node long, {PRINT_SCHEMA}")
    routed = routed.repartition("key").sortWithinPartitions("key")
    found = materialise(routed.mapInArrow(_candidates(bit_limit(least)), "u long, v long"), "candidates")
    groups = connected_components(found).withColumnRenamed("component", "cc")
    members = materialise(nodes.join(groups, "node"), "members")
    named = docs.select(F.xxhash64("doc_id", own).alias("id"), "text")
    sets = materialise(named.mapInArrow(_sets(_filter(members)), "node long, held binary"), "shingle-sets")
    members = members.select("cc", "node", "n", *PRINT)

    dealt = materialise(_first_blocks(members, block), "first-blocks")
    links = materialise(_compared(dealt, sets, least), "first-links")
    large = materialise(dealt.where("blocks > 1").drop(*GROUP[1:], "block", "part").distinct(), "large-members")
    if not large.isEmpty():
        parts = connected_components(links)
        apart = large.join(parts, "node", "left").select("cc", "node", "n", *PRINT, F.coalesce("component", "node").alias("part"))
        apart = materialise(_second_blocks(materialise(apart, "apart"), block), "second-blocks")
        links = links.union(materialise(_compared(apart, sets, least), "second-links"))

    found = nodes.join(connected_components(links), "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("part"))
    smallest = found.groupBy("part").agg(F.min("first_id").alias("component_id"))
    ids = materialise(found.join(smallest, "part").select("node", "component_id"), "near-ids")
    return rows.join(ids, "node").select("doc_id", "component_id", "h", "node")


def near_duplicate_dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs``, with all its columns, less the rows whose component holds a row with a smaller doc_id.

    One row of each component stays: of those with its smallest doc_id the one with the smallest hash of its set.  A row
    without doc_id can't be told from others and stays.
    """
    groups = near_duplicate_groups(docs, least)
    return one_of_each(docs, groups.select("doc_id", "h", F.col("component_id").alias("part"), F.col("node").alias("rank")))

"""Best-fit packing of documents into training sequences under conflicts.

A bin holds at most one document of a source and one of a cluster of duplicates, so that a sequence never repeats
itself.  Bins are ordered by what is left of them; each carries a bitmap of its sources and one of its clusters.  A
document goes to the tightest bin that still fits it and shares neither: the successor search starts at its length and
goes on to larger residuals until a compatible bin is found, else a new bin is opened.

Documents are dealt by hash to shards of a few thousand and packed there from the longest to the shortest, so that no
source or cluster, however large, meets in one task.  Documents longer than a bin are cut into whole bins and a rest.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialise
from .token_store import VOCABULARY, encoder
from .units import portions

CAPACITY = 4096
#: Documents expected in a shard, and the most that are packed together should equal rows fill one.
SHARD_ROWS, MOST_ROWS = 4096, 32_768
PACKED = "bin_id string, doc_id long, part int, bin_start long, doc_start long, n_tokens long, source string"


class Packer:
    """Bins of one shard; documents must have a length of at most the capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.left: dict[int, list[int]] = {}  # bins by what is left of them, the oldest first
        self.occupied = 0  # bit r: some bin has r left
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.residual: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and place in it of a document; source and cluster are bitmaps with one bit at most."""
        sources, clusters = self.sources, self.clusters
        above = self.occupied >> length
        residual = length
        while above:
            step = (above & -above).bit_length() - 1  # the next residual that some bin has
            residual += step
            same = self.left[residual]
            for at, b in enumerate(same):
                if not (sources[b] & source or clusters[b] & cluster):
                    del same[at]
                    if not same:
                        del self.left[residual]
                        self.occupied ^= 1 << residual
                    return self._into(b, length, source, cluster)
            above >>= step + 1
            residual += 1
        self.sources.append(0)
        self.clusters.append(0)
        self.residual.append(self.capacity)
        return self._into(len(self.residual) - 1, length, source, cluster)

    def _into(self, b: int, length: int, source: int, cluster: int) -> tuple[int, int]:
        start = self.capacity - self.residual[b]
        self.residual[b] -= length
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if self.residual[b]:
            insort(self.left.setdefault(self.residual[b], []), b)
            self.occupied |= 1 << self.residual[b]
        return b, start


def pack_shard(rows: list[tuple[int, str | None, int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(row, part, bin, place in bin, place in document, length) for every part of (doc_id, source, cluster, length)."""
    bit: dict[str, int] = {}
    for _, source, _, _ in rows:
        if source is not None:
            bit.setdefault(source, 1 << len(bit))
    often = [c for c, n in Counter(c for _, _, c, _ in rows).items() if n > 1]
    twin = {c: 1 << i for i, c in enumerate(often)}
    parts = []
    for row, (_, _, _, n) in enumerate(rows):
        parts += [(row, at // capacity, at, min(capacity, n - at)) for at in range(0, n, capacity)]
    parts.sort(key=lambda p: -p[3])
    packer, out = Packer(capacity), []
    for row, part, at, n in parts:
        # Parts of a document are of one source and cluster, so each gets a bin of its own where it has a source.
        b, start = packer.place(n, bit.get(rows[row][1], 0), twin.get(rows[row][2], 0))
        out.append((row, part, b, start, at, n))
    return out


def _pack(capacity: int):
    def packed(shard: int, chunk: int, rows: list[tuple]) -> pa.RecordBatch:
        found = pack_shard(rows, capacity)
        columns = [
            pa.array([f"{shard}-{chunk}-{b}" for _, _, b, _, _, _ in found], pa.string()),
            pa.array([rows[r][0] for r, *_ in found], pa.int64()),
            pa.array([f[1] for f in found], pa.int32()),
            *(pa.array([f[i] for f in found], pa.int64()) for i in (3, 4, 5)),
            pa.array([rows[r][1] for r, *_ in found], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PACKED.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for shard, own in groupby(rows, lambda r: r[0]):
            held, chunk = [], 0
            for r in own:
                held.append(r[1:])
                if len(held) == MOST_ROWS:
                    yield packed(shard, chunk, held)
                    held, chunk = [], chunk + 1
            if held:
                yield packed(shard, chunk, held)

    return pack


def _token_counts(path: str):
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            whole = pa.RecordBatch.from_arrays([batch, batch], names=["row", "text"])
            n = [encoder(path).counts(some.column(1)) + 1 for some in portions(whole)]
            yield pa.array(np.concatenate(n) if n else [], pa.int64())

    counts.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(counts, "long")


def copies(text: Column) -> Column:
    """Cluster of a text among exact copies up to case and white space."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))))


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None, length: Column | None = None,
    vocabulary: str = VOCABULARY, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Bins of the documents of ``docs`` (``doc_id``, ``text``, ``source``; others are ignored), a row for each part.

    ``bin_id, doc_id, part, bin_start, doc_start, n_tokens, source``.  ``length`` is by default the number of tokens of
    the text with an end id; ``cluster`` a long, by default :func:`copies`.  Every token of every document is in one
    bin.  A null or empty text has its end id alone; a null source conflicts with none; repeated rows are copies of one
    cluster and go to different bins.  An empty table gives an empty one.
    """
    if capacity < 1:
        raise ValueError("a bin must hold a token at least")
    n = _token_counts(vocabulary)(F.col("text")) if length is None else length.cast("long")
    source = F.col("source").cast("string")
    rows = docs.select("doc_id", source.alias("source"), (copies(F.col("text")) if cluster is None else cluster).alias("cluster"), n.alias("n"))
    rows = materialise(rows, "lengths")
    shards = max(1, -(-rows.count() // shard_rows))
    shard = F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)).cast("int")
    dealt = rows.select(shard.alias("shard"), "doc_id", "source", "cluster", "n").repartition("shard")
    dealt = dealt.sortWithinPartitions("shard", F.desc("n"), "doc_id", "cluster", "source")
    return dealt.mapInArrow(_pack(capacity), PACKED)

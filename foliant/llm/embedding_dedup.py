"""Near-duplicate embeddings by Euclidean p-stable hashing.

Equal vectors are first brought down to one representative with a count.  Representatives are normalised and hashed
into several tables, each by k random projections quantised to a grid (Datar et al., 2004); k grows with the logarithm
of the number of vectors and the number of tables follows from the recall wanted at the threshold.  Vectors that share
a bucket are compared exactly, as blocks of dot products in double precision.  A pair counts in the first table where
it meets, so that a vector's number of links is exact over the pairs found.  Rows travel without the codes of their
other tables, whose size would grow with the square of the number of tables: a task hashes again the vectors of the
links it found, and no others.

A task gives out a number for each vector and a spanning forest of its links, never the pairs.  Buckets with more than
``BLOCK`` vectors are divided into blocks, and every pair of blocks becomes a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, forest
from .runtime import materialise

THRESHOLD, RECALL, SEED = 0.93, 0.999, 20_240_901
#: Width of a grid cell in distances at the threshold.
CELL = 6.0
#: Other vectors expected in a bucket by chance, over all tables; and the fewest projections in a table.
CHANCE, PROJECTIONS = 4000, 3
BLOCK = 512


def _phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def collision(distance: float, width: float) -> float:
    """Probability that one quantised projection agrees for two vectors at a distance."""
    r = width / distance
    return 1 - 2 * _phi(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def layout(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[float, int, int]:
    """Cell width, projections a table, and tables for n vectors that may meet."""
    near = math.sqrt(max(2 - 2 * threshold, 1e-6))
    width = CELL * near
    p, q = collision(near, width), collision(math.sqrt(2), width)
    for k in count(PROJECTIONS):  # q is less than 1, and far less than p
        tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - p**k)))
        if n * tables * q**k <= CHANCE:
            break
    return width, k, tables


@lru_cache(maxsize=2)
def _projections(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, k * tables)), rng.random(k * tables), rng.integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1)


def codes(vectors: np.ndarray, width: float, k: int, tables: int, first: int | None = None) -> np.ndarray:
    """Bucket of each unit vector in each table, or in the ``first`` tables."""
    directions, shifts, odd = _projections(vectors.shape[1], k, tables)
    first = tables if first is None else first
    own = directions[:, : k * first]
    cells = np.floor((vectors @ own) / width + shifts[: k * first]).astype(np.int64).view(np.uint64)
    mixed = (cells.reshape(len(vectors), first, k) * odd).sum(2, dtype=np.uint64)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int32)


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null, without null or non-finite components, not zero or empty."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(lists: pa.Array, dim: int) -> np.ndarray:
    v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _bucketed(width: float, k: int, tables: int):
    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(3).offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                own = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                for start in range(0, own.num_rows, 2000):
                    some = own.slice(start, 2000)
                    found = codes(_unit(some.column(3), dim), width, k, tables)
                    n = len(found)
                    for t in range(tables):
                        columns = [np.full(n, t, np.int32), found[:, t], np.full(n, dim, np.int32)]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(some.column(i) for i in (0, 1, 2, 3))], names=NAMES)

    return bucketed


NAMES = ["t", "code", "dim", "label", "rep", "n", "vector"]
KEY = ["t", "label", "dim", "code", "i", "j"]


def _compare(threshold: float, width: float, k: int, tables: int):
    def links(key: tuple, rows: dict[str, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Representatives with the vectors linked to each, and forest edges, of one group."""
        t, _, _, _, i, j = key
        rep, n, block = (np.concatenate(rows[c]) for c in ("rep", "n", "block"))
        unit = np.concatenate(rows["unit"])
        code, known = np.zeros((len(rep), t), np.int32), np.zeros(len(rep), bool)
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        linked, edges = np.zeros(len(rep), np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for at in range(0, len(left), 512):
            a = left[at : at + 512]
            x, y = np.nonzero(unit[a] @ unit[right].T >= threshold)
            x, y = a[x], right[y]
            once = x < y if i == j else np.ones(len(x), bool)
            x, y = x[once], y[once]
            own = np.setdiff1d(np.r_[x, y], np.flatnonzero(known))
            if t and len(own):
                code[own], known[own] = codes(unit[own], width, k, tables, t), True
            for part in range(0, len(x), 100_000):
                u, v = x[part : part + 100_000], y[part : part + 100_000]
                new = ~(code[u] == code[v]).any(axis=1)
                u, v = u[new], v[new]
                np.add.at(linked, u, n[v])
                np.add.at(linked, v, n[u])
                edges = forest(np.concatenate([edges[0], rep[u]]), np.concatenate([edges[1], rep[v]]))
        some = linked > 0
        return rep[some], linked[some], *edges

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            rep, count, u, v = (np.concatenate(x) for x in zip(*found, strict=True))
            columns = [np.r_[rep, u], np.r_[np.full(len(rep), -1), v], np.r_[count, np.zeros(len(u), np.int64)]]
            isolated = pa.array(np.r_[np.ones(len(rep), bool), np.zeros(len(u), bool)])
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], mask=np.asarray(isolated)), pa.array(columns[2])], names=["a", "b", "n"])

        found, size = [], 0
        for key, parts in groupby(_pieces(batches), lambda p: p[0]):
            rows: dict[str, list] = {}
            for _, piece in parts:
                for c, x in piece.items():
                    rows.setdefault(c, []).append(x)
            if sum(map(len, rows["rep"])) > 1:
                found.append(links(key, rows))
                size += len(found[-1][0]) + len(found[-1][2])
            if size > 50_000:
                yield out(found)
                found, size = [], 0
        if found:
            yield out(found)

    return compare


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Runs of rows with one key; a group may go on in the next batch."""
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in KEY])
        starts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows]
        plain = {c: batch.column(c).to_numpy() for c in ("rep", "n", "block")}
        vectors = batch.column("vector")
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if a < b:
                key = tuple(keys[:, a].tolist())
                piece = {c: x[a:b] for c, x in plain.items()} | {"unit": _unit(vectors.slice(a, b - a), key[2])}
                yield key, piece


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows with the pair of blocks (i, j) of their bucket that they are compared in."""
    bucket = KEY[:4]
    sizes = rows.groupBy(bucket).count().where(F.col("count") > block)
    large = materialise(sizes.selectExpr(*bucket, f"CAST(ceil(count / {block}) AS INT) AS blocks"), "large-buckets")
    one = [F.lit(0).alias(c) for c in ("i", "j", "block")]
    if large.isEmpty():
        return rows.select("*", *one)
    own = F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block")
    split = rows.join(large, bucket).select(*rows.columns, own, "blocks")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    split = split.select("*", other).select(*rows.columns, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    return rows.join(large, bucket, "left_anti").select(*rows.columns, *one).unionByName(split)


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id``, ``embedding``, ``label``).

    Vectors link when their labels are equal and their cosine is ``threshold`` or more; a pair just at the threshold is
    found with probability ``recall`` at least, closer ones almost surely, equal ones always.  ``n_links`` counts the
    other rows linked, copies included.  Vectors that are null, empty, zero, or hold a null or non-finite component,
    and rows without label, link with nothing; so do vectors of different dimensions.  A row without vec_id has no
    links and no component, and is not kept.  Rows repeated under one vec_id are linked copies; they are one node, and
    all of them are returned.  An empty table gives an empty one.
    """
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    can = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    keys = [F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(SEED), "embedding").alias("g")]
    linkable = rows.where(can).select("vec_id", "label", *keys, "embedding")
    reps = linkable.groupBy("label", "h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("vector"))
    reps = materialise(reps, "distinct-vectors")
    most = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    schema = "t int, code int, dim int, label long, rep long, n long, vector array<float>"
    vector = F.col("vector").cast("array<float>") if "double" not in dict(vectors.dtypes)["embedding"] else F.col("vector")
    if "double" in dict(vectors.dtypes)["embedding"]:
        schema = schema.replace("array<float>", "array<double>")
    cells = layout(most, threshold, recall)
    hashed = reps.select("label", "rep", "n", vector.alias("vector")).mapInArrow(_bucketed(*cells), schema)
    dealt = _in_blocks(hashed, block).repartition(*KEY).sortWithinPartitions(*KEY)
    found = materialise(dealt.mapInArrow(_compare(threshold, *cells), "a long, b long, n long"), "vector-links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("other"))
    components = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    placed = reps.join(links, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("label", "h", "g", (F.coalesce("other", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    joined = linkable.drop("embedding").join(placed, ["label", "h", "g"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~can).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return joined.unionByName(alone).withColumn("kept", kept)

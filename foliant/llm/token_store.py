"""Token ids as Parquet: one row a document in ascending doc_id order, ids in a list column.

Ids are dictionary encoded (16-bit indexes for a 50k vocabulary) or delta encoded, in row groups and pages of set
sizes; the writer adds column and offset indexes, so that a reader can fetch a range of doc_ids, or only the metadata
columns, without touching the other pages.  Spark writes and commits the files, to any file system it knows.

    part, doc_id, local_start, n_tokens, tokens

``local_start`` counts the ids before a document within its part; the totals of the parts (one number for each written
partition) turn it into a place in the whole stream.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .runtime import kept
from .units import REMEMBERED, UnitCoder, buffers, portions

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
#: Units that the split pattern leaves in one piece: letters, digits or signs alone.  The ranges of letters are in every
#: version of Unicode.
ONE_PIECE = r"^ ?(?:[A-Za-zÀ-ÖØ-öø-ÿĀ-ɏα-ωА-яぁ-ゖァ-ヺ一-龥가-힣]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)$"
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 256 << 10, 2_000

SCHEMA = "part int, doc_id long, local_start long, n_tokens long, tokens array<int>"


class ByteLevelEncoder(UnitCoder):
    """Encodes whole texts with a byte-level BPE file of the tokenizers library, which is asked once for each new unit.

    A text that holds the string of a special token is given to the library whole, and so is every text where the file
    is of another kind.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        super().__init__(remembered)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        self.splits = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        self.splits &= model["type"] == "BPE" and not (model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"] or model["end_of_word_suffix"] or model.get("ignore_merges"))
        self.model = None
        if self.splits:
            # The file's model without the cache of its own, which costs more than it gives for units that are all new.
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.model = BPE(vocab=model["vocab"], merges=merges, cache_capacity=0)
        self.symbols = np.array([ord(s) for s in byte_symbols()], np.uint16)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, column: pa.Array) -> np.ndarray | None:
        if not self.splits:
            return np.ones(len(column), bool)
        marked = np.zeros(len(column), bool)
        for s in self.special:
            marked |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        return marked if marked.any() else None

    def learn(self, units: pa.Array) -> pa.Array:
        single = pc.match_substring_regex(units, ONE_PIECE) if self.splits else pa.array(np.zeros(len(units), bool))
        data, ends = buffers(units.filter(single))
        symbols, places, tokenize = self.symbols[data].tobytes().decode("utf-16-le"), ends.tolist(), self.model and self.model.tokenize
        ids = [[t.id for t in tokenize(symbols[a:b])] for a, b in pairwise(places)]
        other = units.filter(pc.invert(single)).to_pylist()
        for i in range(0, len(other), 4096):
            ids += [e.ids for e in self.tokenizer.encode_batch_fast(other[i : i + 4096], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
        listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))
        own = single.to_numpy(zero_copy_only=False)
        return listed.take(pa.array(np.where(own, np.cumsum(own) - 1, own.sum() + np.cumsum(~own) - 1)))


def encoder(path: str) -> ByteLevelEncoder:
    """The worker's encoder."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(("encoder", path), lambda: ByteLevelEncoder(path))


def _encode(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            for some in portions(batch):
                values, n = encoder(path).encode_arrays(some.column(1))
                n = n + 1
                ends = np.r_[0, np.cumsum(n)]
                tokens = np.full(ends[-1], end_id, np.int32)
                own = np.ones(ends[-1], bool)
                own[ends[1:] - 1] = False
                tokens[own] = values
                listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens))
                columns = [some.column(0), pa.array(place + ends[:-1]), pa.array(n), listed]
                place += int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "local_start", "n_tokens", "tokens"])

    return encode


def write_token_store(
    docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, encoding: str = "dictionary"
) -> None:
    """Encode the whole texts of ``docs`` (``doc_id``, ``text``; other columns are ignored) into ``path``.

    A null text counts as empty and gives the end id alone.  Rows without doc_id come first; rows repeated under one
    doc_id are all written, by ascending text.  An empty table gives a store without rows.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding!r}")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    coded = ordered.mapInArrow(_encode(vocabulary, end_id), "doc_id long, local_start long, n_tokens long, tokens array<int>")
    options = {
        "compression": "zstd",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.writer.version": "PARQUET_2_0",  # integers outside a dictionary are delta encoded
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
    }
    coded.select(F.spark_partition_id().alias("part"), "*").write.options(**options).parquet(path)


def read_token_store(spark: SparkSession, path: str, *columns: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """``columns`` (all by default) of the documents with first <= doc_id <= last, plus ``start``.

    Column choice and range reach the scan: pages of other columns and other documents aren't read.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row a written part
    before, offsets = 0, []
    for r in totals:
        offsets.append((r.part, before))
        before += r.n
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    parts = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    placed = rows.join(parts, "part").withColumn("start", F.col("before") + F.col("local_start"))
    return placed.select(*(columns or ["doc_id", "n_tokens", "tokens"]), "start")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for batch in batches:
        tokens = batch.column(1)
        values, at = tokens.values.to_numpy().astype("<u4", copy=False), tokens.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        n = pa.array(np.diff(at).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n, pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the ids in the files."""
    rows = read_token_store(spark, path, "doc_id", "tokens")
    return rows.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")

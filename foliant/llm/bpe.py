"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never end up in one token, so a cut between
them is certain.  Each piece of the split pattern is cut there, the fragments are merged independently, and the ids are
concatenated.  Fragments of many words are merged side by side in numpy, one merge a fragment and round.  The file is
of the tokenizers library's format with BPE over byte symbols and an end-of-word suffix.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .runtime import kept
from .units import REMEMBERED, UnitCoder, buffers, portions, strings

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: White space of the file's patterns (Unicode White_Space), which separates words.
WHITE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Units that are one piece of the split pattern and in normal form.
ONE_PIECE = r"^ ?[a-zß-öø-ÿ]+$"
#: Longer fragments are merged one by one, by a heap.
SIDE_BY_SIDE = 64
NO_RANK = 1 << 30


def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE files write for each byte."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class ForcedBoundaryBPE(UnitCoder):
    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        super().__init__(remembered)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], [s["type"] for s in spec["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges") or steps != ["Split", "ByteLevel"]:
            raise ValueError("not a byte-level BPE file with a split pattern")
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.normalise = Tokenizer.from_file(path).normalizer.normalize_str
        special = spec["added_tokens"]
        self.special = {t["content"]: t["id"] for t in special}
        self.marks = regex.compile("|".join(f"({regex.escape(s)})" for s in self.special)) if special else None
        tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in special}
        #: What each id decodes to behind another one: the file names no decoder, so that tokens are joined by spaces.
        self.shown = pa.array([" " + tokens.get(i, "") for i in range(max(tokens) + 1)], pa.string())
        self.texts = pa.array([], pa.string())

        symbols = byte_symbols()
        byte = {s: b for b, s in enumerate(symbols)}
        self.plain = np.array([vocab.get(s, -1) for s in symbols], np.int64)
        self.last = np.array([vocab.get(s + suffix, -1) for s in symbols], np.int64)
        # Every pair of bytes that some token holds next to each other; the suffix belongs to the last byte.
        self.inside = np.zeros((256, 256), bool)
        for t in vocab:
            for x, y in pairwise(t.removesuffix(suffix) if suffix else t):
                self.inside[byte[x], byte[y]] = True
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[x] << 32 | vocab[y] for x, y in pairs] or [0], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], (order if pairs else np.array([NO_RANK]))
        self.merged = np.array([vocab[x + y] for x, y in pairs] or [0], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids, or ``NO_RANK``."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == wanted, self.pair_ranks[at], NO_RANK)

    def merge_one(self, ids: list[int]) -> list[int]:
        """Apply the merges to a fragment in order of rank, leftmost first."""
        n = len(ids)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        found = self.ranks(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(found) if r < NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i] if not gone[i] else n
            if j >= n or (ids[i], ids[j]) != (x, y):
                continue
            ids[i], gone[j], after[i] = int(self.merged[r]), True, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := int(self.ranks(np.array([ids[a]]), np.array([ids[b]]))[0])) < NO_RANK:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [x for x, g in zip(ids, gone, strict=True) if not g]

    def merge(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for fragments given by the ids of their bytes, one after another."""
        left: list[np.ndarray] = []  # numbers, sizes and ids of finished fragments
        out_sizes = np.zeros(len(sizes), np.int64)
        number = np.arange(len(sizes))
        long = sizes > SIDE_BY_SIDE
        order: list[np.ndarray] = []
        if long.any():
            ends = np.cumsum(sizes)
            for i in np.flatnonzero(long):
                own = np.array(self.merge_one(ids[ends[i] - sizes[i] : ends[i]].tolist()), np.int64)
                out_sizes[i] = len(own)
                left.append(own)
                order.append(np.full(len(own), i))
            ids, number, sizes = ids[np.repeat(~long, sizes)], number[~long], sizes[~long]
        starts = np.cumsum(sizes) - sizes
        rank = np.full(len(ids), NO_RANK, np.int64)
        rank[:-1] = self.ranks(ids[:-1], ids[1:]) if len(ids) > 1 else rank[:-1]
        rank[starts + sizes - 1] = NO_RANK
        while len(sizes):
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
            open_ = best >> 32 < NO_RANK
            if not open_.all():
                done = np.repeat(~open_, sizes)
                out_sizes[number[~open_]] = sizes[~open_]
                left.append(ids[done])
                order.append(np.repeat(number[~open_], sizes[~open_]))
                moved = np.cumsum(np.where(open_, 0, sizes))[open_]
                best, number, sizes = best[open_] - moved, number[open_], sizes[open_]
                ids, rank = ids[~done], rank[~done]
                if not len(sizes):
                    break
            at = best & 0xFFFFFFFF
            ids[at] = self.merged[best >> 32]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, rank, at, sizes = ids[stay], rank[stay], at - np.arange(len(at)), sizes - 1
            ends = np.cumsum(sizes)
            starts = ends - sizes
            after = at + 1 < ends
            rank[at] = NO_RANK
            rank[at[after]] = self.ranks(ids[at[after]], ids[at[after] + 1])
            before = at[at > starts]
            rank[before - 1] = self.ranks(ids[before - 1], ids[before])
        if not left:
            return np.zeros(0, np.int64), out_sizes
        flat, owner = np.concatenate(left), np.concatenate(order)
        return flat[np.argsort(owner, kind="stable")], out_sizes

    def fragments(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the fragments of pieces (their bytes, one piece after another), and which fragments end a piece."""
        start = np.zeros(len(data) + 1, bool)
        start[1:-1] = ~self.inside[data[:-1], data[1:]]
        ends = np.cumsum(sizes)
        start[ends - sizes] = start[ends] = True
        final = np.zeros(len(data) + 1, bool)
        final[ends] = True
        places = np.flatnonzero(start)
        return places[:-1], final[places[1:]]

    def encode_pieces(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and the number of each."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        starts, final = self.fragments(data, sizes)
        lengths = np.diff(np.r_[starts, len(data)])
        ids = self.plain[data]
        ends = (starts + lengths)[final] - 1
        ids[ends] = self.last[data[ends]]
        known = ids >= 0  # a byte without a token of its own gives none
        if not known.all():
            lengths = np.add.reduceat(known.astype(np.int64), starts)
            ids = ids[known]
        some = lengths > 0
        flat, found = self.merge(ids, lengths[some])
        total = np.zeros(len(starts), np.int64)
        total[some] = found
        return flat, np.add.reduceat(total, np.r_[0, np.flatnonzero(final)[:-1] + 1])

    def split(self, text: str) -> list[bytes]:
        return [p.encode() for word in WHITE.split(self.normalise(text)) for p in self.pieces.findall(word)]

    def _with_marks(self, text: str) -> np.ndarray:
        """Ids of a text that holds special tokens."""
        out = []
        for part in filter(None, self.marks.split(text)):
            pieces = [] if part in self.special else self.split(part)
            sizes = np.array(list(map(len, pieces)), np.int64)
            out.append(np.array([self.special[part]]) if part in self.special else self.encode_pieces(np.frombuffer(b"".join(pieces), np.uint8), sizes)[0])
        return np.concatenate(out)

    def whole(self, column: pa.Array) -> np.ndarray | None:
        marked = np.zeros(len(column), bool)
        for s in self.special:
            marked |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        return marked if marked.any() else None

    def prepared(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Capitals of ASCII and Latin-1 lowered, except in units with other characters, whose normal form may need them."""
        capital = np.flatnonzero((data >= 65) & (data <= 90))
        wide = np.flatnonzero(data[:-1] == 0xC3) + 1
        wide = wide[(data[wide] >= 0x80) & (data[wide] <= 0x9E) & (data[wide] != 0x97)]
        at = np.concatenate([capital, wide])
        other = np.flatnonzero((data == 0xC2) | (data >= 0xC4))
        if len(other):
            foreign = np.zeros(len(places), bool)
            foreign[np.searchsorted(places, other, "right") - 1] = True
            at = at[~foreign[np.searchsorted(places, at, "right") - 1]]
        out = data.copy()
        out[at] |= 32
        return out

    def keep(self, some: pa.Array) -> None:
        super().keep(some)
        self.texts = self.texts.take(some)

    def add(self, units: pa.Array) -> None:
        before = len(self.ids)
        super().add(units)
        new = self.ids.slice(before)
        data, ends = buffers(self.shown.take(new.flatten()))
        of = np.r_[0, np.cumsum(pc.list_value_length(new).to_numpy().astype(np.int64))]
        self.texts = pa.concat_arrays([self.texts, strings(data, ends[of])])

    def learn(self, units: pa.Array) -> pa.Array:
        single = pc.match_substring_regex(units, ONE_PIECE).to_numpy(zero_copy_only=False)
        data, ends = buffers(units.filter(pa.array(single)))
        sizes = np.diff(ends) - (data[ends[:-1]] == 32)
        other = units.filter(pa.array(~single)).to_pylist()
        marked = {i: self._with_marks(u) for i, u in enumerate(other) if self.marks and self.marks.search(u)}
        pieces = [[] if i in marked else self.split(u) for i, u in enumerate(other)]
        bytes_ = b"".join(p for own in pieces for p in own)
        data = np.concatenate([data[data != 32], np.frombuffer(bytes_, np.uint8)])
        all_sizes = np.concatenate([sizes, np.array([len(p) for own in pieces for p in own], np.int64)])
        flat, n = self.encode_pieces(data, all_sizes)
        bounds = np.r_[0, np.cumsum(n)][np.r_[np.arange(len(sizes) + 1), len(sizes) + np.cumsum(list(map(len, pieces)), dtype=np.int64)]]
        if marked:
            parts = np.split(flat, bounds[1:-1])
            for i, ids in marked.items():
                parts[len(sizes) + i] = ids
            flat, bounds = np.concatenate(parts), np.r_[0, np.cumsum(list(map(len, parts)))]
        listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))
        return listed.take(pa.array(np.where(single, np.cumsum(single) - 1, single.sum() + np.cumsum(~single) - 1)))

    def decode(self, ids: np.ndarray) -> str:
        """Tokens of the ids, special ones included, joined by spaces."""
        return "".join(self.shown.take(pa.array(ids, pa.int64())).to_pylist())[1:]

    def round_trip(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after another, where each text's begin and the last end, and the same of decoded bytes.

        The decoded text of each begins with a space that is to be left out.
        """
        index, rows = self.look_up(column)
        at = pa.array(index)
        sizes = pc.list_value_length(self.ids).to_numpy().astype(np.int64)
        values = self.ids.take(at).flatten().to_numpy()
        data, ends = buffers(self.texts.take(at))
        return values, np.r_[0, np.cumsum(sizes[index])][rows], data, ends[rows]


def coder(path: str) -> ForcedBoundaryBPE:
    """The worker's coder."""
    return kept(("coder", path), lambda: ForcedBoundaryBPE(path))


def _digests(path: str):
    from hashlib import sha256

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in portions(batch):
                values, at, data, ends = coder(path).round_trip(some.column(1))
                values = values.astype("<u4", copy=False)
                ids = [sha256(values[a:b]).hexdigest() for a, b in pairwise(at.tolist())]
                decoded = [sha256(data[min(a + 1, b) : b]).hexdigest() for a, b in pairwise(ends.tolist())]
                columns = [some.column(0), pa.array(np.diff(at)), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digests


def _coded(path: str):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in portions(batch):
                values, at, data, ends = coder(path).round_trip(some.column(1))
                tokens = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))
                decoded = [data[min(a + 1, b) : b].tobytes().decode() for a, b in pairwise(ends.tolist())]
                yield pa.RecordBatch.from_arrays([some.column(0), tokens, pa.array(decoded, pa.string())], names=["doc_id", "tokens", "decoded"])

    return coded


def bpe_round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, tokens, decoded`` for every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    A null or empty text has no tokens and decodes to the empty text; repeated rows are all returned.
    """
    return docs.select("doc_id", "text").mapInArrow(_coded(vocabulary), "doc_id long, tokens array<int>, decoded string")


def bpe_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """As :func:`bpe_round_trip`, but ``doc_id, n_tokens, ids_sha256, decoded_sha256``, made in one pass."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(_digests(vocabulary), schema)

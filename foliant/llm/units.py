"""Whole texts as runs of units that repeat, so that a coder works once for each distinct one.

Texts are cut in numpy on their bytes, at places where every split pattern of the byte-level files cuts as well:

* before a space that a character other than white space follows;
* before a line feed after such a character (or at the start), and behind it where such a character follows as well;
* between a letter of Latin-1 and a sign of ASCII, on either side, but behind an apostrophe.

The units share the bytes of the texts.  Arrow finds the distinct ones of a batch and those already known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time.
PORTION = 8 << 20
#: Units remembered between portions (about 50 bytes each); when full, those of the last portion stay.
REMEMBERED = 1_000_000
#: Longer units (bytes) are not remembered.
LONG_UNIT = 64

_BYTE = np.arange(256)
WHITE = ((_BYTE >= 9) & (_BYTE <= 13)) | (_BYTE == 32) | ((_BYTE >= 28) & (_BYTE <= 31))
SIGN = np.isin(_BYTE, list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
LETTER = ((_BYTE | 32) >= ord("a")) & ((_BYTE | 32) <= ord("z"))


def _white_from(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that begins at each place is white space (``data`` has two bytes to spare)."""
    a = data[at]
    white = WHITE[a]
    wide = np.flatnonzero((a == 0xC2) | ((a >= 0xE1) & (a <= 0xE3)))
    if len(wide):
        white[wide] = _wide_white(a[wide], data[at[wide] + 1], data[at[wide] + 2])
    return white


def _wide_white(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    general = (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    other = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | general | other


def _white_until(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place (1 at least) is white space."""
    c, b, a = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    return WHITE[c] | (c >= 0x80) & (_wide_white(b, c, c) & (b == 0xC2) | _wide_white(a, b, c) & (a != 0xC2))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without nulls."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    own = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return own, ends.astype(np.int64) - int(ends[0])


def strings(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.Array.from_buffers(kind or pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def edges(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of all cuts, starts and ends of texts included, and for each text the number of units before its end.

    Texts marked in ``whole`` are left in one piece.
    """
    n = len(data)
    padded = np.concatenate([data, np.full(3, 32, np.uint8)])
    bound = np.zeros(n + 2, bool)
    bound[offsets] = True
    edge = bound.copy()
    spaces = np.flatnonzero(data == 32)
    edge[spaces[~bound[spaces + 1] & ~_white_from(padded, spaces + 1)]] = True
    feeds = np.flatnonzero(data == 10)
    after = feeds[bound[feeds] | ~_white_until(padded, np.maximum(feeds, 1))]
    edge[after] = True
    alone = after[~bound[after + 1] & ~_white_from(padded, after + 1)] + 1
    edge[alone] = True
    signs = np.flatnonzero(SIGN[data])
    last, lead = padded[signs - 1], padded[signs - 2]
    edge[signs[LETTER[last] | _latin(lead, last)]] = True
    signs = signs[data[signs] != ord("'")] + 1
    edge[signs[LETTER[padded[signs]] | _latin(padded[signs], padded[signs + 1])]] = True
    if whole is not None:
        for i in np.flatnonzero(whole):
            edge[offsets[i] + 1 : offsets[i + 1]] = False
    places = np.flatnonzero(edge[: n + 1])
    return places, np.searchsorted(places, offsets)


def _latin(lead: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Letters of Latin-1 beyond ASCII, by their two bytes."""
    return (lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)


class UnitCoder:
    """Ids of whole texts by way of their distinct units; subclasses say in ``learn`` what the ids of units are."""

    def __init__(self, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.keys = pa.array([], pa.string())
        self.ids = pa.array([], pa.list_(pa.int32()))
        self.recent, self.long = np.zeros(0, np.int64), False

    def learn(self, units: pa.Array) -> pa.Array:
        """A list of ids for each unit."""
        raise NotImplementedError

    def whole(self, column: pa.Array) -> np.ndarray | None:
        """Marks texts that mustn't be cut."""
        return None

    def prepared(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The bytes in the form in which units are told apart."""
        return data

    def keep(self, some: pa.Array) -> None:
        """Forget all units but those at some places."""
        self.keys, self.ids = self.keys.take(some), self.ids.take(some)

    def add(self, units: pa.Array) -> None:
        self.keys, self.ids = pa.concat_arrays([self.keys, units]), pa.concat_arrays([self.ids, self.learn(units)])

    def look_up(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each unit of all texts its place in the memory, and for each text the number of units before its end.

        The places hold until the next call.
        """
        if len(self.keys) > self.remembered:
            self.keep(pa.array(self.recent))
        if self.long:
            self.keep(pa.array(np.flatnonzero(pc.binary_length(self.keys).to_numpy() <= LONG_UNIT)))
        column = pc.fill_null(column.cast(pa.string()), "")
        data, offsets = buffers(column)
        places, rows = edges(data, offsets, self.whole(column))
        coded = strings(self.prepared(data, places), places).dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.keys)
        found = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        if at.null_count:
            new = pc.is_null(at)
            found[new.to_numpy(zero_copy_only=False)] = len(self.keys) + np.arange(at.null_count)
            self.add(coded.dictionary.filter(new))
        short = pc.binary_length(coded.dictionary).to_numpy() <= LONG_UNIT
        self.recent, self.long = np.sort(found[short]), not short.all()
        return found[coded.indices.to_numpy()], rows

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        index, rows = self.look_up(column)
        sizes = pc.list_value_length(self.ids).to_numpy().astype(np.int64)
        return np.diff(np.r_[0, np.cumsum(sizes[index])][rows])

    def encode_arrays(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each."""
        index, rows = self.look_up(column)
        sizes = pc.list_value_length(self.ids).to_numpy().astype(np.int64)
        values = self.ids.take(pa.array(index)).flatten().to_numpy()
        return values, np.diff(np.r_[0, np.cumsum(sizes[index])][rows])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        values, n = self.encode_arrays(pa.array(texts, pa.string()))
        return [x.astype("<i4").tobytes() for x in np.split(values, np.cumsum(n)[:-1])] if texts else []


def portions(batch: pa.RecordBatch, size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text (its second column), a single row at least."""
    ends = np.cumsum(np.r_[0, pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()])
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + size, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end

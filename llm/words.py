"""Words of Arrow text columns as numpy arrays: bounds and 64-bit hashes, no per-word Python.

A word is a run of bytes other than the six ASCII white space bytes. Its hash sums, over its blocks
of eight bytes, a mixed value of block and place, and mixes the sum with the length: unlike a
polynomial modulo 2**64 this leaves no words that are built to be equal under every base. A word
costs memory per block, not per byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Also every ASCII character that is no letter or digit: for vocabularies without punctuation.
PUNCTUATED = _SPACE.copy()
PUNCTUATED[[b for b in range(128) if not chr(b).isalnum()]] = True
_PLACE = np.uint64(0x9E3779B97F4A7C15)
#: The n lowest bytes of a block, for n from 0 to 8.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets with one more entry than texts); null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n, at = len(column), column.offset
    _, ends, data = column.buffers()
    bounds = np.frombuffer(ends, np.int64)[at:at + n + 1]
    flat = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, bounds - bounds[0]


class Words:
    """All words of a run of texts: byte bounds, hashes and the first word of every text."""

    def __init__(self, flat: np.ndarray, bounds: np.ndarray, blank: np.ndarray = _SPACE):
        n = len(flat)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~blank[flat]
        starts = inside[1:-1] & ~inside[:-2]
        # a text starts a new word even where the text before it ends without white space
        cut = bounds[1:-1]
        cut = cut[cut < n]
        starts[cut] |= inside[1:-1][cut]
        self.starts = np.flatnonzero(starts)
        ends = inside[1:-1] & ~inside[2:]
        ends[cut[cut > 0] - 1] |= inside[1:-1][cut[cut > 0] - 1]
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, bounds)
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = flat
        self._blocks = np.ndarray((n + 1,), "<u8", padded, strides=(1,))  # the eight bytes from any place
        self.hash = self.bytes_hash(self.starts, self.ends)

    def bytes_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of every byte range; equal bytes give equal hashes."""
        size = ends - starts
        total = mix((self._blocks[starts] & _LOW[np.minimum(size, 8)]) ^ _PLACE)
        long = np.flatnonzero(size > 8)
        if len(long):
            more = (size[long] - 1) >> 3  # blocks after the first
            stops = np.cumsum(more)
            begin = stops - more
            place = np.arange(1, stops[-1] + 1) - np.repeat(begin, more)
            owner = np.repeat(long, more)
            left = np.minimum(size[owner] - 8 * place, 8)
            block = self._blocks[starts[owner] + 8 * place] & _LOW[left]
            total[long] += np.add.reduceat(mix(block ^ mix(place.astype(np.uint64) + _PLACE)), begin)
        return mix(total + size.astype(np.uint64))

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def spans(word_hash: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (runs that cross texts included)."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for i in range(k):
        out = (out ^ word_hash[i:i + n]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return mix(out)


def whole_spans(words: Words, k: int) -> np.ndarray:
    """Mask over word positions: a run of ``k`` words starts here and stays in its text."""
    ok = np.zeros(len(words), bool)
    last = np.repeat(words.first[1:], words.counts)
    ok[:] = np.arange(len(words)) + k <= last
    return ok


def of_column(column: pa.Array) -> Words:
    return Words(*text_bytes(column))


def sliced(batch: pa.RecordBatch, text: str, most_bytes: int = 1_500_000):
    """Slices of a batch whose texts together stay near ``most_bytes`` (one text at least)."""
    return by_size(batch, text_bytes(batch.column(text))[1], most_bytes)


def by_size(batch: pa.RecordBatch, bounds: np.ndarray, most_bytes: int = 1_500_000):
    """The same where ``bounds`` are running sums of the rows' sizes."""
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(bounds, bounds[at] + most_bytes, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def joined(words: Words, flat: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Per text, its kept words joined by one space."""
    starts, size = words.starts[keep], (words.ends - words.starts)[keep] + 1
    stops = np.cumsum(size)
    take = np.arange(stops[-1] if len(stops) else 0)
    take += np.repeat(starts - (stops - size), size)
    padded = np.append(flat, np.uint8(0x20))
    data = padded[take]
    data[stops - 1] = 0x20
    kept_before = np.concatenate([[0], np.cumsum(keep)])[words.first]
    last = kept_before[1:][np.diff(kept_before) > 0] - 1
    data = np.delete(data, stops[last] - 1)
    ends = np.concatenate([[0], stops])[kept_before]
    ends = ends - np.concatenate([[0], np.cumsum(np.diff(kept_before) > 0)])
    return pa.LargeStringArray.from_buffers(
        len(ends) - 1, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(data)
    ).cast(pa.string())

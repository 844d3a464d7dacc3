"""Token ids in Simple-8b words: encoder, decoder and the segment format.

A word is 64 bits: the top four select how many values share the other 60, all of one width.
Selector 0 is an escape: its payload numbers the value in the segment's table of values that need
more than 60 bits. Every block of ``BLOCK`` values starts a new word, and a table holds the first
word of every block, so blocks can be read alone and many are packed and unpacked in step.

Segment, little-endian: magic, version and block size (32-bit), number of documents, values,
words, escapes and CRC-32 of all that follows (64-bit); then per document its length in values, the
first word of every block, the words, the escaped values (all 64-bit). Documents are named outside.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC, VERSION = 0x42385354, 1
BLOCK = 128
#: Values per word, by selector; selector 0 is the escape. Fixed by the format.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
#: Bits per value, by selector.
WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
_PAYLOAD = np.uint64((1 << 60) - 1)


_SMALL = np.zeros(0, np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs, rounded up to a width; 64 where no width is enough."""
    if len(values) > len(_SMALL) and values.max() < len(_SMALL):
        return _SMALL[values]
    widths = np.unique(WIDTHS)
    return np.append(widths, 64).astype(np.uint8)[np.searchsorted(np.uint64(1) << widths.astype(np.uint64), values, side="right")]


#: Of all values of 16 bits, as those of vocabularies are.
_SMALL = _bits(np.arange(1 << 16, dtype=np.uint64))


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of every block, escaped values); all blocks advance in step.

    A word takes the most values that fit; a block counts as followed by zeros, which no reader takes.
    """
    values = np.asarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // block)
    row = block + int(COUNTS.max())
    padded = np.zeros((blocks, row), np.uint64)
    whole = n // block
    padded[:whole, :block] = values[:whole * block].reshape(whole, block)
    padded[whole:, :n - whole * block] = values[whole * block:]
    padded = padded.reshape(-1)
    need = _bits(padded)
    base = np.arange(blocks) * row
    end = base + np.minimum(block, n - np.arange(blocks) * block)
    at, live = base.copy(), np.arange(blocks)
    starts, selectors = [], []
    while len(live):
        place = at[live]
        selector = np.where(need[place] > WIDTHS[-1], 0, len(COUNTS) - 1)
        grows, widest, size = np.flatnonzero(selector), need[place], 1
        for wider in range(len(COUNTS) - 2, 0, -1):  # more values of less width: once too wide, always too wide
            for k in range(size, COUNTS[wider]):
                widest[grows] = np.maximum(widest[grows], need[place[grows] + k])
            size = COUNTS[wider]
            grows = grows[widest[grows] <= WIDTHS[wider]]
            if not len(grows):
                break
            selector[grows] = wider
        starts.append(place)
        selectors.append(selector)
        at[live] += COUNTS[selector]
        live = live[at[live] < end[live]]
    none = np.zeros(0, np.int64)
    start, selector = np.concatenate([none, *starts]), np.concatenate([none, *selectors])
    order = np.argsort(start)
    start, selector = start[order], selector[order]
    first = np.searchsorted(start, base)
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector).tolist():
        here = np.flatnonzero(selector == s)
        if s == 0:
            words[here] |= np.arange(len(here), dtype=np.uint64)
            continue
        for k in range(COUNTS[s]):
            words[here] |= padded[start[here] + k] << np.uint64(k * WIDTHS[s])
    return words, first.astype(np.int64), padded[start[selector == 0]]


def unpack(words: np.ndarray, first: np.ndarray, escaped: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` values, all words of a selector at a time."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    held = COUNTS[selector]
    before = np.cumsum(held) - held
    # a block's last word may have room for more values than are left
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words))))
    start = owner * block + before - before[first[owner]] if len(words) else before
    stop = np.minimum((owner + 1) * block, n)
    values = np.zeros(n, np.uint64)
    for s in np.unique(selector).tolist():
        here = np.flatnonzero(selector == s)
        payload = words[here] & _PAYLOAD
        if s == 0:
            values[start[here]] = escaped[payload.astype(np.int64)]
            continue
        width = int(WIDTHS[s])
        for k in range(COUNTS[s]):
            there = start[here] + k
            inside = there < stop[here]
            values[there[inside]] = (payload[inside] >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
    return values


def to_segment(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Documents of the given lengths, their values end to end."""
    words, first, escaped = pack(values)
    body = b"".join(np.ascontiguousarray(part, kind).tobytes() for part, kind in (
        (lengths, "<i8"), (first, "<i8"), (words, "<u8"), (escaped, "<u8")))
    head = np.array([MAGIC, VERSION, BLOCK], "<u4").tobytes()
    return head + np.array([len(lengths), len(values), len(words), len(escaped), zlib.crc32(body)], "<i8").tobytes() + body


def from_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths); a damaged segment is an error."""
    magic, version, block = np.frombuffer(data, "<u4", 3).tolist()
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a segment of this format")
    docs, n, n_words, n_escaped, check = np.frombuffer(data, "<i8", 5, 12).tolist()
    if zlib.crc32(memoryview(data)[52:]) != check:
        raise ValueError("segment does not match its checksum")
    ends = 52 + 8 * np.cumsum([0, docs, -(-n // block), n_words, n_escaped])
    lengths, first, words, escaped = (
        np.frombuffer(data, kind, (y - x) // 8, x) for kind, x, y in zip(("<i8", "<i8", "<u8", "<u8"), ends, ends[1:], strict=False))
    return unpack(words, first, escaped, n, block), lengths

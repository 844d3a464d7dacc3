"""Tokenizer libraries over chunks of texts, with a cache bounded in bytes.

Most chunks of a corpus are seen again and again. A chunk is a stretch of text between places
where the tokenizer never joins what stands on both sides, so the ids of a text are those of
its chunks in order. Chunks of a batch are made distinct by Arrow, distinct ones are looked up in
a dictionary, and ids are dealt back to all places at once.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Rough bytes of an entry besides its text and value: two objects and a place in the table.
ENTRY_BYTES = 250
#: Longer chunks are encoded each time and not kept.
LONGEST_KEPT = 512


def one_thread_each() -> None:
    """A task is one core: the library starts no threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


class ChunkCache:
    """Values of chunks in two generations, so that chunks in use survive; each holds ``most_bytes``.

    ``encode`` gives a value other than None for every chunk.
    """

    def __init__(self, encode: Callable[[list[str]], list], most_bytes: int = 64 << 20):
        self.encode, self.most_bytes = encode, most_bytes
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.size = 0

    def look(self, chunks: pa.Array) -> tuple[list, np.ndarray]:
        """(values of the distinct chunks, for every chunk the place of its value)."""
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = list(map(self.young.get, distinct))
        fresh = [i for i, v in enumerate(values) if v is None]
        if self.size + _cost([distinct[i] for i in fresh]) > self.most_bytes:
            self.old, self.young, self.size = self.young, {}, 0
            values, fresh = [None] * len(distinct), range(len(distinct))
        new = []
        for i in fresh:
            values[i] = self.old.get(distinct[i])
            if values[i] is None:
                new.append(i)
        for i, value in zip(new, self.encode([distinct[i] for i in new]), strict=True):
            values[i] = value
        kept = [i for i in fresh if len(distinct[i]) <= LONGEST_KEPT]
        self.young.update((distinct[i], values[i]) for i in kept)
        self.size += _cost([distinct[i] for i in kept])
        return values, coded.indices.to_numpy(zero_copy_only=False)


def _cost(chunks: list[str]) -> int:
    return 2 * sum(map(len, chunks)) + ENTRY_BYTES * len(chunks)


def dealt(values: list[bytes], place: np.ndarray, texts: np.ndarray, kind=np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, bounds of texts): every chunk's 32-bit ids at all its places.

    ``texts`` are the bounds of the texts in ``place``.
    """
    flat = np.frombuffer(b"".join(values), kind)
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    starts = np.cumsum(sizes) - sizes
    size = sizes[place]
    ends = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(ends[-1]) + np.repeat(starts[place] - ends[:-1], size)
    return flat[take], ends[texts]

"""Chat formatting with a grammar round trip.

Grammar: document = turn*; turn = START role LF text END LF. Inside roles and texts a control
string with backslashes after its first two characters stands for itself with one backslash less.
Every turn is rendered plainly first; the deterministic parser reads it back, and where the result
differs from the source the turn is rendered again with its conflicting strings escaped, until
parsed and source turns are identical.

Turns are rendered where they lie; only rendered turns are shuffled, by conversation. Each
conversation is then read back as a stream of chunks in turn order with running digests, so a
conversation of any length needs one batch of memory (its digest is sequential by definition).

Defined cases: null roles and texts are empty; a null id is one conversation of its own; rows of
one turn number follow by rendered bytes; null turn numbers come first; repeated rows are turns
each; an empty table gives no conversations; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<\|(\\*)(im_start|im_end|newline)\|>")
_ESCAPED = re.compile(r"<\|\\(\\*)(im_start|im_end|newline)\|>")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


class GrammarError(ValueError):
    pass


def _escape(text: str) -> str:
    return _CONTROL.sub(r"<|\\\1\2|>", text)


def _unescape(text: str) -> str:
    return _ESCAPED.sub(r"<|\1\2|>", text)


def parse(document: str) -> list[tuple[str, str]]:
    """Turns of a formatted document; raises GrammarError where it leaves the grammar."""
    turns, at = [], 0
    while at < len(document):
        found = _TURN.match(document, at)
        if not found or any(mark in part for mark in (START, END) for part in found.groups()):
            raise GrammarError(f"no turn at character {at}")
        role = _unescape(found[1].replace("<|newline|>", "\n"))
        turns.append((role, _unescape(found[2])))
        at = found.end()
    return turns


def render(role: str, text: str) -> tuple[str, int, int, bool]:
    """(chunk, first and last offset of its text, whether escapes were needed)."""
    for escaped in (False, True):
        head = (_escape(role).replace("\n", "<|newline|>") if escaped else role) if "\n" not in role or escaped else None
        if head is None:
            continue
        body = _escape(text) if escaped else text
        chunk = f"{START}{head}\n{body}{END}\n"
        try:
            if parse(chunk) == [(role, text)]:
                begin = len(START) + len(head) + 1
                return chunk, begin, begin + len(body), escaped
        except GrammarError:
            pass
    raise GrammarError("escaped turn does not survive its round trip")


def format_turns(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """(key, turn, chunk, loss_from, loss_to, escaped): a document is its chunks in order.

    Offsets count code points of the chunk and are null for turns outside the loss mask.
    """
    def run(batches):
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            made = [render(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
            loss = [r == "assistant" for r in roles]
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("turn"), pa.array([m[0] for m in made], pa.string()),
                pa.array([m[1] if x else None for m, x in zip(made, loss, strict=True)], pa.int64()),
                pa.array([m[2] if x else None for m, x in zip(made, loss, strict=True)], pa.int64()),
                pa.array([m[3] for m in made], pa.bool_())],
                ["key", "turn", "chunk", "loss_from", "loss_to", "escaped"])

    named = conversations.select(F.col(key).cast("long").alias("key"), F.col(turn).cast("long").alias("turn"),
                                 F.col(role).alias("role"), F.col(text).alias("text"))
    return named.mapInArrow(
        run, "key long, turn long, chunk string, loss_from long, loss_to long, escaped boolean"
    ).withColumnRenamed("key", key)


class _Reader:
    """Running digests of one conversation."""

    def __init__(self, key):
        self.key, self.turns, self.chars, self.loss_chars = key, 0, 0, 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def add(self, chunk: str, begin: int | None, end: int | None) -> None:
        self.chars += len(chunk)
        for role, text in parse(chunk):
            self.turns += 1
            self.turns_sha.update(f"{role}\n{text}\n".encode())
        if begin is not None:
            masked = _unescape(chunk[begin:end])
            self.loss_chars += len(masked)
            self.loss_sha.update(masked.encode())

    def row(self):
        return (self.key, self.turns, self.turns_sha.hexdigest(), self.loss_chars, self.loss_sha.hexdigest(), self.chars)


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per conversation what parser and loss mask give back from the formatted chunks."""
    names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches):
        reader = None
        for batch in batches:
            done = []
            columns = (batch.column(c).to_pylist() for c in ("key", "chunk", "loss_from", "loss_to"))
            for k, chunk, begin, end in zip(*columns, strict=True):
                if reader is None or reader.key != k:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(k)
                reader.add(chunk, begin, end)
            if done:
                yield batch_of(done)
        if reader is not None:
            yield batch_of([reader.row()])

    return (
        formatted.withColumnRenamed(key, "key").select("key", "turn", "chunk", "loss_from", "loss_to")
        .repartition("key").sortWithinPartitions("key", "turn", "chunk")
        .mapInArrow(run, "key long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
        .withColumnRenamed("key", key)
    )

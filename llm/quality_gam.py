"""Quality classifier: generalised additive model with pairwise interactions.

Shallow trees are boosted in turn over single features, each only adding to that feature's lookup
table over quantile bins; then over the feature pairs that explain most of what is left. A score
is the logistic of the intercept plus one table entry per feature and pair, by vectorised lookups.

Training reads a bounded sample (``sample_rows`` labelled rows, by hash of the id); scoring is one
pass over whole texts without a shuffle. Inputs are measures of the text alone.

Defined cases: a null text is empty and scored like any text (all measures 0); labels absent or of
one class give a constant score (their mean, 0.5 without any); repeated rows are scored each;
other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.frames import labelled_sample
from llm.words import Words, sliced, spans, text_bytes, whole_spans

FEATURES = (
    "log_words", "word_bytes", "symbols", "upper", "digits", "exclaim", "pipes", "stops", "commas", "lines",
    "line_words", "repeated_lines", "distinct", "again", "top_word", "repeated_runs", "other_bytes", "long_words",
    "one_byte_words", "longest_word", "markup",
)


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.float64)
    table[list(chars.encode())] = 1
    return table


_SYMBOLS, _EXCLAIM, _PIPES = _class("#*$%&|<>{}[]\\^~_=+@"), _class("!?"), _class("|")
_STOPS, _COMMAS, _DIGITS = _class(".!?:"), _class(",;"), _class("0123456789")
_UPPER, _MARKUP = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("<>/=")
_HIGH = np.where(np.arange(256) >= 0x80, 1.0, 0.0)


def measures(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    flat, bounds = text_bytes(column)
    words = Words(flat, bounds)
    n, texts = words.counts, len(bounds) - 1
    many, size = np.maximum(n, 1), np.maximum(np.diff(bounds), 1)
    of = words.doc_of()

    def per_text(table):
        total = np.concatenate([[0], np.cumsum(table[flat])])
        return total[bounds[1:]] - total[bounds[:-1]]

    length = (words.ends - words.starts).astype(float)

    def by_word(values):
        return np.bincount(of, values, texts)

    def repeats(h, owner, parts):
        """(entries that equal an earlier one of their text, most frequent entry) per text."""
        order = np.lexsort((h, owner))
        a, b = h[order], owner[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group = np.cumsum(new) - 1
        count = np.bincount(group, minlength=int(new.sum()))
        most = np.zeros(texts)
        np.maximum.at(most, b[new], count)
        return np.bincount(b, ~new, texts) / parts, most / parts

    again = np.zeros(len(words))
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])
    word_repeat, top = repeats(words.hash, of, many)
    ok = np.flatnonzero(whole_spans(words, 8))
    runs = spans(words.hash, 8)
    run_repeat, _ = repeats(runs[ok] if len(ok) else np.zeros(0, np.uint64), of[ok], np.maximum(n - 7, 1))
    breaks = np.concatenate([[0], np.cumsum(flat == 0x0A)])
    line = breaks[words.starts]
    head = np.ones(len(words), bool)
    head[1:] = (line[1:] != line[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(head)
    lines = np.bincount(of[at], minlength=texts)
    stop = np.append(at[1:], len(words)) - 1
    line_hash = words.bytes_hash(words.starts[at], words.ends[stop]) if len(at) else np.zeros(0, np.uint64)
    line_repeat, _ = repeats(line_hash, of[at], np.maximum(lines, 1))
    longest = np.zeros(texts)
    np.maximum.at(longest, of, length)
    return np.column_stack([
        np.log1p(n), by_word(length) / many, per_text(_SYMBOLS) / many, per_text(_UPPER) / size,
        per_text(_DIGITS) / size, per_text(_EXCLAIM) / many, per_text(_PIPES) / many, per_text(_STOPS) / many,
        per_text(_COMMAS) / many, np.log1p(lines), n / np.maximum(lines, 1), line_repeat, 1 - word_repeat,
        by_word(again) / many, top, run_repeat, per_text(_HIGH) / size, by_word(length >= 14) / many,
        by_word(length == 1) / many, longest, per_text(_MARKUP) / many,
    ])


@dataclass
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if self.edges:
            b = self.bins(x)
            for i, table in enumerate(self.tables):
                total += table[b[:, i]]
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(g, h, pace, ridge):
    return pace * g.sum() / (h.sum() + ridge)


def _best_cut(g, h, ridge) -> tuple[int, float]:
    """Cut of a run of bins that gains most (0: none)."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0, 0.0
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g ** 2 / (left_h + ridge) + right_g ** 2 / (right_h + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    at = int(gain.argmax())
    return (at + 1, float(gain[at])) if gain[at] > 1e-9 else (0, 0.0)


def _tree(g, h, depth, pace, ridge) -> np.ndarray:
    """Step for every bin by a tree of the given depth over the bins."""
    cut, _ = _best_cut(g, h, ridge) if depth else (0, 0.0)
    if not cut:
        return np.full(len(g), _leaf(g, h, pace, ridge))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1, pace, ridge),
                           _tree(g[cut:], h[cut:], depth - 1, pace, ridge)])


def _pair_tree(g, h, pace, ridge) -> np.ndarray:
    """Tree with one cut of the first feature and one cut of the second below each side.

    The first cut is the one whose sides gain most from their own cuts: an interaction may
    show nothing at the first cut alone.
    """
    up, down = np.cumsum(g, 0), np.cumsum(h, 0)

    def worth(g_side, h_side) -> float:
        return _best_cut(g_side, h_side, ridge)[1] + g_side.sum() ** 2 / (h_side.sum() + ridge)
    gains = [worth(up[i], down[i]) + worth(up[-1] - up[i], down[-1] - down[i]) for i in range(len(g) - 1)]
    cut = int(np.argmax(gains)) + 1 if gains else 0
    out = np.zeros_like(g)
    for rows in (slice(0, cut), slice(cut, None)) if cut else (slice(None),):
        out[rows] = _tree(g[rows].sum(0), h[rows].sum(0), 1, pace, ridge)
    return out


def _pair_gain(g, h, ridge) -> float:
    """What the best cross of one cut each gains over the better single cut."""
    sums = [np.cumsum(np.cumsum(t, 0), 1) for t in (g, h)]
    total_g, total_h = sums[0][-1, -1], sums[1][-1, -1]
    best = 0.0
    for i in range(g.shape[0] - 1):
        a_g, a_h = sums[0][i, :-1], sums[1][i, :-1]
        quads = [(a_g, a_h), (sums[0][i, -1] - a_g, sums[1][i, -1] - a_h),
                 (sums[0][-1, :-1] - a_g, sums[1][-1, :-1] - a_h)]
        rest = (total_g - sum(q[0] for q in quads), total_h - sum(q[1] for q in quads))
        best = max(best, float(sum(q[0] ** 2 / (q[1] + ridge) for q in [*quads, rest]).max(initial=0)))
    return best


def fit_tables(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, n_pairs: int = 6,
               pair_rounds: int = 60, pace: float = 0.15, ridge: float = 1.0) -> AdditiveModel:
    """Cyclic boosting on the logistic loss; ``bins`` quantile bins per feature."""
    if not len(y) or y.min() == y.max():
        mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return AdditiveModel(float(np.log(mean / (1 - mean))))
    mean = y.mean()
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) for i in range(x.shape[1])]
    model = AdditiveModel(float(np.log(mean / (1 - mean))), edges, [np.zeros(len(e) + 1) for e in edges])
    b = model.bins(x)
    total = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, table in enumerate(model.tables):
            g, h = slopes()
            step = _tree(np.bincount(b[:, i], g, len(table)), np.bincount(b[:, i], h, len(table)), 2, pace, ridge)
            table += step
            total += step[b[:, i]]

    def grid(i, j, values):
        rows, columns = len(model.tables[i]), len(model.tables[j])
        return np.bincount(b[:, i] * columns + b[:, j], values, rows * columns).reshape(rows, columns)

    g, h = slopes()
    ranked = sorted(((_pair_gain(grid(i, j, g), grid(i, j, h), ridge), i, j)
                     for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in ranked[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = _pair_tree(grid(i, j, g), grid(i, j, h), pace, ridge)
            table += step
            total += step[b[:, i], b[:, j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        sample_rows: int = 20_000) -> AdditiveModel:
    """Measures of at most ``sample_rows`` labelled rows come to the driver (21 numbers a row)."""
    def run(batches):
        for batch in batches:
            for part in sliced(batch, "text"):
                x = measures(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("label"), *(pa.array(c) for c in x.T)], ["key", "label", *FEATURES])
    sample = labelled_sample(docs, labels, label, sample_rows, key, text)
    kind = sample.schema["key"].dataType.simpleString()
    schema = f"key {kind}, label int, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = sample.mapInArrow(run, schema).toPandas().sort_values(["key", *FEATURES])
    return fit_tables(rows[list(FEATURES)].to_numpy(float), (rows["label"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: AdditiveModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): how likely label 1 is, for every row."""
    def run(batches):
        for batch in batches:
            for part in sliced(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(model.score(measures(part.column("text"))))], ["key", "score"])
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = named.schema["key"].dataType.simpleString()
    return named.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)

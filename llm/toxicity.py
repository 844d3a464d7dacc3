"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity grades are 0 (not toxic), 1 and 2 (toxic; up to or above the median number of toxic terms
among toxic training rows). P(grade > j) = sigmoid(score - threshold_j): one weight vector is
shared by the ordered thresholds. Features are log(1 + count) of the terms whose rates in toxic and other training rows
differ significantly; terms are lower-case words without punctuation and their first 4, 5 and 6
bytes (a stem whose endings vary), named by 64-bit hashes.

Training reads a bounded sample (``sample_rows`` labelled rows, by hash of the id); term
statistics come from a Spark aggregation over it. Scoring is one pass over whole texts without a
shuffle, with a model of at most ``max_terms`` weights.

Defined cases: a null or empty text has no terms; labels absent, empty or of one class give a
model that finds nothing; repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.frames import labelled_sample, materialised
from llm.words import PUNCTUATED, Words, sliced, text_bytes

STEMS = (4, 5, 6)


@dataclass
class OrdinalModel:
    terms: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for every threshold j."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -50, 50)))


class _Terms:
    """Terms of every text: hashes and, aligned with them, text numbers."""

    def __init__(self, column: pa.Array):
        words = Words(*text_bytes(pc.utf8_lower(column.cast(pa.large_string()))), PUNCTUATED)
        size, text = words.ends - words.starts, words.doc_of()
        hashes, texts = [words.hash], [text]
        for stem in STEMS:
            long = np.flatnonzero(size > stem)
            starts = words.starts[long]
            hashes.append(words.bytes_hash(starts, starts + stem) ^ np.uint64(stem))
            texts.append(text[long])
        self.hash, self.text = np.concatenate(hashes), np.concatenate(texts)


def _counts(found: _Terms, terms: np.ndarray):
    """(text, term number, count) of the ``terms``, sorted by text."""
    filter_ = np.zeros(1 << 16, bool)
    filter_[(terms >> np.uint64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(filter_[(found.hash >> np.uint64(48)).astype(np.int64)])
    if not len(maybe):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(terms, found.hash[maybe]), len(terms) - 1)
    ok = terms[at] == found.hash[maybe]
    pair, count = np.unique(found.text[maybe[ok]] * len(terms) + at[ok], return_counts=True)
    return pair // len(terms), pair % len(terms), count


def _term_rows(batches):
    """(term, toxic rows with it, rows with it), summed per slice."""
    for batch in batches:
        for part in sliced(batch, "text"):
            found = _Terms(part.column("text"))
            toxic = part.column("label").to_numpy() > 0
            order = np.lexsort((found.text, found.hash))
            h, text = found.hash[order], found.text[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])[:len(h)]
            term, at = np.unique(h[new], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(term.view(np.int64)), pa.array(np.bincount(at, toxic[text[new]], len(term)).astype(np.int64)),
                 pa.array(np.bincount(at, minlength=len(term)).astype(np.int64))], ["term", "toxic", "rows"])


def _select_terms(sample: DataFrame, least_z: float, least_rows: int, max_terms: int) -> np.ndarray:
    total = sample.agg(F.count("*"), F.sum(F.when(F.col("label") > 0, 1).otherwise(0))).first()
    n, bad = total[0], total[1] or 0
    if not bad or bad == n:
        return np.zeros(0, np.uint64)
    share = bad / n
    z = (F.col("toxic") - F.col("rows") * share) / F.sqrt(F.col("rows") * share * (1 - share))
    found = (
        sample.select("label", "text").mapInArrow(_term_rows, "term long, toxic long, rows long")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows"))
        .where((F.col("rows") >= least_rows) & (F.abs(z) >= least_z))
        .orderBy(F.abs(z).desc(), "term").limit(max_terms).select("term").collect()
    )
    return np.sort(np.array([r.term for r in found], np.int64).view(np.uint64))


def _features(terms: np.ndarray):
    def run(batches):
        for batch in batches:
            for part in sliced(batch, "text"):
                found = _Terms(part.column("text"))
                text, term, count = _counts(found, terms)
                cut = np.searchsorted(text, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"),
                     pa.array([term[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int64())),
                     pa.array([count[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int64()))],
                    ["label", "terms", "counts"])
    return run


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        sample_rows: int = 20_000, max_terms: int = 2_048, least_z: float = 7.5, least_rows: int = 8,
        steps: int = 600) -> OrdinalModel:
    """Fit on at most ``sample_rows`` labelled rows; see the module text."""
    sample = materialised(labelled_sample(docs, labels, label, sample_rows, key, text), "toxic-sample")
    terms = _select_terms(sample, least_z, least_rows, max_terms)
    if not len(terms):
        return OrdinalModel(terms, np.zeros(0), np.array([20.0, 40.0]))
    rows = sample.select("label", "text").mapInArrow(
        _features(terms), "label int, terms array<long>, counts array<long>").collect()
    y = np.array([r.label > 0 for r in rows])
    at = np.repeat(np.arange(len(rows)), [len(r.terms) for r in rows])
    term = np.array([t for r in rows for t in r.terms], np.int64)
    x = np.log1p(np.array([c for r in rows for c in r.counts], float))
    lifts = np.bincount(term, y[at], len(terms)) / np.maximum(1, np.bincount(term, minlength=len(terms))) > y.mean()
    amount = np.bincount(at, np.expm1(x) * lifts[term], len(rows))
    grade = np.where(y, 1 + (amount > np.median(amount[y])), 0)
    return _fit_weights(terms, at, term, x, grade, steps)


def _fit_weights(terms, at, term, x, grade, steps, penalty=1e-5, pace=0.05) -> OrdinalModel:
    """Adam on the cumulative-link likelihood; a positive gap keeps the thresholds in order."""
    n = len(grade)
    p = np.concatenate([np.zeros(len(terms)), [2.0, 1.0]])  # weights, first threshold, log gap
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        score = np.bincount(at, p[term] * x, n)
        cuts = np.array([p[-2], p[-2] + np.exp(p[-1])])
        s = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(cuts - score[:, None], -50, 50))), np.zeros((n, 1))])
        slope = s * (1 - s)
        mass = np.maximum(s[np.arange(n), grade] - s[np.arange(n), grade + 1], 1e-12)
        # derivative of log P(grade) by the score at either side of the grade's interval
        high, low = slope[np.arange(n), grade] / mass, slope[np.arange(n), grade + 1] / mass
        by_score = high - low
        by_cut = np.zeros((n, 4))
        by_cut[np.arange(n), grade] -= high
        by_cut[np.arange(n), grade + 1] += low
        by_cut = by_cut[:, 1:3].sum(0)
        grad = np.concatenate([np.bincount(term, by_score[at] * x, len(terms)),
                               [by_cut.sum(), by_cut[1] * np.exp(p[-1])]]) / n
        grad[:-2] -= penalty * p[:-2]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        p = p + pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return OrdinalModel(terms, p[:-2], np.array([p[-2], p[-2] + np.exp(p[-1])]))


def score(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text",
          reject_at: float = 0.25) -> DataFrame:
    """(key, severity, grade, toxic): expected grade, likeliest grade, P(grade > 0) >= ``reject_at``."""
    def run(batches):
        for batch in batches:
            for part in sliced(batch, "text"):
                at, term, count = _counts(_Terms(part.column("text")), model.terms)
                total = np.bincount(at, model.weights[term] * np.log1p(count), part.num_rows)
                exceed = model.exceed(total)
                mass = -np.diff(np.hstack([np.ones((len(total), 1)), exceed, np.zeros((len(total), 1))]), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(exceed.sum(1)), pa.array(mass.argmax(1).astype(np.int32)),
                     pa.array(exceed[:, 0] >= reject_at)], ["key", "severity", "grade", "toxic"])
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = named.schema["key"].dataType.simpleString()
    return named.mapInArrow(run, f"key {kind}, severity double, grade int, toxic boolean").withColumnRenamed("key", key)


def keep_clean(docs: DataFrame, model: OrdinalModel, text: str = "text", reject_at: float = 0.25) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns unchanged, in one pass."""
    def run(batches):
        for batch in batches:
            for part in sliced(batch, text):
                at, term, count = _counts(_Terms(part.column(text)), model.terms)
                total = np.bincount(at, model.weights[term] * np.log1p(count), part.num_rows)
                yield part.filter(pa.array(model.exceed(total)[:, 0] < reject_at))
    return docs.mapInArrow(run, docs.schema)

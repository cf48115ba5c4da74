"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w.x - c_k) with one weight vector w for all grades and ordered cut points c_1 <= c_2 <= ...
x holds log(1 + n) of the n words of a text with a feature: a word whole, or its first 4, 5 or 6 bytes. A text's
expected severity is the sum of P(grade >= k) over the grades; it is toxic where P(grade >= 1) is 0.5 or more.

The fit takes at most FIT_ROWS labelled documents, those with the smallest hashes of doc_id. Features are those
that toxic documents of the fit have clearly more or less often than others (at most MAX_FEATURES, a parameter of the
model: the strongest). Labels of more than two grades are taken as they are. 0/1 labels hold no severity, so one is
made: toxic documents get 1, 2 or 3 by the third they fall in by words with enriched features. Severity is then how
much of what tells toxic documents apart a text has, not how bad people find it. Every document of the table is scored, whole, by the same model; nothing
is shuffled for that.

Defined results
* null or empty text has no features and the severity of the cut points alone.
* A-Z are lower-cased; words are [^\\x20\\x09-\\x0D]+.
* labels: null ones don't count, of several for a doc_id the highest does, unknown doc_ids are ignored; of rows that
  share a labelled doc_id the fit takes the least text. Without a
  toxic and a clean document in the fit, severity is 0 for all.
* rows that repeat, and null doc_ids, are scored as any row; an empty table gives an empty result; other columns
  are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch
from .wordvec import blocks, mix, powers, word_places

FIT_ROWS = 30_000
MAX_FEATURES = 4_096
#: A feature is kept if its share among toxic documents is RATIO times that among others, or the other way, and the
#: root of its likelihood ratio statistic is Z or more.
RATIO, Z = 3.0, 5.0
PREFIXES = (4, 5, 6)
STEPS, RATE, RIDGE = 400, 0.1, 1e-3
SIFT = 1 << 22


def features(octets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit features of a block's words: (word, feature) pairs, and the text of each word."""
    starts, ends, first = word_places(octets, offsets)
    up, down = powers(len(octets) + 1)
    sums = np.zeros(len(octets) + 1, dtype=np.uint64)
    np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * up[: len(octets)], out=sums[1:])
    length = ends - starts
    words, found = [], []
    for k in (0, *PREFIXES):  # 0: whole
        at = np.flatnonzero(length >= k)
        stop = starts[at] + k if k else ends
        h = mix((sums[stop] - sums[starts[at]]) * down[starts[at]] + np.uint64(k << 32))
        words.append(at)
        found.append((h >> np.uint64(32)).astype(np.uint32))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return np.concatenate(words), np.concatenate(found), text


@dataclass
class Model:
    """features: sorted; weights: one each; cuts: ascending, one for each grade above 0."""

    features: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def __post_init__(self):
        self.sift = np.zeros(SIFT, dtype=bool)
        self.sift[self.features & (SIFT - 1)] = True

    def counts(self, octets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, column, number of words) of a block's known features."""
        words, found, text = features(octets, offsets)
        maybe = np.flatnonzero(self.sift[found & (SIFT - 1)]) if len(self.features) else np.zeros(0, dtype=np.int64)
        column = np.minimum(np.searchsorted(self.features, found[maybe]), max(len(self.features) - 1, 0))
        true = self.features[column] == found[maybe] if len(maybe) else np.zeros(0, dtype=bool)
        cell = text[words[maybe[true]]] * max(len(self.features), 1) + column[true]
        cell, n = np.unique(cell, return_counts=True)
        return cell // max(len(self.features), 1), cell % max(len(self.features), 1), n

    def margins(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for at, octets, offsets in blocks(column):
            text, feature, n = self.counts(octets, offsets)
            out[at : at + len(offsets) - 1] = np.bincount(text, self.weights[feature] * np.log1p(n), minlength=len(offsets) - 1)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_ordinal(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, n_columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cut points of greatest penalised likelihood, by Adam on the cumulative-link likelihood.

    The cuts are a first one and steps exp(.) up, so they stay ordered.
    """
    top = int(grade.max())
    n = len(grade)
    w = np.zeros(n_columns)
    free = np.concatenate([[1.0], np.zeros(top - 1)])
    each = np.full(n, 1 / n)
    first = second = np.zeros(n_columns + top)
    for step in range(1, STEPS + 1):
        cuts = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
        margin = np.bincount(row, w[column] * value, minlength=n)
        above = np.column_stack([np.ones(n), sigmoid(margin[:, None] - cuts), np.zeros(n)])  # P(grade >= k), k = 0 .. top + 1
        slope = above * (1 - above)
        at = np.arange(n)
        p = np.maximum(above[at, grade] - above[at, grade + 1], 1e-12)
        d_margin = -each * (slope[at, grade] - slope[at, grade + 1]) / p
        d_cut = np.zeros(top + 2)
        np.add.at(d_cut, grade, each * slope[at, grade] / p)
        np.add.at(d_cut, grade + 1, -each * slope[at, grade + 1] / p)
        d_cut = d_cut[1 : top + 1]
        d_w = np.bincount(column, d_margin[row] * value, minlength=n_columns) + RIDGE * w / max(n_columns, 1)
        d_free = np.concatenate([[d_cut.sum()], [d_cut[k:].sum() * np.exp(free[k]) for k in range(1, top)]])
        g = np.concatenate([d_w, d_free])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-12)
        w, free = w - move[:n_columns], free - move[n_columns:]
    return w, np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])


def labelled(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """(grade, text) of at most limit labelled documents, one row an id; their ids are the one broadcast."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.greatest(F.max("toxic"), F.lit(0)).cast("int").alias("grade"))
    few = ids.orderBy(F.xxhash64("_id"), "_id").limit(limit)
    found = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "_id")
    return found.groupBy("_id").agg(F.first("grade").alias("grade"), F.min("text").alias("text")).select("grade", "text")


def select_features(rows: DataFrame) -> np.ndarray:
    """Sorted features that tell toxic documents from others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = np.array(b.column(0).to_pylist()) > 0
            for at, octets, offsets in blocks(b.column(1)):
                words, found, text = features(octets, offsets)
                pair = np.unique((found.astype(np.uint64) << np.uint64(32)) | text[words].astype(np.uint64))
                feature, bad = (pair >> np.uint64(32)).astype(np.int64), toxic[at + (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)]
                start = np.flatnonzero(np.append(True, feature[1:] != feature[:-1])) if len(feature) else np.zeros(0, dtype=np.int64)
                t = np.add.reduceat(bad.astype(np.int64), start) if len(start) else np.zeros(0, dtype=np.int64)
                yield batch(["f", "t", "c"], feature[start], t, np.diff(np.append(start, len(feature))) - t)

    n = {r.bad: r.n for r in rows.groupBy((F.col("grade") > 0).alias("bad")).agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return np.zeros(0, dtype=np.uint32)
    sums = rows.mapInArrow(run, "f long, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    p, q = (F.col("t") + 0.5) / (n[True] + 1), (F.col("c") + 0.5) / (n[False] + 1)
    part = n[True] / (n[True] + n[False])
    over = lambda k, of: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / ((F.col("t") + F.col("c")) * of))).otherwise(F.lit(0.0))
    z = F.sqrt(2 * F.greatest(over("t", part) + over("c", 1 - part), F.lit(0.0)))
    picked = sums.where((F.abs(F.log(p / q)) >= float(np.log(RATIO))) & (z >= Z)).orderBy(F.round(z, 6).desc(), "f").limit(MAX_FEATURES)
    return np.sort(np.array([r.f for r in picked.select("f").collect()], dtype=np.uint32))


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Model:
    rows = labelled(docs, labels, limit)
    known = Model(select_features(rows), np.zeros(0), np.zeros(0))
    if not len(known.features):
        return Model(known.features, known.weights, np.full(3, np.inf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grade = np.array(b.column(0).to_pylist(), dtype=np.int32)
            for at, octets, offsets in blocks(b.column(1)):
                text, column, n = known.counts(octets, offsets)
                cut = np.searchsorted(text, np.arange(len(offsets)))
                lists = lambda x: pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(x.astype(np.int32)))
                yield batch(["grade", "columns", "counts"], grade[at : at + len(offsets) - 1], lists(column), lists(n))

    table = rows.mapInArrow(run, "grade int, columns array<int>, counts array<int>").toArrow()  # limit rows at most
    table = table.sort_by([("grade", "ascending")]).combine_chunks()
    grade = table["grade"].to_numpy()
    columns, counts = table["columns"].combine_chunks(), table["counts"].combine_chunks()
    row = np.repeat(np.arange(len(grade)), columns.value_lengths().to_numpy())
    column, n = columns.flatten().to_numpy(), counts.flatten().to_numpy()
    if grade.max() == 1:
        much = np.bincount(row, n, minlength=len(grade))
        cuts = np.quantile(much[grade == 1], [1 / 3, 2 / 3])
        grade = np.where(grade == 1, 1 + (much[:, None] > cuts).sum(1), 0)
    weights, cuts = fit_ordinal(row, column, np.log1p(n), grade, len(known.features))
    return Model(known.features, weights, cuts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade), grade (the most likely), p_toxic, toxic."""
    sent = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.cuts))
    names = ["doc_id", "severity", "grade", "p_toxic", "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for b in batches:
            above = sigmoid(own.margins(b.column(1))[:, None] - own.cuts)
            single = np.column_stack([np.ones(len(above)), above]) - np.column_stack([above, np.zeros(len(above))])
            yield batch(names, b.column(0), above.sum(1), single.argmax(1).astype(np.int32), above[:, 0].copy(), above[:, 0] >= 0.5)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def report(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    return score(docs, fit(docs, labels, limit)).withColumns({c: F.round(c, 6) for c in ("severity", "p_toxic")})

"""Ranked lexical search: WAND over document shards.

1. The items' different terms are numbered. One scan turns each document into its length and its counts of those
   terms (a written table), and sums up the corpus: documents, their terms, documents that hold each term.
2. Each task is a shard. It takes its documents in blocks and makes posting lists of a block: document numbers and
   impacts, with each list's maximum. For every item the WAND rule selects pivots: a document can enter the item's heap
   only if the maxima of the lists that hold it reach the heap's threshold, so a block whose maxima fall short together
   is skipped. Pivots are scored exactly, the most promising first, until none left can reach the threshold, which
   rises meanwhile. A task keeps its heaps from block to block.
3. The shards' heaps, `top` rows an item at most each, are merged by a ranking that Spark limits before its shuffle.

The items' terms are sent to all tasks in blocks of MAX_TERMS; where there are several, the documents are scanned once
a block. Weights, impacts and scores are integers, so the order in which they are added doesn't matter.

Defined results
* null text: no terms. Documents and items without terms take no part. A null doc_id comes after others at equal scores.
* rows of documents that repeat are documents of their own; equal (item_id, text) rows of items are one item; several
  texts under one item_id are one item with all their terms. A null item_id is an item like others.
* very long texts are searched whole; empty tables give empty results; other columns are not looked at and may have
  any names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, batch, checkpoint, longs

#: The characters of a term, as UTF-8 bytes of a text whose A-Z are lower-cased.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Factors of the scores.
SCALE, UNIT, LENGTH_SHARE, LENGTH_FACTOR = 1_000_000_000, 1_000, 75, 8
#: Different terms of the items that one scan looks for: at most so many and one item more are sent to all tasks.
MAX_TERMS = 500_000
#: Documents of a block, and postings after which it is closed at the latest.
BLOCK, MAX_POSTINGS = 4_096, 2_000_000
#: Pivots that are scored before the threshold is looked at again.
WAVE = 64


def terms(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, all their terms, and by term of the items the documents that hold it."""

    documents: int
    length: int
    held_by: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * int(df) + 1))) for df in self.held_by], dtype=np.int64)

    def moderation(self, lengths: np.ndarray) -> np.ndarray:
        """m of documents of these lengths."""
        return 100 - LENGTH_SHARE + LENGTH_SHARE * lengths * self.documents // max(self.length, 1)


@dataclass(frozen=True)
class Items:
    """A block of items: ids, and for each its terms (numbers in `known`) and how often it has them."""

    ids: list
    known: dict[bytes, int]
    terms: list[np.ndarray]
    times: list[np.ndarray]


def item_blocks(benchmark: DataFrame, most: int = MAX_TERMS) -> Iterator[Items]:
    """The items in blocks of about `most` different terms, one at a time, whatever their number."""
    rows = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).distinct()
    ids: list = []
    known: dict[bytes, int] = {}
    found: list[Counter] = []

    def block() -> Items:
        order = [sorted(c) for c in found]
        return Items(list(ids), dict(known), [np.array(o, dtype=np.int64) for o in order], [np.array([c[k] for k in o], dtype=np.int64) for c, o in zip(found, order)])

    for row in rows.repartitionByRange("item_id").sortWithinPartitions("item_id").toLocalIterator():
        counts = Counter(terms((row["text"] or "").encode()))
        if not counts:
            continue
        same = bool(ids) and ids[-1] == row["item_id"]
        if len(known) >= most and not same:
            yield block()
            ids, known, found = [], {}, []
        numbers = Counter({known.setdefault(t, len(known)): n for t, n in counts.items()})
        if same:
            found[-1] += numbers
        else:
            ids.append(row["item_id"])
            found.append(numbers)
    if ids:
        yield block()


def postings(docs: DataFrame, known: Broadcast) -> DataFrame:
    """(doc_id, n, terms, times) for each document with a term; terms and times: those of the items that it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = known.value
        for b in batches:
            keep, n, found, times, ends = [], [], [], [], [0]
            for k, text in enumerate(as_bytes(b.column(1))):
                words = terms(text)
                if not words:
                    continue
                counts = Counter(words)
                own = [(numbers[t], counts[t]) for t in counts.keys() & numbers.keys()]
                keep.append(k)
                n.append(len(words))
                found += [t for t, _ in own]
                times += [c for _, c in own]
                ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (found, times)]
            yield batch(["doc_id", "n", "terms", "times"], b.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, times array<int>")


def statistics(found: DataFrame, n_terms: int) -> Corpus:
    """Sums over postings(); each task sends a row a term, and two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, length = np.zeros(n_terms, dtype=np.int64), 0, 0
        for b in batches:
            documents += b.num_rows
            length += int(longs(b.column(0)).sum())
            held += np.bincount(b.column(1).flatten().to_numpy(), minlength=n_terms)
        if documents:
            some = np.flatnonzero(held)
            yield batch(["term", "c"], np.append(some, [-1, -2]), np.append(held[some], [documents, length]))

    sums = found.select("n", "terms").mapInArrow(run, "term long, c long").groupBy("term").agg(F.sum("c").alias("c")).toArrow()  # a row a term of the items
    by = dict(zip(sums["term"].to_pylist(), sums["c"].to_pylist()))
    return Corpus(by.get(-1, 0), by.get(-2, 0), np.array([by.get(t, 0) for t in range(n_terms)], dtype=np.int64))


class Heap:
    """The best `top` (score, doc_id) of one item so far; equal scores by doc_id, nulls (no number) last."""

    def __init__(self, top: int):
        self.top, self.scores, self.docs = top, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def threshold(self) -> int:
        """What a document must score at least to enter: equal scores may win by doc_id."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def push(self, scores: np.ndarray, docs: np.ndarray) -> None:
        scores, docs = np.concatenate([self.scores, scores]), np.concatenate([self.docs, docs])
        best = np.lexsort((docs, -scores))[: self.top]
        self.scores, self.docs = scores[best], docs[best]


class Block:
    """Posting lists of some documents: numbers and impacts by term, and each list's maximum."""

    def __init__(self, size: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.size, self.doc, term, self.impact = size, doc[order], term[order], impact[order]
        cuts = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, dtype=np.int64)
        self.names = term[cuts]
        self.cuts = np.append(cuts, len(term))
        self.most = np.maximum.reduceat(self.impact, cuts) if len(cuts) else self.names

    def search(self, wanted: np.ndarray, times: np.ndarray, ids: np.ndarray, heap: Heap) -> int:
        """Offers the block's documents to an item's heap; how many were scored."""
        if not len(self.names):
            return 0
        at = np.minimum(np.searchsorted(self.names, wanted), len(self.names) - 1)
        there = self.names[at] == wanted
        at, times = at[there], times[there]
        most = self.most[at] * times
        least = heap.threshold()
        if most.sum() < least:
            return 0
        order = np.argsort(-most, kind="stable")
        at, times, most = at[order], times[order], most[order]
        lists = [self.doc[self.cuts[k] : self.cuts[k + 1]] for k in at]
        # Pivots: the documents for which the maxima of the lists that hold them reach the threshold.
        bound = np.zeros(self.size, dtype=np.int64)
        for docs, m in zip(lists, most):
            bound[docs] += m
        pivots = np.flatnonzero(bound >= least)
        if not len(pivots):
            return 0
        pivots = pivots[np.argsort(-bound[pivots], kind="stable")]
        exact: np.ndarray | None = None
        scored, step = 0, WAVE
        while scored < len(pivots) and bound[pivots[scored]] >= heap.threshold():
            wave = pivots[scored : scored + step]
            if len(wave) * 8 < len(pivots) and exact is None:
                scores = np.zeros(len(wave), dtype=np.int64)
                for k, docs, n in zip(at, lists, times):
                    place = np.minimum(np.searchsorted(docs, wave), len(docs) - 1)
                    hit = docs[place] == wave
                    scores[hit] += self.impact[self.cuts[k] + place[hit]] * n
            else:  # many are left: all at once costs less
                if exact is None:
                    exact = np.zeros(self.size, dtype=np.int64)
                    for k, docs, n in zip(at, lists, times):
                        exact[docs] += self.impact[self.cuts[k] : self.cuts[k + 1]] * n
                scores = exact[wave]
            good = scores >= heap.threshold()
            heap.push(scores[good], ids[wave[good]])
            scored, step = scored + len(wave), 2 * step
        return scored


NO_ID = np.iinfo(np.int64).max


def shards(found: DataFrame, items: Broadcast, corpus: Broadcast, top: int, size: int, most: int) -> DataFrame:
    """(item, doc_id, score): each task's heaps; item is the item's number in the block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known, weights = items.value, corpus.value, corpus.value.weights()
        heaps = [Heap(top) for _ in wanted.ids]

        def close(parts: list[tuple[np.ndarray, ...]]) -> None:
            ids, n, sizes, term, times = (np.concatenate(x) for x in zip(*parts))
            doc = np.repeat(np.arange(len(ids)), sizes)
            impact = weights[term] * (SCALE * times // (UNIT * times + LENGTH_FACTOR * known.moderation(n)[doc]))
            block = Block(len(ids), doc, term, impact)
            for heap, own, often in zip(heaps, wanted.terms, wanted.times):
                block.search(own, often, ids, heap)

        held: list[tuple[np.ndarray, ...]] = []
        rows = full = 0
        for b in batches:
            ends = np.concatenate([[0], np.cumsum(b.column(2).value_lengths().to_numpy())]).astype(np.int64)
            ids, n = longs(b.column(0).fill_null(NO_ID)), longs(b.column(1))
            term, times = (b.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
            at = 0
            while at < len(ids):
                # A block takes what it has room for, one document at least.
                end = min(at + size - rows, int(np.searchsorted(ends, ends[at] + most - full, side="right")) - 1, len(ids))
                end = max(end, at + (rows == 0))
                if end > at:
                    held.append((ids[at:end], n[at:end], np.diff(ends[at : end + 1]), term[ends[at] : ends[end]], times[ends[at] : ends[end]]))
                    rows, full = rows + end - at, full + int(ends[end] - ends[at])
                if end < len(ids) or rows >= size:
                    close(held)
                    held, rows, full = [], 0, 0
                at = end
        if held:
            close(held)
        for k, heap in enumerate(heaps):
            if len(heap.scores):
                docs = pa.array(heap.docs, mask=heap.docs == NO_ID)
                yield batch(["item", "doc_id", "score"], np.full(len(heap.scores), k, dtype=np.int64), docs, heap.scores)

    return found.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, benchmark: DataFrame, top: int = 10, most: int = MAX_TERMS, size: int = BLOCK, postings_a_block: int = MAX_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of highest score above 0 for each item."""
    spark, kind = docs.sparkSession, benchmark.schema["item_id"].dataType
    schema = f"item_id {kind.simpleString()}, rank int, doc_id long, score long"
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    out: list[DataFrame] = []
    for items in item_blocks(benchmark, most):
        known = spark.sparkContext.broadcast(items.known)
        found = checkpoint(postings(docs, known))
        wanted, corpus = spark.sparkContext.broadcast(items), spark.sparkContext.broadcast(statistics(found, len(items.known)))
        heaps = shards(found, wanted, corpus, top, size, postings_a_block)
        ranked = heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(items.ids)), f"item long, item_id {kind.simpleString()}")
        done = checkpoint(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        for x in (known, wanted, corpus):
            x.destroy()
        out.append(done)
    whole = out[0] if out else spark.createDataFrame([], schema)
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
n AS (SELECT doc_id, r, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_id, t, count(*) AS times FROM i GROUP BY ALL),
p AS (SELECT doc_id, r, n, t, count(*) AS tf FROM (SELECT doc_id, r, n, unnest(ts) AS t FROM n) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t),
e AS (
  SELECT doc_id, r, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))) AS impact FROM p JOIN w USING (t), s),
scored AS (SELECT item_id, doc_id, r, CAST(sum(impact * times) AS BIGINT) AS score FROM q JOIN e USING (t) GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored) WHERE rank <= 10
"""

"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

An item is contained in a document if the document has at least `share` of the item's different shingles. An
item's MinHash sketch is its shingles of smallest hashes. Items are partitioned by size (powers of two of their
number of shingles); a partition's sketches have floor((1 - share) * its largest size) + 1 entries. An item that
is contained misses at most floor((1 - share) * size) shingles, so at least one sketch entry is in the document:
the search loses nothing, however long the document is, and a document that has too few words for an item's
share isn't a candidate for it. Candidates are verified on the shingles themselves.

Documents are scanned where they lie, without a shuffle; items are broadcast in blocks of MAX_SHINGLES shingles. If
there are several, each block's finds are written before the next block is made, and its broadcast is freed: tasks and
driver hold one block at a time, whatever the benchmark's size; the documents are scanned once a block.

Defined results
* words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; shingles are `words` words.
* an item of fewer words is one shingle, its whole sequence, and is looked for as such a run of words.
* an item or document without words (null too) is contained in nothing and contains nothing.
* repeated items (the same item_id and text) are one; the same text under two item_ids is two; rows of documents
  that repeat each give their pairs; null ids come back as null.
* very long texts are searched whole; empty tables give empty results; other columns are not looked at and may have
  any names; rows of documents that repeat stay or go together.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, checkpoint, numbered, row_key, sized
from .wordvec import blocks, gram_hashes, runs_inside, word_hashes, word_places

#: Shingles of the items that one scan looks for: at most this many and one item more are broadcast at once.
MAX_SHINGLES = 200_000


def shingles(text: bytes, words: int) -> set[bytes]:
    found = text.lower().split()
    if not found:
        return set()
    n = min(words, len(found))
    return {b" ".join(found[i : i + n]) for i in range(len(found) - n + 1)}


def sketch_size(n: int, share: float) -> int:
    """For an item of n shingles: by the largest size of its partition."""
    largest = (1 << n.bit_length()) - 1
    return min(n, int((1 - share) * largest + 1e-9) + 1)


class Index:
    """The sketches of a block of items, and the items' shingles for verifying."""

    def __init__(self, items: list[tuple[int | None, bytes]], words: int, share: float):
        self.words, self.share = words, share
        self.ids = [i for i, _ in items]
        self.sets = [shingles(t, words) for _, t in items]
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: sketch hashes, sorted, and their items
        self.need = np.zeros(len(items), dtype=np.int64)
        entries: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text) in enumerate(items):
            for _, octets, offsets in blocks(pa.array([text], pa.binary())):
                starts, ends, _ = word_places(octets, offsets)
                if len(starts):
                    n = min(words, len(starts))
                    different = np.unique(gram_hashes(word_hashes(octets, starts, ends), n))
                    entries[n] += [(int(h), k) for h in different[: sketch_size(len(different), share)]]
            size = len(self.sets[k])
            self.need[k] = max(1, int(np.ceil(share * size - 1e-9)))
        for n, pairs in entries.items():
            pairs.sort()
            self.grams[n] = np.array([h for h, _ in pairs], dtype=np.uint64), np.array([k for _, k in pairs])

    def candidates(self, octets: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(text, items) for the texts of a block that meet a sketch."""
        starts, ends, first = word_places(octets, offsets)
        hashes = word_hashes(octets, starts, ends)
        n_words = np.diff(first)
        found: list[np.ndarray] = []
        for n, (sketch, owner) in self.grams.items():
            grams = gram_hashes(hashes, n)
            at = np.minimum(np.searchsorted(sketch, grams), len(sketch) - 1)
            hits = np.flatnonzero((sketch[at] == grams) & runs_inside(first, len(hashes), n))
            if not len(hits):
                continue
            text = np.searchsorted(first, hits, side="right") - 1
            low, high = at[hits], np.searchsorted(sketch, grams[hits], side="right")
            many = high - low
            entry = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs = np.stack([np.repeat(text, many), owner[entry]], 1)
            found.append(pairs[n_words[pairs[:, 0]] - n + 1 >= self.need[pairs[:, 1]]])
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            cuts = np.flatnonzero(np.append(True, pairs[1:, 0] != pairs[:-1, 0])) if len(pairs) else []
            for a, z in zip(cuts, [*cuts[1:], len(pairs)]):
                yield int(pairs[a, 0]), pairs[a:z, 1]

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) for each contained item."""
        column = column.cast(pa.large_binary())
        for at, octets, offsets in blocks(column):
            for text, items in self.candidates(octets, offsets):
                words = bytes(octets[offsets[text] : offsets[text + 1]]).split()
                sets: dict[int, set[bytes]] = {}
                for k in items:
                    n = len(next(iter(self.sets[k])).split())
                    if n not in sets:
                        sets[n] = {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
                    shared = len(self.sets[k] & sets[n])
                    if shared >= self.need[k]:
                        yield at + text, int(k), shared


def item_blocks(benchmark: DataFrame, words: int, share: float, most: int = MAX_SHINGLES) -> tuple[int, Callable[[int], Index]]:
    """How many blocks of about `most` shingles, by the number of words, and what makes the index of block k."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length(F.trim("text")) > 0).distinct()
    total = items.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    n = max(1, -(-int(total) // most))
    slot = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))

    def made(k: int) -> Index:
        rows = sorted(((i, t.encode()) for i, t in items.where(slot == k).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        return Index(rows, words, share)

    return n, made


FOUND = "doc_id long, k1 long, k2 long, item_id long, n_shared long, n_item long"


def finds(docs: DataFrame, benchmark: DataFrame, words: int, share: float, most: int) -> DataFrame:
    """FOUND: one row for each row of docs (doc_id, text) and item that it contains."""
    k1, k2 = row_key()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col("text").cast("string").alias("text"))
    names = [x.split()[0] for x in FOUND.split(", ")]
    context = docs.sparkSession.sparkContext

    def searched(index: Index) -> tuple[DataFrame, Broadcast]:
        sent = context.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for b in batches:
                hits = list(own.search(b.column(3)))
                at = pa.array([r for r, _, _ in hits], pa.int64())
                more = [own.ids[k] for _, k, _ in hits], [s for _, _, s in hits], [len(own.sets[k]) for _, k, _ in hits]
                yield batch(names, *[c.take(at) for c in b.columns[:3]], *[pa.array(x, pa.int64()) for x in more])

        return rows.mapInArrow(run, FOUND), sent

    n, made = item_blocks(benchmark, words, share, most)
    if n == 1:
        return searched(made(0))[0]
    parts = []
    for k in range(n):
        found, sent = searched(made(k))
        parts.append(checkpoint(found))
        sent.destroy()
    return reduce(DataFrame.unionByName, parts)


def contained(docs: DataFrame, benchmark: DataFrame, words: int = 5, share: float = 0.8, most: int = MAX_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): one row for each document and item that it contains."""
    return finds(docs, benchmark, words, share, most).select("doc_id", "item_id", "n_shared", "n_item")


def clean(docs: DataFrame, benchmark: DataFrame, words: int = 5, share: float = 0.8, most: int = MAX_SHINGLES) -> DataFrame:
    """The rows of docs that contain no item, all columns as they are."""
    rows, name = numbered(docs)
    found = checkpoint(finds(rows.select(F.col(name("doc_id")).alias("doc_id"), F.col(name("text")).alias("text")), benchmark, words, share, most).select("k1", "k2").distinct())
    k1, k2 = row_key(name("text"), name("doc_id"))
    return rows.withColumns({"k1": k1, "k2": k2}).join(sized(found), ["k1", "k2"], "left_anti").select(*rows.columns).toDF(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame, words: int = 5, share: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment."""
    return contained(docs, benchmark, words, share).withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))


#: The same in SQL for 5 words and a share of 0.8, shingle by shingle.
ORACLE = """
WITH cut AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS n, text FROM documents
  UNION ALL SELECT 'i', item_id, row_number() OVER () , text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
words AS (
  SELECT kind, id, n, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM cut),
items AS (
  SELECT n, id, least(5, len(w)) AS size, unnest(list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: list_aggregate(list_slice(w, i, i + least(5, len(w)) - 1), 'string_agg', ' ')))) AS g
  FROM words WHERE kind = 'i' AND len(w) > 0),
sizes AS (SELECT n, id, size, count(*) AS n_item FROM items GROUP BY ALL),
lengths AS (SELECT DISTINCT size FROM items),
found AS (
  SELECT DISTINCT words.n, words.id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: list_aggregate(list_slice(w, i, i + size - 1), 'string_agg', ' '))) AS g
  FROM words, lengths WHERE kind = 'd' AND len(w) >= size),
shared AS (
  SELECT f.n, f.id AS doc_id, i.n AS item, count(*) AS n_shared FROM found f JOIN items i ON f.g = i.g AND f.size = i.size GROUP BY ALL)
SELECT doc_id, s.id AS item_id, n_shared, n_item, round(n_shared / n_item, 6) AS containment
FROM shared JOIN sizes s ON s.n = item WHERE 5 * n_shared >= 4 * n_item
"""

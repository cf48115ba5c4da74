"""LM scoring: prediction by partial matching over bytes, pretrained on the corpus itself.

The model predicts each byte of a lower-cased text, and an end mark, from the ORDER bytes before it. The byte-context
trie holds how often each symbol followed each context of up to ORDER bytes in all training texts, without limits. At a
context of t counts and d different symbols, one of c > 0 counts has the probability (2c - 1) / 2t, and what is left,
d / 2t, is the escape (method D). An unseen symbol escapes to the context that is a byte shorter, where the symbols of
the longer context are excluded. After the empty context, the symbols never seen share what is left evenly. A context
that all symbols have followed needs no escape.

1. Each task counts the runs of ORDER + 1 symbols of its documents, in training and in all, and their words likewise;
   counts are summed by a shuffle. The trie's contexts of two bytes and less (65,793 at most) are sums that the driver
   gathers and sends to all tasks; all longer ones lie in shards by the last three bytes, 2**24 runs at most of one such
   end, so that a shard holds all contexts that its runs can escape to.
2. A shard computes the code length of each run that occurs anywhere: a table (run, log10 probability). Words get their
   smoothed unigram logarithm in the same table.
3. A second scan sums each document's code lengths. The most frequent entries, HEAD runs and HEAD words at most, are
   sent to all tasks; each document's other runs and words, none of which is frequent, meet the table in a join.

What is counted, shuffled and joined grows with the corpus; nothing is dropped, and documents are never grouped.

Defined results
* null or empty text: the end mark alone. Null doc_id: an empty text for the remainder, so held out.
* words are told apart by 64-bit hashes. Rows that repeat are documents of their own, in training too.
* without training documents, every symbol is as likely as any other and base_score is 0.
* very long texts are scored whole, in pieces; an empty table gives an empty result; other columns are not looked at
  and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, checkpoint, give_back, longs
from .wordvec import blocks, word_hashes, word_places

ORDER = 5
#: Symbols: 256 bytes and the end of a text. Before a text stands PAD, which UTF-8 has nowhere.
END, SYMBOLS, PAD = 256, 257, 0xFF
#: A run is its context's bytes, the last the highest, and its symbol in the lowest SYMBOL_BITS.
SYMBOL_BITS = 9
RUN_BITS = 8 * ORDER + SYMBOL_BITS
#: Contexts up to this order are sent to all tasks; shards are by the last LOW + 1 bytes.
LOW = 2
#: Entries of the table that are sent to all tasks, of each kind, at most.
HEAD = 1 << 20
#: Different entries that a task holds at most before it passes them on, symbols that it works on at once, and
#: documents, whose number must fit beside a run in 64 bits. A task's counts stay below 2**31, as a split's symbols do.
MAX_HELD, WINDOW, MAX_DOCS = 1_000_000, 1 << 18, 1 << 14
#: Kinds of entries.
RUN, WORD, ENDS = 0, 1, 2
#: Fixed value: what is added to each count of the unigram model.
SMOOTH = 0.1


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As wordvec.blocks, of MAX_DOCS texts at most."""
    for at in range(0, len(column), MAX_DOCS):
        for k, octets, offsets in blocks(column.slice(at, MAX_DOCS)):
            yield at + k, octets, offsets


def runs(octets: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, run) of every symbol, WINDOW at a time."""
    sizes = np.diff(offsets)
    n = len(sizes)
    starts = offsets[:-1] + np.arange(n) * (ORDER + 1) + ORDER  # of the texts, each after its padding
    padded = np.full(len(octets) + n * (ORDER + 1), PAD, dtype=np.int16)
    padded[np.arange(len(octets)) + np.repeat(starts - offsets[:-1], sizes)] = octets
    padded[starts + sizes] = END
    owner = np.repeat(np.arange(n), sizes + ORDER + 1)
    is_symbol = np.ones(len(padded), dtype=bool)
    is_symbol[(starts[:, None] - np.arange(1, ORDER + 1)[None, :]).ravel()] = False
    for at in range(ORDER, len(padded), WINDOW):
        here = np.arange(at, min(at + WINDOW, len(padded)))
        here = here[is_symbol[here]]
        run = padded[here].astype(np.int64)
        for k in range(1, ORDER + 1):
            run |= padded[here - k].astype(np.int64) << (SYMBOL_BITS + 8 * (ORDER - k))
        yield owner[here], run


def words(octets: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, hash) of every word, about WINDOW bytes at a time."""
    starts, ends, first = word_places(octets, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + WINDOW, side="right")))
        low = starts[at]
        yield owner[at:to], word_hashes(octets[low : ends[to - 1]], starts[at:to] - low, ends[at:to] - low).view(np.int64)
        at = to


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys, sorted, and their sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[cuts], *(np.add.reduceat(c[order], cuts) if len(cuts) else c for c in counts)


def frequencies(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[cuts], np.diff(np.append(cuts, len(keys)))


class Tally:
    """Counts of a task by key: those in training in the high half of a long, those in all in the low half."""

    def __init__(self, kind: int):
        self.kind, self.held, self.size = kind, [], 0

    def add(self, keys: np.ndarray, learn: np.ndarray) -> Iterator[pa.RecordBatch]:
        for some, factor in ((keys[learn], (1 << 32) + 1), (keys[~learn], 1)):
            if len(some):
                found, n = frequencies(some)
                self.held.append((found, factor * n))
                self.size += len(found)
        if self.size > MAX_HELD:
            self.held = [summed(*(np.concatenate(x) for x in zip(*self.held)))]
            self.size = len(self.held[0][0])
            if self.size > MAX_HELD * 3 // 4:
                yield from self.out()
            give_back()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            keys, both = summed(*(np.concatenate(x) for x in zip(*self.held)))
            for at in range(0, len(keys), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield batch(["kind", "key", "train", "every"], np.full(len(keys[part]), self.kind, dtype=np.int32), keys[part], both[part] >> 32, both[part] & 0xFFFFFFFF)
        self.held, self.size = [], 0


def counted(rows: DataFrame) -> DataFrame:
    """(kind, key, train, every): how often each run and word occurs. rows: (learn, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {RUN: Tally(RUN), WORD: Tally(WORD)}
        docs = np.zeros(2, dtype=np.int64)
        for b in batches:
            learn = b.column(0).to_numpy(zero_copy_only=False).astype(bool)
            docs += (learn.sum(), len(learn))
            for at, octets, offsets in pieces(b.column(1)):
                for kind, made in ((RUN, runs), (WORD, words)):
                    for owner, keys in made(octets, offsets):
                        yield from tallies[kind].add(keys, learn[at + owner])
        for tally in tallies.values():
            yield from tally.out()
        if docs[1]:
            yield batch(["kind", "key", "train", "every"], np.array([ENDS], dtype=np.int32), np.zeros(1, dtype=np.int64), docs[:1], docs[1:])
        give_back()

    found = rows.mapInArrow(run, "kind int, key long, train long, every long")
    return found.groupBy("kind", "key").agg(F.sum("train").alias("train"), F.sum("every").alias("every"))


@dataclass(frozen=True)
class Order:
    """The contexts of one length: counts by run, and by context counts, different symbols and what the next shorter
    context counts of those symbols."""

    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    different: np.ndarray
    shorter: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, counts: np.ndarray, below: Order | None, k: int) -> Order:
        """keys: runs of length k + 1 that occur in training, sorted."""
        context = keys >> SYMBOL_BITS
        cuts = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
        add = lambda x: np.add.reduceat(x, cuts) if len(cuts) else np.zeros(0, dtype=np.int64)
        less = below.count(shortened(keys, k, k - 1)) if below is not None else np.zeros_like(counts)
        return Order(keys, counts, context[cuts], add(counts), add(np.ones_like(counts)), add(less))

    def count(self, keys: np.ndarray) -> np.ndarray:
        return looked_up(self.keys, keys, self.counts)[0]

    def at(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """total, different and shorter of each; zeros for a context that never occurred."""
        return looked_up(self.contexts, contexts, self.total, self.different, self.shorter)


def looked_up(known: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The values of keys in sorted known, 0 where there is none."""
    if not len(known):
        return tuple(np.zeros(len(keys), dtype=v.dtype) for v in values)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    there = known[at] == keys
    return tuple(np.where(there, v[at], 0) for v in values)


def shortened(keys: np.ndarray, k: int, to: int) -> np.ndarray:
    """Runs with contexts of k bytes as runs with contexts of `to` bytes."""
    context = keys >> SYMBOL_BITS >> (8 * (k - to))
    return (context << SYMBOL_BITS) | (keys & ((1 << SYMBOL_BITS) - 1))


def orders(keys: np.ndarray, counts: np.ndarray, k: int, down_to: int, below: Order | None) -> dict[int, Order]:
    """The orders k ... down_to from the counts of runs with contexts of k bytes."""
    made: dict[int, Order] = {}
    for j in range(down_to, k + 1):
        below = made[j] = Order.of(*summed(shortened(keys, k, j), counts), below, j)
    return made


def code_lengths(keys: np.ndarray, train: np.ndarray, low: dict[int, Order]) -> np.ndarray:
    """log10 of the probability of each run's symbol after its context. keys and train: all runs of some ends."""
    some = train > 0
    every = low | orders(keys[some], train[some], ORDER, LOW + 1, low[LOW])
    out = np.zeros(len(keys))
    left = np.ones(len(keys), dtype=bool)
    gone_n, gone_sum = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    for k in range(ORDER, -1, -1):
        own = shortened(keys, ORDER, k)
        total, different, shorter = every[k].at(own >> SYMBOL_BITS)
        count = every[k].count(own)
        full = different == SYMBOLS
        escape = np.where(full, 0, different - gone_n)
        whole = 2 * np.maximum(total - gone_sum, 1)
        found = left & (count > 0)
        out[found] += np.log10((2 * count + full - 1)[found] / whole[found])
        left &= ~found
        some = left & (escape > 0)
        out[some] += np.log10(escape[some] / whole[some])
        gone_n, gone_sum = different, shorter
    out[left] -= np.log10(SYMBOLS - gone_n[left])
    return out


def low_orders(counts: DataFrame) -> dict[int, Order]:
    """The orders 0 ... LOW; what comes to the driver is 65,536 contexts of 257 symbols at most."""
    short = ORDER - LOW
    context = F.shiftright("key", SYMBOL_BITS + 8 * short)
    key = F.shiftleft(context, SYMBOL_BITS).bitwiseOR(F.col("key").bitwiseAND((1 << SYMBOL_BITS) - 1))
    sums = counts.where((F.col("kind") == RUN) & (F.col("train") > 0)).groupBy(key.alias("key")).agg(F.sum("train").alias("n")).toArrow()
    return orders(sums["key"].to_numpy(), sums["n"].to_numpy(), LOW, 0, None)


def run_lengths(counts: DataFrame, low: Broadcast) -> DataFrame:
    """(kind, key, every, train, w): code lengths by shards of the trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            keys, every, train = (np.concatenate(x) for x in zip(*held))
            return batch(["kind", "key", "every", "train", "w"], np.full(len(keys), RUN, dtype=np.int32), keys, every, train, code_lengths(keys, train, low.value))

        for b in batches:
            if not b.num_rows:
                continue
            rows = tuple(longs(c) for c in b.columns)
            end = rows[0] >> (SYMBOL_BITS + 8 * (ORDER - LOW - 1))
            last = int(np.searchsorted(end, end[-1]))  # where the last end, which may go on, begins
            if size >= MAX_HELD // 4 and (last or (held[-1][0][-1] >> (SYMBOL_BITS + 8 * (ORDER - LOW - 1))) != end[0]):
                if last:
                    held.append(tuple(x[:last] for x in rows))
                yield out()
                held, size = [], 0
                rows = tuple(x[last:] for x in rows)
            held.append(rows)
            size += len(rows[0])
        if held:
            yield out()
        give_back()

    shard = F.shiftright("key", SYMBOL_BITS + 8 * (ORDER - LOW - 1)).alias("shard")
    rows = counts.where(F.col("kind") == RUN).select("key", "every", "train", shard).repartition("shard").sortWithinPartitions("key").drop("shard")
    return rows.mapInArrow(run, "kind int, key long, every long, train long, w double")


def bucket() -> Column:
    """A few hundred classes of `every`."""
    return F.floor(F.log2("every") * 8)


def head_of(entries: DataFrame, kind: int, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The least bucket such that it and those above have `most` entries at most; their keys, sorted, weights and
    whether they occur in training."""
    sizes = sorted(entries.where(F.col("kind") == kind).groupBy(bucket().alias("b")).agg(F.count("*").alias("n")).collect(), reverse=True)
    least, have = 1 << 30, 0
    for b, n in sizes:
        if have + n > most:
            break
        least, have = int(b), have + n
    rows = entries.where((F.col("kind") == kind) & (bucket() >= least)).select("key", "w", (F.col("train") > 0).alias("known")).toArrow()
    keys = rows["key"].to_numpy()
    order = np.argsort(keys)
    return least, keys[order], rows["w"].to_numpy()[order], rows["known"].to_numpy()[order].astype(np.int64)


SCORED = "id long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, kind int, key long, n long"


def scanned(rows: DataFrame, head: Broadcast, end_weight: float, end_known: int) -> DataFrame:
    """A row (SCORED) for each document with its sums over the head, and rows (id, kind, key, n) for all else."""
    names = [x.split()[0] for x in SCORED.split(", ")]

    def rest(ids: np.ndarray, kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        size = len(keys)
        none = [pa.nulls(size, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
        return batch(names, ids, *none, np.full(size, kind, dtype=np.int32), keys, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (run_keys, run_w, _), (word_keys, word_w, word_known) = head.value
        low_mask = np.uint64((1 << RUN_BITS) - 1)

        def split(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(known):
                return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            return at, known[at] == keys

        for b in batches:
            ids = longs(b.column(0))
            n_rows = len(ids)
            tokens, known = np.ones(n_rows, dtype=np.int64), np.full(n_rows, end_known, dtype=np.int64)
            base, score = np.full(n_rows, end_weight), np.zeros(n_rows)
            for at, octets, offsets in pieces(b.column(3)):
                n_docs = len(offsets) - 1
                here = slice(at, at + n_docs)
                sums = lambda owner, w: np.bincount(owner, weights=w, minlength=n_docs)  # noqa: B023, E731
                for owner, keys in runs(octets, offsets):
                    both, n = frequencies((owner.astype(np.uint64) << np.uint64(RUN_BITS)) | keys.astype(np.uint64))
                    owner, keys = (both >> np.uint64(RUN_BITS)).astype(np.int64), (both & low_mask).astype(np.int64)
                    place, there = split(run_keys, keys)
                    score[here] += sums(owner[there], run_w[place[there]] * n[there]) if there.any() else 0
                    if not there.all():
                        yield rest(ids[at + owner[~there]], RUN, keys[~there], n[~there])
                for owner, keys in words(octets, offsets):
                    place, there = split(word_keys, keys)
                    tokens[here] += np.bincount(owner, minlength=n_docs)
                    if there.any():
                        base[here] += sums(owner[there], word_w[place[there]])
                        known[here] += sums(owner[there], word_known[place[there]]).astype(np.int64)
                    if not there.all():
                        yield rest(ids[at + owner[~there]], WORD, keys[~there], np.ones(int((~there).sum()), dtype=np.int64))
            nothing = [pa.nulls(n_rows, t) for t in (pa.int32(), pa.int64(), pa.int64())]
            yield batch(names, ids, b.column(1), b.column(2), tokens, known, base, score, *nothing)
        give_back()

    return rows.mapInArrow(run, SCORED)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0


def scores(docs: DataFrame, apart: Column | None = None, most: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document.

    apart: which rows of docs (doc_id, text) are kept out of training; the contract's rule if left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", held_out() if apart is None else apart)
    counts = checkpoint(counted(rows.select(~F.col("held_out"), "text")))
    of = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("train").alias("n"), F.count_if(F.col("train") > 0).alias("v")).collect()}
    n_ends = of[ENDS]["n"] if ENDS in of else 0
    n_train = (of[WORD]["n"] if WORD in of else 0) + n_ends
    different = (of[WORD]["v"] if WORD in of else 0) + (n_ends > 0)
    scale = n_train + SMOOTH * (different + 1)
    low = spark.sparkContext.broadcast(low_orders(counts))
    w = F.log10((F.col("train") + SMOOTH) / F.lit(scale))
    by_word = counts.where(F.col("kind") == WORD).select("kind", "key", "every", "train", w.alias("w"))
    entries = checkpoint(run_lengths(counts, low).unionByName(by_word))
    least, heads = {}, []
    for kind in (RUN, WORD):
        least[kind], *arrays = head_of(entries, kind, most)
        heads.append(tuple(arrays))
    head = spark.sparkContext.broadcast(tuple(heads))
    numbered = rows.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    found = checkpoint(scanned(numbered, head, float(np.log10((n_ends + SMOOTH) / scale)), int(n_ends > 0)))
    rare = F.when(F.col("kind") == RUN, least[RUN]).otherwise(least[WORD])
    dim = entries.where(bucket() < rare).select("kind", "key", "w", "train")
    part = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0))
    rest = (
        found.where(F.col("kind").isNotNull()).select("id", "kind", "key", "n").join(dim, ["kind", "key"]).groupBy("id")
        .agg(part(RUN, F.col("n") * F.col("w")).alias("more_score"), part(WORD, F.col("n") * F.col("w")).alias("more_base"), part(WORD, F.when(F.col("train") > 0, F.col("n"))).alias("more_known"))
    )
    done = found.where(F.col("kind").isNull()).join(rest, "id", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0)))
    return done.select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "more_known").cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"), plus("score", "more_score").alias("score"),
    )

"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted target to raw corpus.

Words and word pairs are hashed into buckets, as many as the corpus is long: a power of two with CHARS_A_BUCKET
characters a bucket or fewer, LEAST_BUCKETS at least, so that a bucket holds about as many different n-grams at every
size. Two smoothed multinomials over the buckets are counted: the raw corpus over every document, the trusted target
over every document labelled good. A document's score is the mean over its n-grams of log(target / raw), so length
doesn't count; it is kept at THRESHOLD or more. Everything is DataFrame expressions: a document's n-grams are arrays
inside its row, only the bucket counts are shuffled (combined before). Up to MAX_DENSE buckets the weights return as
one scalar subquery; beyond, documents' buckets are packed by parts of the buckets and meet a part's weights in a task. The ids of trusted documents are
broadcast up to MAX_TRUSTED, and joined by shuffle beyond.

Defined results
* null text: no words, no lines. No words: base_failed, not kept.
* n-grams and 5-word windows are told apart by 64-bit hashes of their words.
* rows that repeat, and null doc_ids, are judged as any row; a doc_id with several labels is trusted if one of
  them is good and none is bad; labels of unknown documents don't count.
* without any trusted document, or in an empty corpus, the score is 0 for every document.
* other columns of the inputs are not looked at, may have any names, and come through keep() as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, batch, checkpoint, give_back, longs, numbered, row_key, skew_join

LEAST_BUCKETS, CHARS_A_BUCKET = 1 << 20, 512
#: Buckets whose weights are sent to all tasks at most (4 bytes each), and how many are gathered in one array at first.
MAX_DENSE, CHUNK = 1 << 23, 1 << 16
#: Beyond, tasks hold the weights of 2 ** SPAN buckets at once (16 to 24 bits), a part; a part is dealt to SALTS cells.
SPAN, SALTS = 22, 16
#: n-grams of a slice of documents that are packed together, if it isn't one document.
PACKED = 1 << 20
CELLS = "part long, salt int, is_row boolean, slice long, w array<struct<b:int,w:float>>, doc binary, low binary, high binary, times binary"
CELL_NAMES = [x.split(" ")[0] for x in CELLS.split(", ")]
#: Ids of trusted documents that are sent to all tasks at most.
MAX_TRUSTED = 1_000_000
#: Pseudo-count of a bucket in the raw corpus; it draws buckets that are seldom seen to a ratio of 1.
SMOOTH = 16.0
#: On the synthetic tables no document labelled good lies below it, at 1,000 documents or at 51,000, and 95 % of
#: those labelled bad do that pass the base rules.
THRESHOLD = -0.2
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The characters that count as symbols.
NOT_SYMBOLS = r"[^#*$%&|<>]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often and deep in lambdas body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def beside(a: Column, b: Column, by: int) -> Column:
    """Hashes of each entry of a together with the entry of b that lies `by` places on."""
    n = F.greatest(F.least(F.size(a), F.size(b) - by), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(by + 1), n), lambda x, y: F.xxhash64(x, y))


def all_different(hashes: Column) -> Column:
    return F.size(F.array_distinct(hashes)) == F.size(hashes)


def covered(hashes: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows whose hash comes twice or more."""

    def positions(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        repeated = let(pairs, lambda s: F.filter(s, lambda x, k: ((k > 0) & same(s, k - 1, x)) | same(s, k + 1, x)))
        return F.sort_array(F.transform(repeated, lambda x: x["i"]))

    step = lambda p, x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))
    total = lambda p: F.aggregate(F.transform(p, lambda x, k: step(p, x, k)), F.lit(0), lambda a, x: a + x)
    return let(hashes, lambda h: F.when(all_different(h), F.lit(0)).otherwise(let(positions(h), total)))


def repeated_words(hashes: Column, pairs: Column) -> Column:
    """How many words lie in runs of WINDOW words that come twice or more; pairs: beside(hashes, hashes, 1).

    A run's hash is made of two pairs of neighbours and a word. Where all runs of two pairs differ, so do the longer
    ones, which then aren't made.
    """
    return let(beside(pairs, pairs, 2), lambda four: F.when(all_different(four), F.lit(0)).otherwise(covered(beside(four, hashes, WINDOW - 1))))


def judged(text: Column, mean: Callable[[Column], Column]) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed, score) of a text, each computed once.

    mean gives the score of an array of hashes of words and word pairs.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_hashes(h: Column) -> Column:
        return let(beside(h, h, 1), lambda p: F.struct(repeated_words(h, p).cast("long").alias("r"), let(F.concat(h, p), mean).alias("score")))

    def of_words(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n"), F.length(F.array_join(ws, "")).cast("long").alias("chars"), let(word_hashes(ws), of_hashes).alias("h"))

    def whole(x: Column) -> Column:
        return F.struct(
            x["n"].alias("n_words"),
            x["chars"].alias("word_chars"),
            F.length(F.regexp_replace(text, NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
            let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("n_dup_lines"),
            x["h"]["r"].alias("n_repeat_words"),
            ((x["n"] < 10) | (100 * x["h"]["r"] > 20 * x["n"])).alias("failed"),
            x["h"]["score"].alias("score"),
        )

    return let(let(words(text), of_words), whole)


def bucket(h: Column, n_buckets: int) -> Column:
    """An int as long as that holds every bucket, a long beyond."""
    whole = n_buckets & (n_buckets - 1) == 0  # a power of two: the lowest bits, whatever the sign
    found = h.bitwiseAND(F.lit(n_buckets - 1).cast("long")) if whole else F.pmod(h, F.lit(n_buckets).cast("long"))
    return found.cast("int") if n_buckets <= 1 << 31 else found


def buckets(text: Column, n_buckets: int) -> Column:
    """The buckets of a text's words and word pairs."""
    both = let(word_hashes(words(text)), lambda h: F.concat(h, beside(h, h, 1)))
    return F.transform(both, lambda x: bucket(x, n_buckets))


def gram_rows(docs: DataFrame, n_buckets: int, *others: str) -> DataFrame:
    """A row a word and word pair: its bucket b, and the columns others; the buckets are those of buckets(text).

    Words become rows before they are hashed: Spark compiles expressions over rows, and interprets lambdas over arrays.
    """
    lists = docs.select(*others, words(F.col("text")).alias("ws"))
    each = lists.select(*others, "ws", F.posexplode_outer("ws").alias("i", "word")).where("word IS NOT NULL")  # outer: else texts are split twice, in a filter that Spark adds
    own, after = F.xxhash64("word"), F.xxhash64(F.get("ws", F.col("i") + 1))
    both = F.when(F.col("i") + 1 < F.size("ws"), F.array(own, F.xxhash64(own, after))).otherwise(F.array(own))
    return each.select(*others, F.explode(both).alias("h")).select(*others, bucket(F.col("h"), n_buckets).alias("b"))


def length_of(docs: DataFrame) -> int:
    """Characters of all texts; one pass over their lengths."""
    return int(docs.agg(F.sum(F.length("text"))).first()[0] or 0)


def buckets_for(chars: int) -> int:
    """How many buckets a corpus of so many characters gets."""
    return max(LEAST_BUCKETS, 1 << max(0, -(-chars // CHARS_A_BUCKET) - 1).bit_length())


def trusted(labels: DataFrame) -> DataFrame:
    """(id): doc_ids with good labels only."""
    by_id = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("q"))
    return by_id.where(F.col("q") == 1).select("id")


def counted(docs: DataFrame, labels: DataFrame, n_buckets: int, chars: int, most: int = MAX_TRUSTED) -> DataFrame:
    """(b, raw, target): how often each bucket occurs in all documents, and in the trusted ones. docs: doc_id, text."""
    good = checkpoint(trusted(labels)).withColumn("t", F.lit(1).cast("long"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    found = rows.join(F.broadcast(good), "id", "left") if good.count() <= most else skew_join(rows, good, "id", "left")
    each = gram_rows(found.select(F.coalesce("t", F.lit(0)).alias("t"), "text"), n_buckets, "t")
    if chars < 1 << 31:  # no count can be more, so one long holds both: a third less is shuffled
        sums = each.groupBy("b").agg(F.sum(F.lit(1 << 32) + F.col("t")).alias("both"))
        return checkpoint(sums.select("b", F.shiftright("both", 32).alias("raw"), F.col("both").bitwiseAND(F.lit((1 << 32) - 1)).alias("target")))
    return checkpoint(each.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target")))


def weights(counts: DataFrame) -> DataFrame | None:
    """(b, w): log(target / raw) by bucket; None without any target."""
    raw, target = counts.agg(F.sum("raw"), F.sum("target")).first()
    if not target:
        return None
    # Both multinomials get pseudo-counts in proportion to their totals, so the totals cancel out.
    ratio = F.log((F.col("target") / (target / raw) + F.lit(SMOOTH)) / (F.col("raw") + F.lit(SMOOTH)))
    return counts.select("b", ratio.cast("float").alias("w"))


def dense(found: DataFrame, n_buckets: int) -> DataFrame:
    """One row with the weights as an array, put together from arrays of CHUNK; buckets that do not occur weigh 0."""
    every = found.sparkSession.range(n_buckets).join(found, F.col("id") == F.col("b"), "left").select(F.col("id"), F.coalesce("w", F.lit(0.0).cast("float")).alias("w"))
    parts = every.groupBy(F.floor(F.col("id") / CHUNK).alias("part")).agg(F.sort_array(F.collect_list(F.struct("id", "w")))["w"].alias("w"))
    return parts.agg(F.flatten(F.sort_array(F.collect_list(F.struct("part", "w")))["w"]).alias("w"))


def rows_judged(rows: DataFrame, labels: DataFrame, text: str, doc_id: str, n_buckets: int | None = None, most: int = MAX_DENSE) -> DataFrame:
    """rows with a column `judged` (as judged gives it). rows: columns c0, c1, ...; text and doc_id: two of them."""
    docs = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    chars = length_of(docs)
    n_buckets = buckets_for(chars) if n_buckets is None else n_buckets
    found = weights(counted(docs, labels, n_buckets, chars))
    whole = F.col(text).cast("string")
    if found is None:
        return rows.withColumn("judged", judged(whole, lambda h: F.lit(0.0)))
    if n_buckets <= most:

        def mean(h: Column) -> Column:
            return F.aggregate(h, F.lit(0.0), lambda t, x: t + F.get(F.col("w"), bucket(x, n_buckets))) / F.greatest(F.size(h), F.lit(1))

        return rows.withColumn("w", dense(found, n_buckets).scalar()).withColumn("judged", judged(whole, mean)).drop("w")
    return by_join(rows, found, docs, n_buckets, whole, row_key(text, doc_id))


def packed(each: DataFrame, salts: int) -> DataFrame:
    """n-grams by the part of the buckets they are in; each: k1, k2, b (an array). CELLS has the columns.

    The documents of a slice, PACKED n-grams or one document, give a row a part: which document of the slice (`doc`,
    uint32), and each of its buckets once, as 16 low bits (`low`), the bits above (`high`, uint8) and how often (`times`,
    uint8; a number beyond 255 takes several entries). A row of part -1 has the slice's keys and their numbers of n-grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, where = 0, TaskContext.get().partitionId() << 32
        for found in batches:
            k1, k2, lists = longs(found.column(0)), longs(found.column(1)), found.column(2)
            ends = np.append(0, np.cumsum(longs(lists.value_lengths())))
            flat, start = longs(lists.flatten()), 0
            while start < len(k1):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + PACKED, "right")) - 1)
                yield sliced(where + done, k1[start:stop], k2[start:stop], np.diff(ends[start : stop + 1]), flat[ends[start] : ends[stop]])
                start, done = stop, done + 1
        give_back()

    def sliced(at: int, k1: np.ndarray, k2: np.ndarray, sizes: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        doc = np.repeat(np.arange(len(k1)), sizes)
        order = np.lexsort((b, doc, b >> SPAN))
        b, doc = b[order], doc[order]
        first = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (doc[1:] != doc[:-1])))[: len(b)]
        times, b, doc = np.diff(np.append(first, len(order))), b[first], doc[first]
        again = -(-times // 255)  # a number beyond a byte is dealt over several entries
        b, doc, times = np.repeat(b, again), np.repeat(doc, again), np.repeat(times, again)
        last = np.cumsum(again) - 1
        full = np.full(len(b), 255)
        full[last] = (times[last] - 1) % 255 + 1
        part, offset = b >> SPAN, b & ((1 << SPAN) - 1)
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))[: len(b)]
        runs = list(zip(cut, np.append(cut, len(b))[1:], strict=True))
        spread = lambda x, kind: [x[i:j].astype(kind).tobytes() for i, j in runs]
        n, salt = len(runs) + 1, (at * 0x9E3779B1 >> 16) % salts
        keys = [np.stack([k1, k2, sizes]).astype("<i8").tobytes()]
        parts = pa.array([-1, *part[cut]], pa.int64())
        return batch(CELL_NAMES, parts, pa.array([salt] * n, pa.int32()), pa.array([True] * n), pa.array([at] * n, pa.int64()), pa.nulls(n, pa.list_(pa.struct([("b", pa.int32()), ("w", pa.float32())]))), pa.array(keys + spread(doc, "<u4"), pa.binary()), *[pa.array([None, *spread(*x)], pa.binary()) for x in ((offset & 0xFFFF, "<u2"), (offset >> 16, "u1"), (full, "u1"))])

    return each.select("k1", "k2", "b").mapInArrow(run, CELLS)


def summed(cells: DataFrame) -> DataFrame:
    """(slice, doc, sums) of packed rows and the weights of their parts; a slice's keys come through as `keys`.

    A task holds the weights of one part at a time, which come before the part's rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, w = None, np.zeros(1 << SPAN, np.float32)
        for found in batches:
            out = []
            for part, salt, is_row, at, k, own in zip(*[found.column(i).to_pylist() for i in range(4)], range(found.num_rows), found.column(4), strict=True):
                if part < 0:
                    out.append((at, found.column(5)[k].as_py(), None, None))
                    continue
                if (part, salt) != held:
                    held = part, salt
                    w[:] = 0
                if not is_row:
                    w[own.values.field("b").to_numpy()] = own.values.field("w").to_numpy()
                    continue
                doc, low, high, times = (np.frombuffer(found.column(5 + i)[k].as_buffer(), kind) for i, kind in enumerate(("<u4", "<u2", "u1", "u1")))
                each = w[low.astype(np.int32) | (high.astype(np.int32) << 16)].astype(np.float64) * times
                cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                out.append((at, None, doc[cut].tobytes(), np.add.reduceat(each, cut).astype("<f8").tobytes()))
            yield batch(["slice", "keys", "doc", "sums"], *[pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))])
        give_back()

    ordered = cells.repartition("part", "salt").sortWithinPartitions("part", "salt", "is_row")
    return ordered.mapInArrow(run, "slice long, keys binary, doc binary, sums binary")


def unpacked(sums: pa.Table) -> pa.Table:
    """(k1, k2, score) of a slice's rows."""
    keys = next(np.frombuffer(x, "<i8").reshape(3, -1) for x in sums.column("keys").to_pylist() if x is not None)
    total = np.zeros(keys.shape[1])
    for doc, own in sorted((d, s) for d, s in zip(sums.column("doc").to_pylist(), sums.column("sums").to_pylist(), strict=True) if d is not None):
        total[np.frombuffer(doc, "<u4")] += np.frombuffer(own, "<f8")
    return pa.table({"k1": keys[0], "k2": keys[1], "score": total / np.maximum(keys[2], 1)})


def by_join(rows: DataFrame, found: DataFrame, docs: DataFrame, n_buckets: int, whole: Column, key: tuple[Column, Column]) -> DataFrame:
    """rows_judged where the weights are too many to send: documents' n-grams meet them by parts of 2 ** SPAN buckets.

    A part has SALTS cells, one a task, and each cell its own copy of the part's weights. As buckets are in proportion
    to characters, so are a cell's n-grams and the copies; what is shuffled is about three bytes for each different
    n-gram of a document.
    """
    k1, k2 = row_key()
    each = docs.where(F.col("text").isNotNull()).select(k1.alias("k1"), k2.alias("k2"), buckets(F.col("text"), n_buckets).alias("b"))
    pair = F.struct((F.col("b") % CHUNK + (F.shiftright("b", 16) % (1 << SPAN - 16)) * CHUNK).cast("int").alias("b"), "w")
    chunks = found.groupBy(F.shiftright("b", 16).cast("long").alias("slice")).agg(F.collect_list(pair).alias("w"))
    copies = chunks.select(F.shiftright("slice", SPAN - 16).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(False).alias("is_row"), "slice", "w", *[F.lit(None).cast("binary").alias(c) for c in CELL_NAMES[5:]])
    sums = summed(copies.unionByName(packed(each, SALTS)))
    scores = checkpoint(sums.groupBy("slice").applyInArrow(unpacked, "k1 long, k2 long, score double").groupBy("k1", "k2").agg(F.max("score").alias("score")))
    own = rows.withColumns({"k1": key[0], "k2": key[1]}).join(scores, ["k1", "k2"], "left")
    return own.withColumn("judged", judged(whole, lambda h: F.coalesce("score", F.lit(0.0)))).select(*rows.columns, "judged")


def kept(threshold: float) -> Column:
    """Names `judged` once: a filter takes the place of its columns' expressions, and would judge texts once a mention."""
    return let(F.col("judged"), lambda j: ~j["failed"] & (j["score"] >= threshold))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, n_buckets: int | None = None) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are."""
    rows, name = numbered(docs)
    done = rows_judged(rows, labels.select("doc_id", "quality"), name("text"), name("doc_id"), n_buckets)
    return done.where(kept(threshold)).select(*rows.columns).toDF(*docs.columns)


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, n_buckets: int | None = None, most: int = MAX_DENSE) -> DataFrame:
    """One row per document: the base counts, base_failed, kept, score."""
    rows = docs.select(F.col("doc_id").alias("c0"), F.col("text").alias("c1"))
    done = rows_judged(rows, labels.select("doc_id", "quality"), "c1", "c0", n_buckets, most)
    out = [F.col(f"judged.{c}") for c in COUNTS]
    return done.select(F.col("c0").alias("doc_id"), *out, F.col("judged.failed").alias("base_failed"), kept(threshold).alias("kept"), F.round("judged.score", 6).alias("score"))

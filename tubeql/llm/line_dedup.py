"""Line dedup: range-partitioned line hashes, secondary sort, one streaming pass, keep bitmaps.

Only 128-bit line hashes are shuffled. They are range-partitioned on (hash, document), so a line that a third
of all documents share is spread over many partitions, and sorted by hash, document and position inside each.
One pass streams every partition and settles each hash that begins and ends in it; the hashes at a partition's
edges (two a partition at most) are settled by a sum over the edges. What comes back is a compressed bitmap of
the lines to keep for each document that loses any; the text meets it in one join on the document key.

Defined results
* null or empty text: one empty line, which stays.
* a key shorter than min_chars code points (so an empty one): the line stays.
* rows that agree in doc_id and text count as one document and get the same lines; a null doc_id is a value.
* text that repeats a line inside one document counts once for that key and loses each of them.
* an empty table gives an empty result; other columns of the input are not looked at and may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, as_bytes, batch, checkpoint, longs, numbered, row_key

DECIDED, OPEN, EDGE = 0, 1, 2
LINE = ["h1", "h2", "k1", "k2", "pos"]


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased (bytes.lower touches ASCII only)."""
    return line.strip(SPACE).lower()


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """One row (h1, h2, k1, k2, pos) for each line whose key is long enough."""
    k1, k2 = row_key()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, digests, where = [], [], []
            for i, text in enumerate(as_bytes(b.column(2))):
                for pos, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and (min_chars < 2 or len(key.decode()) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        owner.append(i)
                        where.append(pos)
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            at = np.array(owner, dtype=np.int64)
            yield batch(LINE, h[:, 0].copy(), h[:, 1].copy(), longs(b.column(0))[at], longs(b.column(1))[at], np.array(where, dtype=np.int32))

    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(explode, "h1 long, h2 long, k1 long, k2 long, pos int")


def _stream(min_docs: int, keep_first: bool):
    """The pass over one sorted partition; rows (state, n, h1, h2, k1, k2, pos).

    DECIDED: this line goes. OPEN: it goes if its hash, seen at a partition's edge, has min_docs documents in all.
    EDGE: n documents of a hash at an edge, with the first of its places here.
    """
    names = ["state", "n", *LINE]

    def out(state: int, n: int, rows: list[np.ndarray]) -> pa.RecordBatch:
        size = len(rows[0])
        return batch(names, np.full(size, state, dtype=np.int32), np.full(size, n, dtype=np.int64), *rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None  # the last run so far, while it has too few documents
        settled: tuple[int, int] | None = None  # key of the last run, once it has enough
        first: tuple[int, int] | None = None  # key of the partition's first run
        edge: list[np.ndarray] | None = None  # of the last run: its first row

        for b in batches:
            if not b.num_rows:
                continue
            rows = [longs(b.column(i)) for i in range(4)] + [b.column(4).to_numpy(zero_copy_only=False).astype(np.int32)]
            if carry is not None:
                rows = [np.concatenate(x) for x in zip(carry, rows)]
                carry = None
            h1, h2, k1, k2, _ = rows
            fresh = np.ones(len(h1), dtype=bool)
            fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            document = fresh.copy()
            document[1:] |= (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            starts = np.flatnonzero(fresh)
            run = np.cumsum(fresh) - 1
            n_docs = np.bincount(run, weights=document).astype(np.int64)
            goes = n_docs >= min_docs
            begins = np.ones(len(starts), dtype=bool)  # the run's first row is in rows
            key = (int(h1[0]), int(h2[0]))
            if settled == key:
                goes[0], begins[0] = True, False
            if first is None:
                first = key
            drop = goes[run]
            at_edge = np.zeros(len(starts), dtype=bool)
            at_edge[0] = first == key
            last = len(starts) - 1
            if keep_first:
                drop[starts[begins]] = False
            if drop.any():
                yield out(DECIDED, 0, [x[drop] for x in rows])
            if at_edge[0] and begins[0] and (goes[0] or last > 0):
                a, z = starts[0], starts[1] if last else len(h1)
                yield out(EDGE, int(min(n_docs[0], min_docs)) if not goes[0] else min_docs, [x[a : a + 1] for x in rows])
                if not goes[0]:
                    yield out(OPEN, 0, [x[a:z] for x in rows])
                elif keep_first:
                    yield out(OPEN, 0, [x[a : a + 1] for x in rows])
            if goes[last]:
                if begins[last]:
                    edge = [x[starts[last] : starts[last] + 1] for x in rows]
                settled = (int(h1[-1]), int(h2[-1]))
            else:
                settled = None
                carry = [x[starts[last] :] for x in rows]
        if carry is not None:
            fresh = np.ones(len(carry[0]), dtype=bool)
            fresh[1:] = (carry[2][1:] != carry[2][:-1]) | (carry[3][1:] != carry[3][:-1])
            yield out(EDGE, int(fresh.sum()), [x[:1] for x in carry])
            yield out(OPEN, 0, carry)
        elif settled is not None and settled != first and edge is not None:
            yield out(EDGE, min_docs, edge)

    return scan, "state int, n long, h1 long, h2 long, k1 long, k2 long, pos int"


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """One row (k1, k2, pos) for each line that goes.

    keep "none": a key of min_docs documents or more loses all its lines. "first": it keeps its first occurrence,
    by document key and position; with min_docs=1 this also removes repeats inside one document.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is {keep!r}, not 'none' or 'first'")
    scan, schema = _stream(min_docs, keep == "first")
    ranged = line_hashes(docs, min_chars).repartitionByRange("h1", "h2", "k1", "k2").sortWithinPartitions(*LINE)
    seen = checkpoint(ranged.mapInArrow(scan, schema))
    # Two rows a partition at most: the bound of this broadcast.
    totals = seen.where(F.col("state") == EDGE).groupBy("h1", "h2").agg(F.sum("n").alias("n_all"), F.min(F.struct("k1", "k2", "pos")).alias("head")).where(F.col("n_all") >= min_docs)
    late = seen.where(F.col("state") == OPEN).join(F.broadcast(totals), ["h1", "h2"])
    if keep == "first":
        late = late.where(F.struct("k1", "k2", "pos") != F.col("head"))
    return seen.where(F.col("state") == DECIDED).select("k1", "k2", "pos").unionByName(late.select("k1", "k2", "pos"))


def pack(drops: np.ndarray, size: int) -> bytes:
    """A keep bitmap of size lines: one bit a line, 1 where it stays, deflated."""
    bits = np.ones(-(-size // 8) * 8, dtype=np.uint8)
    bits[drops] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpack(bitmap: bytes, size: int) -> np.ndarray:
    """The bitmap for size lines; lines beyond its end stay."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))[:size].astype(bool)
    return np.concatenate([bits, np.ones(size - len(bits), dtype=bool)])


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """(k1, k2, bitmap) for each document that loses a line; bitmaps end after the last lost line."""
    drops = dropped_lines(docs, min_docs, min_chars, keep).groupBy("k1", "k2").agg(F.collect_set("pos").alias("at"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = [pack(at, int(at.max()) + 1) for at in (np.array(x) for x in b.column(2).to_pylist())]
            yield batch(["k1", "k2", "bitmap"], b.column(0), b.column(1), pa.array(maps, pa.binary()))

    return drops.mapInArrow(encode, "k1 long, k2 long, bitmap binary")


def rewritten(rows: DataFrame, text: str, doc_id: str, min_docs: int, min_chars: int, keep: str) -> DataFrame:
    """rows (columns c0, c1, ...) with the column `text` rewritten, and after them n_lines, n_dropped."""
    k1, k2 = row_key(text, doc_id)
    docs = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    maps = keep_bitmaps(docs, min_docs, min_chars, keep)
    joined = rows.withColumn(text, F.col(text).cast("string")).withColumns({"k1": k1, "k2": k2}).join(maps.hint("shuffle_hash"), ["k1", "k2"], "left").drop("k1", "k2")
    where, found = rows.columns.index(text), len(rows.columns)
    fields = [f for f in joined.schema.fields if f.name != "bitmap"] + [T.StructField(x, T.LongType()) for x in ("n_lines", "n_dropped")]
    names = [f.name for f in fields]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, bitmap in zip(b.column(where).cast(pa.binary()).to_pylist(), b.column(found).to_pylist()):
                if bitmap is None:
                    texts.append(text)
                    n_lines.append((text or b"").count(b"\n") + 1)
                    n_dropped.append(0)
                    continue
                lines = text.split(b"\n")
                stays = unpack(bitmap, len(lines))
                texts.append(b"\n".join([x for x, k in zip(lines, stays) if k]))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - int(stays.sum()))
            columns = list(b.columns[:found])
            columns[where] = pa.array(texts, pa.binary()).cast(pa.string())
            yield batch(names, *columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()))

    return joined.mapInArrow(apply, T.StructType(fields))


def deduplicate(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", length: str | None = None) -> DataFrame:
    """All columns of docs with text rewritten; other columns may have any names.

    The kept lines are joined by \\n; a text that loses nothing, null too, comes back as it was. length: a column that
    holds the text's code points and follows it where lines go; ignored if docs doesn't have it.
    """
    rows, name = numbered(docs)
    done = rewritten(rows, name("text"), name("doc_id"), min_docs, min_chars, keep)
    if length in docs.columns:
        now = F.length(name("text")).cast(docs.schema[length].dataType)
        done = done.withColumn(name(length), F.when(F.col("n_dropped") > 0, now).otherwise(F.col(name(length))))
    return done.select(*rows.columns).toDF(*docs.columns)


def digest(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays, for each document."""
    done = rewritten(docs.select(F.col("doc_id").alias("c0"), F.col("text").alias("c1")), "c1", "c0", min_docs, min_chars, "none")
    return done.select(F.col("c0").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("c1", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: digest() in SQL for 10 documents and keys of 1 code point or more.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS n, doc_id, text IS NULL AS missing, coalesce(text, '') AS text FROM documents),
l AS (SELECT n, doc_id, missing, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT row(doc_id, missing, text)) >= 10),
m AS (SELECT k.*, often.key IS NOT NULL AS gone FROM k LEFT JOIN often ON k.key = often.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY n, doc_id
"""

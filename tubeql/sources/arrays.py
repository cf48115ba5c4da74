"""Elements of huge JSON arrays: one file is read by many tasks.

A byte range doesn't tell by itself whether it begins inside a string, nor how deep. So a first pass makes one small row
a range: whether its quotes are odd in number, and by how much it changes the depth for either beginning. Running sums
of these over a file's ranges give each range its true beginning, and a second pass cuts the elements whose border (the
array's bracket, or a comma of it) lies in the range, reading on to the end of the last one. An element must fit a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .video import opened

#: Bytes of a range and of one read.
RANGE, BLOCK = 64 << 20, 1 << 20
#: Elements' bytes that a task holds before it passes them on.
BATCH = 8 << 20
QUOTE, BACKSLASH, COMMA, OPEN, CLOSE, OPEN_ARRAY, CLOSE_ARRAY = (ord(c) for c in '"\\,{}[]')
_MARK = np.isin(np.arange(256), (QUOTE, COMMA, OPEN, CLOSE, OPEN_ARRAY, CLOSE_ARRAY))
_STEP = np.where(np.isin(np.arange(256), (OPEN, OPEN_ARRAY)), 1, 0) - np.where(np.isin(np.arange(256), (CLOSE, CLOSE_ARRAY)), 1, 0)


class Marks:
    """Quotes, brackets and commas of a file from a place on, block by block; run counts the backslashes before it."""

    def __init__(self, file, start: int):
        self.file, self.at, self.run = file, start, 0
        back = start
        while back > 0 and self.run == start - back:
            size = min(4_096, back)
            file.seek(back - size)
            before = file.read(size)
            self.run += len(before) - len(before.rstrip(b"\\"))
            back -= size
        file.seek(start)

    def next(self, size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, places, marks, whether each of them has an odd number of quotes before it in this block)."""
        raw = self.file.read(size)
        block = np.frombuffer(raw, np.uint8)
        places = np.flatnonzero(_MARK[block])
        marks = block[places]
        quote = marks == QUOTE
        plain = np.maximum.accumulate(np.where(block != BACKSLASH, np.arange(len(block)), -1)) if len(block) and (self.run or BACKSLASH in raw) else None
        if plain is not None:
            # The backslashes right before each quote; those before the block count where it has nothing else there.
            q = places[quote]
            last = np.where(q > 0, plain[q - 1], -1)
            count = q - 1 - last + np.where(last < 0, self.run, 0)
            quote[np.flatnonzero(quote)[count % 2 == 1]] = False
            self.run = len(block) - 1 - int(plain[-1]) + (self.run if plain[-1] < 0 else 0)
        odd = (np.cumsum(quote) - quote) % 2 == 1
        keep = quote | (marks != QUOTE)
        self.at += len(raw)
        return raw, places[keep], marks[keep], odd[keep]


def summary(path: str, start: int, end: int) -> tuple[int, int, int]:
    """(quotes modulo 2, change of depth if the range begins outside a string, and inside one)."""
    system, place = opened(path)
    odd, deltas = 0, [0, 0]
    with system.open_input_file(place) as file:
        scan = Marks(file, start)
        while scan.at < end:
            raw, _, marks, flipped = scan.next(min(BLOCK, end - scan.at))
            if not raw:
                break
            steps, inside = _STEP[marks], flipped ^ bool(odd)
            deltas[0] += int(steps[~inside].sum())
            deltas[1] += int(steps[inside].sum())
            odd ^= int((marks == QUOTE).sum()) % 2
    return odd, deltas[0], deltas[1]


def cut(path: str, start: int, end: int, inside: bool, depth: int) -> Iterator[tuple[int, str]]:
    """(place, text) of each element whose border lies in the range, which begins at that depth, inside a string or not."""
    system, place = opened(path)
    with system.open_input_file(place) as file:
        scan, begun, held = Marks(file, start), -1, []
        while scan.at < end or begun >= 0:
            base = scan.at
            raw, places, marks, flipped = scan.next(min(BLOCK, end - base) if base < end else BLOCK)
            if not raw:
                if begun >= 0:
                    raise ValueError(f"{path} ends inside an array")
                return
            real = ~(flipped ^ inside) & (marks != QUOTE)
            inside ^= bool((marks == QUOTE).sum() % 2)
            where, kinds = places[real], marks[real]
            after = depth + np.cumsum(_STEP[kinds])
            if ((kinds == OPEN) & (after == 1)).any():
                raise ValueError(f"{path} has something else than an array at its top")
            depth = int(after[-1]) if len(after) else depth
            opening = ((kinds == OPEN_ARRAY) | (kinds == COMMA)) & (after == 1)
            closing = (kinds == CLOSE_ARRAY) & (after == 0)
            for at, opens in zip(where[opening | closing].tolist(), opening[opening | closing].tolist()):
                if begun >= 0:
                    text = b"".join([*held, raw[max(0, begun - base) : at]]).decode().strip()
                    held = []
                    if text:
                        yield begun, text
                begun = base + at + 1 if opens and base + at < end else -1
                if base + at >= end:
                    return
            if begun >= 0:
                held.append(raw[max(0, begun - base) :])


def elements(spark: SparkSession, *paths: str, range_bytes: int = RANGE) -> DataFrame:
    """(path, place, value): the text of each element of the arrays in files (globs and folders too), and where it begins.

    Files hold one array or several, one after another, in UTF-8. Empty files and arrays have no rows; it is an error if
    a file has something else than arrays at its top, or ends inside one. What is between elements isn't checked.
    """
    files = spark.read.format("binaryFile").load(list(paths)).where("length > 0").select("path", "length")
    size = F.lit(range_bytes)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {range_bytes}")))
    ranges = files.select("path", "length", starts.alias("k")).select("path", (F.col("k") * size).alias("start"), F.least((F.col("k") + 1) * size, "length").alias("end"))
    # A number of tasks of our own: the rows are tiny, and would be put into one task by their size.
    n = files.agg(F.sum(F.ceil(F.col("length") / size))).first()[0] or 1
    tasks = max(1, min(int(n), 100_000))

    def summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, start, end in part[["path", "start", "end"]].itertuples(index=False):
                yield pd.DataFrame([(path, start, end, *summary(path, start, end))], columns=["path", "start", "end", "odd", "outside", "inside"])

    def found(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, start, end, inside, depth in part[["path", "start", "end", "in_string", "depth"]].itertuples(index=False):
                rows, size = [], 0
                for place, text in cut(path, start, end, bool(inside), int(depth)):
                    rows.append((path, place, text))
                    size += len(text)
                    if size > BATCH:
                        yield pd.DataFrame(rows, columns=["path", "place", "value"])
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "place", "value"])

    kinds = "path string, start long, end long, odd long, outside long, inside long"
    sums = ranges.repartition(tasks, "path", "start").mapInPandas(summed, kinds)
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    states = sums.withColumn("in_string", inside).withColumn("delta", F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside")))
    states = states.withColumn("depth", F.coalesce(F.sum("delta").over(before), F.lit(0)))
    spread = states.select("path", "start", "end", "in_string", "depth").repartition(tasks, "path", "start")
    return spread.mapInPandas(found, "path string, place long, value string")

"""The first principal axis of each key's vectors, for any number of vectors.

A block of rows [1, x] is replaced by the triangle R of its QR decomposition, which has the same scatter (R'R), at most
d + 1 rows of it; triangles of blocks are stacked and decomposed again, in any order. In the last triangle the block
below and right of the first entry is the scatter about the mean, so no mean is taken beforehand. Tasks fold what they
read before the shuffle, and a key's triangles stream through one (d + 1) x (d + 1) matrix after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that a task holds in triangles before it passes them on.
HELD = 1 << 22


def triangle(rows: np.ndarray) -> np.ndarray:
    """Rows with the same scatter, at most as many as there are columns."""
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def with_ones(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(float)
    return np.hstack([np.ones((len(x), 1)), x])


def axis(rows: np.ndarray) -> tuple[int, list[float], float | None]:
    """(number of vectors, axis, its share of the variance) of stacked triangles.

    The largest component of the axis is positive. Vectors without any variance have the first unit vector and no share.
    """
    r = np.linalg.qr(rows, mode="r")
    n, d = round(float(r[0, 0]) ** 2), rows.shape[1] - 1
    centred = r[1:, 1:]
    # A vector that all share leaves rounding only.
    if not len(centred) or np.abs(centred).max() <= 1e-12 * np.abs(r).max():
        return n, np.eye(d)[0].tolist(), None
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    first = vt[0] * np.sign(vt[0][np.abs(vt[0]).argmax()])
    return n, first.tolist(), float(s[0] ** 2 / (s**2).sum())


def principal_axis(df: DataFrame, keys: list[str], vector: str, limit: int = HELD) -> DataFrame:
    """(keys, n, vec, explained): see axis(); a task holds some `limit` numbers at most. Rows without a vector aren't counted; vectors of a key have one length."""
    kinds = dict(df.dtypes)
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    rows = df.where(F.col(vector).isNotNull()).select(*keys, F.col(vector).cast("array<double>").alias("_row"))

    def groups(part: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame]]:
        for key, own in part.groupby(keys, sort=False, dropna=False):
            yield tuple(None if pd.isna(k) else k for k in key), own

    def frame(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([f[i] for f in found], dtype=object) for i, c in enumerate([*keys, "_row"])})

    def folded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        size = 0
        for part in parts:
            for key, own in groups(part):
                new = with_ones(own["_row"])
                old = held.get(key)
                held[key] = triangle(new if old is None else np.vstack([old, new]))
                size += held[key].size - (0 if old is None else old.size)
            if size > limit:
                for key, r in held.items():
                    yield frame([(*key, row) for row in r])
                held, size = {}, 0
        for key, r in held.items():
            yield frame([(*key, row) for row in r])

    def last(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None

        def done() -> pd.DataFrame:
            n, vec, share = axis(held)
            values = dict(zip([*keys, "n", "vec", "explained"], [*key, n, vec, share]))
            return pd.DataFrame({c: pd.Series([v], dtype=object) for c, v in values.items()})

        for part in parts:
            for k, own in groups(part):
                new = np.stack(own["_row"].to_numpy())
                if held is not None and k != key:
                    yield done()
                    held = None
                key, held = k, triangle(new if held is None else np.vstack([held, new]))
        if held is not None:
            yield done()

    parts = rows.mapInPandas(folded, f"{named}, _row array<double>").repartition(*keys).sortWithinPartitions(*keys)
    return parts.mapInPandas(last, f"{named}, n long, vec array<double>, explained double")

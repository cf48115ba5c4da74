"""What the operators share: tables, row keys, checkpoints, Arrow columns."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of the word pattern [^\x20\x09-\x0D]+, as bytes.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a Java character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(text: str = "text", doc_id: str = "doc_id") -> tuple[Column, Column]:
    """Two longs, never null, that tell documents apart.

    Rows that agree in doc_id and text are one document; rows that share only one of the two are not.
    """
    low = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    return low, F.xxhash64(F.col(doc_id).isNull(), F.col(text).isNull(), F.col(text))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or one that was set on the context.

    Only where driver and executors are one process (master local) and neither is set, a temporary one is made; on a
    cluster other executors couldn't read it, so there it is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tubeql-")
        context.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as a table to the shared folder and read again, and where it lies: lineage ends there.

    A lost executor costs the tasks that ran on it, nothing before the table. Tables that nobody removes go when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tubeql-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path), path


def checkpoint(df: DataFrame) -> DataFrame:
    return written(df)[0]


def numbered(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """docs with its columns named c0, c1, ..., and a function that gives a column's new name: no working name clashes."""
    names = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), lambda name: f"c{names.index(name)}"


#: A key with fewer rows isn't heavy; of the others so many are, at most, the most frequent: any other key has fewer
#: than HEAVY_ROWS rows, or no more than one in MOST_HEAVY of all. A heavy key is dealt to so many tasks at most.
HEAVY_ROWS, MOST_HEAVY, MOST_SALTS = 500, 1_000, 1_024


def skew_join(fact: DataFrame, dim: DataFrame, key: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """fact joined with dim, which has one row a key at most; how: inner or left. A key may hold any share of fact.

    Rows of heavy keys are dealt out by a salt that depends on their partition and content only, and the keys' rows of
    dim are repeated for each salt. What is broadcast are the heavy keys, MOST_HEAVY at most. rows: those of fact, if
    known; a few need no salt.
    """
    if rows is not None and rows <= 4 * HEAVY_ROWS:
        return fact.join(dim, key, how)
    counts = fact.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= HEAVY_ROWS)
    heavy = counts.orderBy(F.col("_n").desc(), key).limit(MOST_HEAVY).collect()
    if not heavy and how == "inner":
        return fact.join(dim, key)
    kind = dict(fact.dtypes)[key]
    salts = [min(-(-r[1] // HEAVY_ROWS), MOST_SALTS) for r in heavy]
    zipped = F.arrays_zip(F.lit([r[0] for r in heavy]).cast(f"array<{kind}>").alias("k"), F.lit(salts).cast("array<int>").alias("n")) if heavy else F.array().cast(f"array<struct<k:{kind},n:int>>")
    known = F.broadcast(fact.sparkSession.range(1).select(F.inline(zipped).alias("_k", "_salts")))
    many = lambda df: df.join(known, F.col(key) == F.col("_k"), "left").drop("_k")
    size = F.when(F.col(key).isNull(), MOST_SALTS).otherwise(F.coalesce("_salts", F.lit(1)))
    left = many(fact).withColumn("_salt", F.pmod(F.xxhash64(F.spark_partition_id(), *fact.columns), size).cast("int")).drop("_salts")
    right = many(dim.where(F.col(key).isNotNull())).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


#: Keys of rows (two longs) up to this number are sent to all tasks; more are shuffled.
MAX_KEYS = 500_000


def sized(keys: DataFrame) -> DataFrame:
    """keys, marked for broadcast if they are few."""
    return F.broadcast(keys) if keys.count() <= MAX_KEYS else keys


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null gives no bytes."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def longs(column: pa.Array) -> np.ndarray:
    """A column without nulls as int64."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def give_back() -> None:
    """Returns a worker's free memory to the system at a task's end: Spark keeps workers alive between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)

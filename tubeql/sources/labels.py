"""Training labels: text lines "class x y w h" of images from several sets, remapped to one class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_class(images: DataFrame, lines: DataFrame, wanted: int, prefix: str) -> DataFrame:
    """(image, lines, n_lines): each image of a set under a prefixed name with its lines of one class, as class 0.

    images: (stem); lines: (stem, line_no, line). An image without labels stays, with no lines.
    """
    parts = F.split(F.trim("line"), r"\s+")
    own = lines.where((F.size(parts) > 0) & (F.get(parts, F.lit(0)) == str(wanted)))
    remapped = own.select("stem", "line_no", F.concat_ws(" ", F.concat(F.array(F.lit("0")), F.slice(parts, 2, F.size(parts)))).alias("line"))
    per = remapped.groupBy("stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("lines"), F.count("*").alias("n_lines"))
    return images.join(per, "stem", "left").select(F.concat_ws("_", F.lit(prefix), "stem").alias("image"), F.coalesce("lines", F.lit("")).alias("lines"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def counts(images: DataFrame) -> DataFrame:
    return images.agg(F.count("*").alias("n_images"), F.count_if(F.col("n_lines") > 0).alias("n_with_class"))

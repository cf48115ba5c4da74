"""Views derived from the driver's tables, in Spark and as common table expressions for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 1920, 1080
KEYS = ["video_id", "frame"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate box a row."""
    rows = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("cand_id"),
        (F.col("user_id") % 10).alias("video_id"),
        (F.datediff("ts", F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")).cast("int").alias("frame"),
        (F.col("value") / 500).alias("score"),
        "event_type",
    )
    x1 = 200 + (F.col("frame") * 7) % 1500 + (F.col("cand_id") * 37) % 41 - 20
    y1 = 150 + (F.col("frame") * 5) % 700 + (F.col("cand_id") * 53) % 41 - 20
    sides = {"x1": x1, "y1": y1, "x2": x1 + 40 + (F.col("cand_id") * 11) % 30, "y2": y1 + 40 + (F.col("cand_id") * 13) % 30}
    return rows.withColumns({k: v.cast("double") for k, v in sides.items()})


def best(df: DataFrame, *order) -> DataFrame:
    """The first row of each frame in the given order; ties must not be left."""
    first = F.min(F.struct(*order, *[c for c in df.columns if c not in KEYS])).alias("_first")
    return df.groupBy(*KEYS).agg(first).select(*KEYS, *[F.col(f"_first.{c}") for c in df.columns if c not in KEYS])


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(cand(spark, sf_dir).where(F.col("event_type").isin("view", "click", "purchase")), (-F.col("score")).alias("_s"), F.col("cand_id").alias("_c"))


def gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(cand(spark, sf_dir).where(F.col("event_type").isin("error", "signup")), F.col("cand_id").alias("_c")).select(*KEYS, "x1", "y1", "x2", "y2")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("feature"), F.col("label").cast("bigint").alias("label"))


def n_vectors(spark: SparkSession, sf_dir: str) -> int:
    """The number of embeddings; their vec_ids count from 0."""
    return read(spark, sf_dir, "embeddings").count()


def cand_feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their features, dealt over all embeddings."""
    return cand(spark, sf_dir).withColumn("vec_id", F.col("cand_id") % n_vectors(spark, sf_dir)).join(embeddings(spark, sf_dir).drop("label"), "vec_id").drop("vec_id")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, ref_id, view_id, feature, mask_ratio): reference vectors; a video's three labels are its references."""
    e = embeddings(spark, sf_dir)
    three = e.withColumn("ref_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return three.select(F.pmod(F.col("label") - F.col("ref_id"), F.lit(10)).alias("video_id"), "ref_id", F.col("vec_id").alias("view_id"), "feature", ((F.col("label") * 7 + 13) % 100 / 100).alias("mask_ratio"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities on 16 x 16 grids."""
    e = read(spark, sf_dir, "events")
    return e.select(F.expr("event_id div 256").alias("tile"), (F.col("event_id") % 16).cast("int").alias("gx"), F.expr("cast((event_id div 16) % 16 as int)").alias("gy"), (F.col("value") / 500).alias("sim"))


def track_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each video and frame 0..719: detection at a keyframe, tracker output, verification, re-detection."""
    videos = spark.range(10).select(F.col("id").alias("video_id"), F.explode(F.sequence(F.lit(0), F.lit(719))).alias("frame"))
    p = pred(spark, sf_dir)
    det = p.where("frame % 8 = 0").select(*KEYS, *[F.col(c).alias(f"det_{c}") for c in ("x1", "y1", "x2", "y2")])
    red = p.where("frame % 3 = 0").select(*KEYS, *[F.col(c).alias(f"red_{c}") for c in ("x1", "y1", "x2", "y2")])
    lost = (F.col("frame") + F.col("video_id")) % 37 == 0
    base = {"x1": 200 + F.col("frame") % 700, "y1": 100 + F.col("frame") % 300}
    sides = base | {"x2": base["x1"] + 50, "y2": base["y1"] + 40}
    out = videos.withColumns({f"trk_{k}": F.when(~lost, v.cast("double")) for k, v in sides.items()})
    out = out.withColumn("trk_conf", ((F.col("frame") * 31 + F.col("video_id") * 17) % 100) / 100.0).withColumn("verify_sim", ((F.col("frame") * 13 + F.col("video_id") * 7) % 100) / 100.0)
    return out.join(det, KEYS, "left").join(red, KEYS, "left")


#: The size of the rasters that embeddings give: three numbers a pixel.
IMAGE = (7, 3)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, width, height, values, pixels): each vector's first numbers, in thousandths modulo 256, as an image."""
    w, h = IMAGE
    values = F.transform(F.slice("feature", 1, 3 * w * h), lambda x: F.pmod(F.floor(x * 1000), F.lit(256)).cast("int"))
    pixels = F.unhex(F.array_join(F.transform("values", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return embeddings(spark, sf_dir).select("vec_id", "label", F.lit(w).alias("width"), F.lit(h).alias("height"), values.alias("values")).withColumn("pixels", pixels)


#: The same views for the oracle.
SQL = {
    "cand0": """cand0 AS (SELECT event_id AS cand_id, user_id % 10 AS video_id, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS INTEGER) AS frame,
      value / 500 AS score, event_type FROM events)""",
    "cand": """cand AS (SELECT *, x1 + 40 + (cand_id * 11) % 30 AS x2, y1 + 40 + (cand_id * 13) % 30 AS y2 FROM (SELECT *,
      CAST(200 + (frame * 7) % 1500 + (cand_id * 37) % 41 - 20 AS DOUBLE) AS x1, CAST(150 + (frame * 5) % 700 + (cand_id * 53) % 41 - 20 AS DOUBLE) AS y1 FROM cand0))""",
    "pred": """pred AS (SELECT * FROM cand WHERE event_type IN ('view', 'click', 'purchase') QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY score DESC, cand_id) = 1)""",
    "gt": """gt AS (SELECT video_id, frame, x1, y1, x2, y2 FROM cand WHERE event_type IN ('error', 'signup') QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY cand_id) = 1)""",
    "emb": """emb AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS feature, CAST(label AS BIGINT) AS label FROM embeddings)""",
    "img": """img AS (SELECT vec_id, label, list_transform(feature[1:63], lambda x: CAST(((floor(x * 1000) % 256) + 256) % 256 AS INTEGER)) AS v FROM emb)""",
    "nv": """nv AS (SELECT count(*) AS nv FROM embeddings)""",
    "cand_feat": """cand_feat AS (SELECT cand.*, emb.feature FROM cand CROSS JOIN nv JOIN emb ON emb.vec_id = cand.cand_id % nv)""",
    "refs": """refs AS (SELECT (label - r + 10) % 10 AS video_id, r AS ref_id, vec_id AS view_id, feature, (label * 7 + 13) % 100 / 100 AS mask_ratio FROM emb, (SELECT unnest([0, 1, 2]) AS r))""",
    "patches": """patches AS (SELECT event_id // 256 AS tile, CAST(event_id % 16 AS INTEGER) AS gx, CAST((event_id // 16) % 16 AS INTEGER) AS gy, value / 500 AS sim FROM events)""",
}
NEEDS = {"cand": ["cand0"], "pred": ["cand"], "gt": ["cand"], "cand_feat": ["cand", "emb", "nv"], "refs": ["emb"], "img": ["emb"]}


def with_views(body: str, *views: str, recursive: bool = False) -> str:
    """body, which begins with further expressions and a comma or with SELECT, after the views it needs."""
    order: list[str] = []

    def add(v: str) -> None:
        for n in NEEDS.get(v, []):
            add(n)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    text = ", ".join(SQL[v] for v in order)
    body = body.strip()
    glue = " " if body.upper().startswith("SELECT") else ", "
    return f"WITH {'RECURSIVE ' if recursive else ''}{text}{glue}{body}"

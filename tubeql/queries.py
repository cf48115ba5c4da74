"""Queries over the driver's tables, one an operator, each with its oracle in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures as fx
from .fixtures import with_views
from .functions import vec
from .functions import box as bx
from .functions import mask as mk
from .operators import blobs, evaluate, match, pca, prototype, raster, select, tiles, track, tube
from .operators.shared import settle, shared_path
from .plans import composite, models
from .plans.config import Config
from .sources import frames as frame_source
from .sources import labels, submissions, video

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEYS = ["video_id", "frame"]
B = ("x1", "y1", "x2", "y2")
ZS = [1.0, 1.5, 2.0, 2.5, 3.0]


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def r6(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


def quick6(c: str):
    """F.round(c, 6), which takes decimals, for a column of very many values from 0 to 1: decimals only near a half."""
    x = F.col(c) * 1e6
    return F.when(F.abs(F.abs(x - F.rint(x)) - 0.5) > 1e-6, F.rint(x) / 1e6).otherwise(F.round(c, 6))


def sr6(*columns: str, of: str = "") -> str:
    return ", ".join(f"round({of}{c}, 6) AS {c}" for c in columns)


def exploded(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """A vector as rows (keys, pos, value): comparable in any engine."""
    return df.select(*keys, F.posexplode(v).alias("pos", "value")).select(*keys, "pos", F.round("value", 6).alias("value"))


def siou(a: str, b: str) -> str:
    """IoU of boxes with the prefixes a and b, in SQL."""
    inter = f"(greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1), 0) * greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1), 0))"
    area = lambda p: f"(greatest({p}x2 - {p}x1, 0) * greatest({p}y2 - {p}y1, 0))"
    union = f"({area(a)} + {area(b)} - {inter})"
    return f"(CASE WHEN {inter} > 0 AND {union} > 0 THEN {inter} / {union} ELSE 0.0 END)"


def snms(src: str, out: str, keys: str, by: str, t: float, tie: str = "cand_id") -> str:
    """Expressions {out}: the kept rows of src with nms_rank, by a recursive list of what is kept."""
    k = [x.strip() for x in keys.split(",")]
    on = " AND ".join(f"n.{x} = {out}_f.{x}" for x in k)
    own = ", ".join(f"n.{x}" for x in k)
    return f"""
    {out}_r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {by} DESC, {tie}) AS r, count(*) OVER (PARTITION BY {keys}) AS n_all FROM {src}),
    {out}_f AS (
      SELECT {keys}, r, n_all, [{{'id': {tie}, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM {out}_r WHERE r = 1
      UNION ALL SELECT {own}, n.r, n.n_all, CASE WHEN len(list_filter(kept, lambda k: {siou('k.', 'n.')} > {t})) > 0 THEN kept ELSE list_append(kept, {{'id': n.{tie}, 'x1': n.x1, 'y1': n.y1, 'x2': n.x2, 'y2': n.y2}}) END
      FROM {out}_f JOIN {out}_r n ON {on} AND n.r = {out}_f.r + 1),
    {out}_k AS (SELECT {keys}, unnest(list_transform(kept, lambda k: k.id)) AS {tie}, generate_subscripts(kept, 1) AS nms_rank FROM {out}_f WHERE r = n_all),
    {out} AS (SELECT s.*, nms_rank FROM {src} s JOIN {out}_k USING ({keys}, {tie}))"""


# ---- scalar expressions ---------------------------------------------------------------------------------------


@query(with_views("SELECT cand_id, greatest(x2 - x1, 0.0) * greatest(y2 - y1, 0.0) AS area FROM cand", "cand"))
def box_area(spark, sf):
    return fx.cand(spark, sf).select("cand_id", bx.area(bx.box()).alias("area"))


@query(with_views("SELECT cand_id, " + ", ".join(f"greatest(0.0, least({c}, {n}.0)) AS {c}" for c, n in zip(B, (900, 500, 900, 500))) + " FROM cand", "cand"))
def box_clip(spark, sf):
    return fx.cand(spark, sf).select("cand_id", *bx.clip(bx.box(), F.lit(900), F.lit(500)).named())


@query(with_views(f"SELECT p.video_id, p.frame, round({siou('p.', 'g.')}, 6) AS iou FROM pred p JOIN gt g USING (video_id, frame)", "pred", "gt"))
def box_iou(spark, sf):
    g = fx.gt(spark, sf).select(*KEYS, *[F.col(c).alias("g_" + c) for c in B])
    return fx.pred(spark, sf).join(g, KEYS).select(*KEYS, F.round(bx.iou(bx.box(), bx.box("g_")), 6).alias("iou"))


_WH = {"xyxy": ("x1", "y1", "x2", "y2"), "xywh": ("x1", "y1", "x2 - x1", "y2 - y1"), "cxcywh": ("(x1 + x2) / 2", "(y1 + y2) / 2", "x2 - x1", "y2 - y1")}


@query(with_views(" UNION ALL ".join(f"SELECT cand_id, '{f}' AS format, {n} AS normalized, " + ", ".join(f"round(({e}){d}, 9) AS {c}" for e, c, d in zip(_WH[f], "abcd", ("", "", "", "") if n == "false" else (" / 1920", " / 1080", " / 1920", " / 1080"))) + " FROM cand" for f in _WH for n in ("false", "true")), "cand"))
def box_convert(spark, sf):
    """To each format and, from there, back: the way back must be the box, or the query shows it."""
    c, w, h, out = fx.cand(spark, sf), F.lit(1920), F.lit(1080), None
    for f in bx.FORMATS:
        for n in (False, True):
            there = bx.convert(bx.box(), "xyxy", f, w, h, normalized_out=n)
            back = bx.convert(there, f, "xyxy", w, h, normalized_in=n)
            again = bx.convert(back, "xyxy", f, w, h, normalized_out=n)
            part = c.select("cand_id", F.lit(f).alias("format"), F.lit(n).alias("normalized"), *[F.round(v, 9).alias(k) for v, k in zip(again, "abcd")])
            out = part if out is None else out.unionByName(part)
    return out


@query(with_views("SELECT cand_id, x1 + 480 AS x1, y1 + 360 AS y1, x2 + 480 AS x2, y2 + 360 AS y2 FROM cand", "cand"))
def tile_remap(spark, sf):
    return fx.cand(spark, sf).select("cand_id", *bx.shift(bx.box(), F.lit(480), F.lit(360)).named())


@query(with_views("SELECT cand_id, scale, " + ", ".join(f"round({c} / scale, 6) AS {c}" for c in B) + " FROM cand, (SELECT unnest([CAST(0.75 AS DOUBLE), 1.0, 1.5]) AS scale)", "cand"))
def scale_rescale(spark, sf):
    return tiles.scale_frames(fx.cand(spark, sf), [0.75, 1.0, 1.5]).select("cand_id", "scale", *[F.round(v, 6).alias(n) for v, n in zip(bx.rescale(bx.box(), F.col("scale")), B)])


@query(with_views("SELECT cand_id, greatest(0, CAST(trunc(x1 - (x2 - x1) * 0.1) AS INTEGER)) AS x1, greatest(0, CAST(trunc(y1 - (y2 - y1) * 0.1) AS INTEGER)) AS y1, least(1000, CAST(trunc(x2 + (x2 - x1) * 0.1) AS INTEGER)) AS x2, least(600, CAST(trunc(y2 + (y2 - y1) * 0.1) AS INTEGER)) AS y2 FROM cand", "cand"))
def crop_rect(spark, sf):
    return fx.cand(spark, sf).select("cand_id", *bx.crop_rect(bx.box(), F.lit(1000), F.lit(600), 0.1).named())


@query(with_views("SELECT cand_id, CAST((w - bw) // 2 AS INTEGER) AS x1, CAST((h - bh) // 2 AS INTEGER) AS y1, CAST((w - bw) // 2 + bw AS INTEGER) AS x2, CAST((h - bh) // 2 + bh AS INTEGER) AS y2 FROM (SELECT *, CAST(round_even(w * CAST(0.7 AS DOUBLE), 0) AS INTEGER) AS bw, CAST(round_even(h * CAST(0.7 AS DOUBLE), 0) AS INTEGER) AS bh FROM (SELECT cand_id, cand_id % 97 + 20 AS w, cand_id % 53 + 30 AS h FROM cand))", "cand"))
def center_box(spark, sf):
    return fx.cand(spark, sf).select("cand_id", *bx.center_box(F.col("cand_id") % 97 + 20, F.col("cand_id") % 53 + 30, 0.7).named())


_RATED = with_views("SELECT cand_id, round({}, 6) AS sim FROM (SELECT cand_id, f.feature AS a, e.feature AS b FROM cand_feat f CROSS JOIN nv JOIN emb e ON e.vec_id = (f.cand_id * 7 + 3) % nv)", "cand_feat")


def _rated(metric):
    def run(spark, sf):
        other = fx.embeddings(spark, sf).select(F.col("vec_id").alias("_v"), F.col("feature").alias("_f"))
        return fx.cand_feat(spark, sf).join(other, (F.col("cand_id") * 7 + 3) % fx.n_vectors(spark, sf) == F.col("_v")).select("cand_id", F.round(vec.similarity(F.col("feature"), F.col("_f"), metric), 6).alias("sim"))

    return run


query(_RATED.format("list_dot_product(a, b)"), "sim_cosine")(_rated("cosine"))
query(_RATED.format("-sqrt(list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"), "sim_l2")(_rated("l2"))
query(_RATED.format("-list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2])))"), "sim_l1")(_rated("l1"))

_UNNEST = "unnest({0}) AS value, generate_subscripts({0}, 1) - 1 AS pos"


@query(with_views("SELECT vec_id, guard, CAST(pos AS INTEGER) AS pos, round(value, 6) AS value FROM (SELECT vec_id, guard, " + _UNNEST.format("list_transform(v, lambda x: x / CASE guard WHEN 'eps' THEN n + 1e-8 WHEN 'clip' THEN greatest(n, 1e-8) ELSE CASE WHEN n > 0 THEN n ELSE 1 END END)") + " FROM (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM (SELECT vec_id, list_transform(feature, lambda x: x * (vec_id % 5)) AS v FROM emb)), (SELECT unnest(['positive', 'eps', 'clip']) AS guard))", "emb"))
def l2_normalize(spark, sf):
    """The three guards against zero vectors; each fifth vector is zero."""
    e = fx.embeddings(spark, sf).withColumn("v", F.transform("feature", lambda x: x * (F.col("vec_id") % 5)))
    parts = [exploded(e.select("vec_id", F.lit(g).alias("guard"), vec.normalize(F.col("v"), g).alias("n")), ["vec_id", "guard"], "n") for g in ("positive", "eps", "clip")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(with_views("SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(value, 6) AS value FROM (SELECT vec_id, " + _UNNEST.format("list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-8))") + " FROM (SELECT a.vec_id, list_concat(a.feature, b.feature) AS v FROM emb a CROSS JOIN nv JOIN emb b ON b.vec_id = (a.vec_id + 1) % nv))", "nv", "emb"))
def embed_concat(spark, sf):
    e = fx.embeddings(spark, sf)
    other = e.select(F.col("vec_id").alias("_v"), F.col("feature").alias("_f"))
    joined = e.join(other, (F.col("vec_id") + 1) % fx.n_vectors(spark, sf) == F.col("_v"))
    return exploded(joined.select("vec_id", vec.concat(F.col("feature"), F.col("_f")).alias("v")), ["vec_id"], "v")


@query("SELECT CAST(f AS INTEGER) AS frame, CAST(cx - 11 AS INTEGER) AS x1, CAST(cy - 11 AS INTEGER) AS y1, CAST(cx + 11 AS INTEGER) AS x2, CAST(cy + 11 AS INTEGER) AS y2 FROM (SELECT f, trunc(60 + (f - 5) / 20 * 500) AS cx, 240 + trunc(8 * sin(2 * pi() * ((f - 5) / 20))) AS cy FROM (SELECT unnest(range(5, 26)) AS f))")
def synth_trajectory(spark, sf):
    """A square of 22 pixels that moves on a sine in frames 5 to 25."""
    t = (F.col("frame") - 5) / 20
    cx, cy = (60 + t * 500).cast("int"), 240 + (8 * F.sin(2 * F.lit(3.141592653589793) * t)).cast("int")
    return spark.range(5, 26).select(F.col("id").cast("int").alias("frame")).select("frame", (cx - 11).alias("x1"), (cy - 11).alias("y1"), (cx + 11).alias("x2"), (cy + 11).alias("y2"))


@query(with_views("SELECT DISTINCT video_id, frame FROM cand WHERE frame % 8 = 0", "cand"))
def keyframes(spark, sf):
    return tiles.keyframes(fx.cand(spark, sf), 8).select(*KEYS).distinct()


@query(with_views("SELECT video_id, count(*) AS n, min(frame) AS first, max(frame) AS last FROM (SELECT video_id, unnest(range(0, n, 8)) AS frame FROM (SELECT video_id, max(frame) + 1 AS n FROM cand GROUP BY video_id)) GROUP BY video_id", "cand"))
def keyframe_sequence(spark, sf):
    n = fx.cand(spark, sf).groupBy("video_id").agg((F.max("frame") + 1).alias("n"))
    return n.select("video_id", F.explode(tiles.keyframe_sequence(F.col("n"), 8)).alias("frame")).groupBy("video_id").agg(F.count("*").alias("n"), F.min("frame").cast("long").alias("first"), F.max("frame").cast("long").alias("last"))


@query(with_views("SELECT video_id, ref_id, view_id, mask_ratio >= 0.2 AND mask_ratio <= 0.6 AS plausible, round(CASE WHEN mask_ratio >= 0.2 AND mask_ratio <= 0.6 THEN mask_ratio ELSE 448 * 336 / (640.0 * 480) END + 1e-4, 6) AS weight FROM refs", "refs"))
def ref_weights(spark, sf):
    refs = fx.refs(spark, sf).withColumns({"width": F.lit(640), "height": F.lit(480)})
    return prototype.masks(refs, 0.2, 0.6).select("video_id", "ref_id", "view_id", "plausible", F.round("weight", 6).alias("weight"))


@query(with_views("SELECT video_id, frame, CAST(floor(frame * 100 / 720) AS INTEGER) AS cell FROM pred", "pred"))
def timeline_cells(spark, sf):
    p = fx.pred(spark, sf)
    return tiles.timeline(p.withColumn("video_id", F.struct(*KEYS)), F.lit(720), 100).select("video_id.*", "cell")


# ---- filters, tiles, suppression, top-k -------------------------------------------------------------------------


@query(with_views("SELECT cand_id FROM cand WHERE (x2 - x1) * (y2 - y1) >= 2500", "cand"))
def min_area(spark, sf):
    return fx.cand(spark, sf).where(bx.area(bx.box()) >= 2500).select("cand_id")


@query("WITH s AS (SELECT DISTINCT w, h, greatest(1, CAST(trunc(640 * 0.75) AS INTEGER)) AS stride FROM (VALUES (1920, 1080), (640, 640), (700, 1300), (300, 200), (641, 2560)) v(w, h)), xs AS (SELECT DISTINCT w, h, least(i * stride, greatest(0, w - 640)) AS x FROM s, (SELECT unnest(range(0, 20)) AS i)), ys AS (SELECT DISTINCT w, h, least(i * stride, greatest(0, h - 640)) AS y FROM s, (SELECT unnest(range(0, 20)) AS i)) SELECT w AS width, h AS height, CAST(row_number() OVER (PARTITION BY w, h ORDER BY y, x) - 1 AS INTEGER) AS tile_id, CAST(x AS INTEGER) AS tx1, CAST(y AS INTEGER) AS ty1, CAST(least(x + 640, w) AS INTEGER) AS tx2, CAST(least(y + 640, h) AS INTEGER) AS ty2 FROM xs JOIN ys USING (w, h)")
def sahi_tiles(spark, sf):
    sizes = spark.createDataFrame([(1920, 1080), (640, 640), (700, 1300), (300, 200), (641, 2560)], "width int, height int")
    return tiles.tile_frames(sizes, (640, 640), 0.25)


@query(with_views(snms("cand", "k", "video_id, frame", "score", 0.5) + " SELECT video_id, frame, cand_id, CAST(nms_rank AS INTEGER) AS nms_rank FROM k", "cand", recursive=True))
def nms(spark, sf):
    return select.nms(fx.cand(spark, sf), KEYS, "score", 0.5, "cand_id").select(*KEYS, "cand_id", F.col("_nms_rank").alias("nms_rank"))


@query(with_views("days AS (SELECT *, frame // 24 AS day FROM cand)," + snms("days", "k", "video_id, day", "score", 0.3) + " SELECT video_id, day, cand_id, CAST(nms_rank AS INTEGER) AS nms_rank FROM k", "cand", recursive=True))
def nms_dense(spark, sf):
    """All boxes of 24 frames as one crowded frame."""
    days = fx.cand(spark, sf).withColumn("day", F.floor(F.col("frame") / 24).cast("int"))
    return select.nms_dense(days, ["video_id", "day"], "score", 0.3, "cand_id").select("video_id", "day", "cand_id", F.col("_nms_rank").alias("nms_rank"))


@query(with_views(f"SELECT a.video_id, a.frame, a.cand_id, b.cand_id AS other_id, round({siou('a.', 'b.')}, 6) AS iou FROM cand a JOIN cand b ON a.video_id = b.video_id AND a.frame = b.frame AND a.cand_id < b.cand_id WHERE {siou('a.', 'b.')} > 0.3", "cand"))
def iou_pairs(spark, sf):
    return select.overlapping_pairs(fx.cand(spark, sf), KEYS, "cand_id", 0.3).withColumns({"iou": quick6("iou")})


_TOP = "SELECT {0}, cand_id, round(score, 6) AS score FROM cand QUALIFY row_number() OVER (PARTITION BY {0} ORDER BY score DESC, cand_id) <= {1}"


@query(with_views(_TOP.format("video_id, frame", 2), "cand"))
def topk_per_frame(spark, sf):
    return select.top_k(fx.cand(spark, sf), KEYS, "score", 2, "cand_id").select(*KEYS, "cand_id", *r6("score"))


@query(with_views(_TOP.format("video_id", 30), "cand"))
def global_topk(spark, sf):
    return select.top_k(fx.cand(spark, sf), ["video_id"], "score", 30, "cand_id").select("video_id", "cand_id", *r6("score"))


@query(with_views("SELECT video_id, frame, cand_id FROM cand QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY cand_id) <= 3", "cand"))
def cap_in_model_order(spark, sf):
    """A cap without sorting: the model's own order decides."""
    return select.first_rows(fx.cand(spark, sf), KEYS, [F.col("cand_id")], 3).select(*KEYS, "cand_id")


@query(with_views("SELECT video_id, frame, cand_id FROM cand WHERE (x2 - x1) * (y2 - y1) >= 2500 QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY score DESC, cand_id) <= 4", "cand"))
def cap_candidates(spark, sf):
    return select.top_k(fx.cand(spark, sf).where(bx.area(bx.box()) >= 2500), KEYS, "score", 4, "cand_id").select(*KEYS, "cand_id")


@query(with_views("SELECT video_id, frame, cand_id FROM cand QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY score DESC, cand_id) = 1", "cand"))
def best_per_frame(spark, sf):
    return select.first_max(fx.cand(spark, sf), KEYS, "score", "cand_id").select(*KEYS, "cand_id")


# ---- sets and joins ---------------------------------------------------------------------------------------------


@query(with_views("SELECT video_id, frame FROM pred UNION SELECT video_id, frame FROM gt", "pred", "gt"))
def temporal_union(spark, sf):
    return fx.pred(spark, sf).select(*KEYS).union(fx.gt(spark, sf).select(*KEYS)).distinct()


@query(with_views("SELECT video_id, frame FROM pred INTERSECT SELECT video_id, frame FROM gt", "pred", "gt"))
def frame_overlap(spark, sf):
    return fx.pred(spark, sf).select(*KEYS).intersect(fx.gt(spark, sf).select(*KEYS))


@query(with_views("SELECT cand_id, video_id, round(list_sum(feature), 6) AS total FROM cand_feat", "cand_feat"))
def cand_features(spark, sf):
    return fx.cand_feat(spark, sf).select("cand_id", "video_id", F.round(vec.total(F.col("feature")), 6).alias("total"))


# ---- prototypes and matching ------------------------------------------------------------------------------------

_REF_MEAN = "rm AS (SELECT video_id, ref_id, pos, avg(x) AS x FROM (SELECT video_id, ref_id, unnest(feature) AS x, generate_subscripts(feature, 1) - 1 AS pos FROM refs) GROUP BY ALL), rr AS (SELECT video_id, ref_id, max(mask_ratio) AS mr FROM refs GROUP BY ALL)"
_PROTO0 = _REF_MEAN + ", p0 AS (SELECT video_id, pos, sum(x * (mr + 1e-4)) / sum(mr + 1e-4) AS x FROM rm JOIN rr USING (video_id, ref_id) GROUP BY ALL), pn AS (SELECT video_id, sqrt(sum(x * x)) AS n FROM p0 GROUP BY video_id), proto AS (SELECT video_id, list(x / n ORDER BY pos) AS vec FROM p0 JOIN pn USING (video_id) GROUP BY video_id)"


@query(with_views(_REF_MEAN + " SELECT video_id, ref_id, CAST(pos AS INTEGER) AS pos, round(x, 6) AS value FROM rm", "refs"))
def ref_mean(spark, sf):
    return exploded(prototype.ref_means(fx.refs(spark, sf)), ["video_id", "ref_id"], "feature")


@query(with_views(_PROTO0 + " SELECT video_id, CAST(pos AS INTEGER) AS pos, round(x / n, 6) AS value FROM p0 JOIN pn USING (video_id)", "refs"))
def prototype_mean(spark, sf):
    return exploded(prototype.fuse(prototype.ref_means(fx.refs(spark, sf))), ["video_id"], "vec")


@query(with_views(_REF_MEAN + ", p0 AS (SELECT video_id, pos, max(x) AS x FROM rm GROUP BY ALL), pn AS (SELECT video_id, sqrt(sum(x * x)) AS n FROM p0 GROUP BY video_id) SELECT video_id, CAST(pos AS INTEGER) AS pos, round(x / n, 6) AS value FROM p0 JOIN pn USING (video_id)", "refs"))
def prototype_max(spark, sf):
    return exploded(prototype.fuse(prototype.ref_means(fx.refs(spark, sf)), "max"), ["video_id"], "vec")


#: The first axis in SQL: the references' Gram matrix about their mean, squared until one direction is left.
_AXIS = (
    _REF_MEAN
    + """, mid AS (SELECT *, x - avg(x) OVER (PARTITION BY video_id, pos) AS c FROM rm),
    dots AS (SELECT a.video_id, a.ref_id AS i, list(a.d ORDER BY a.j) AS row FROM (SELECT a.video_id, a.ref_id, b.ref_id AS j, sum(a.c * b.c) AS d FROM mid a JOIN mid b USING (video_id, pos) GROUP BY ALL) a GROUP BY ALL),
    g AS (SELECT video_id, list(row ORDER BY i) AS g, sum(row[i + 1]) AS trace FROM dots GROUP BY video_id),
    pow AS (SELECT video_id, 0 AS k, list_transform(g, lambda r: list_transform(r, lambda v: v / trace)) AS m FROM g UNION ALL
      SELECT video_id, k + 1, list_transform(q, lambda r: list_transform(r, lambda v: v / list_max(list_transform(q, lambda s: list_max(list_transform(s, lambda t: abs(t))))))) FROM
      (SELECT video_id, k, list_transform(m, lambda r: list_transform(m, lambda s: list_dot_product(r, s))) AS q FROM pow WHERE k < 24)),
    top AS (SELECT video_id, list_transform(m, lambda r: r[big]) AS u FROM (SELECT *, list_position(list_transform(range(1, len(m) + 1), lambda i: m[i][i]), list_max(list_transform(range(1, len(m) + 1), lambda i: m[i][i]))) AS big FROM pow WHERE k = 24)),
    ax AS (SELECT video_id, pos, sum(c * u[ref_id + 1]) AS x FROM mid JOIN top USING (video_id) GROUP BY ALL),
    sized AS (SELECT video_id, sqrt(sum(x * x)) * sign(arg_max(x, abs(x))) AS n FROM ax GROUP BY video_id)"""
)


@query(with_views(_AXIS + " SELECT video_id, CAST(pos AS INTEGER) AS pos, round(x / n, 6) AS value FROM ax JOIN sized USING (video_id)", "refs", recursive=True))
def prototype_pca(spark, sf):
    return exploded(prototype.fuse(prototype.ref_means(fx.refs(spark, sf)), "pca"), ["video_id"], "vec")


@query(with_views("""p AS (SELECT label, pos, x - avg(x) OVER (PARTITION BY label, pos) AS c FROM (SELECT label, vec_id, unnest(feature) AS x, generate_subscripts(feature, 1) AS pos FROM emb)),
    mom AS (SELECT label, pos, sum(c * c) AS s, count(*) AS n FROM p GROUP BY ALL) SELECT label, any_value(n) AS n, round(sum(s), 6) AS total FROM mom GROUP BY label""", "emb"))
def axis_of_label(spark, sf):
    """Each label's axis over all its embeddings, checked by the variance it must stand for: total = along / explained."""
    e = fx.embeddings(spark, sf)
    a = pca.principal_axis(e, ["label"], "feature")
    mean = vec.elementwise(e, ["label"], "feature", "_mean")
    off = e.join(F.broadcast(a.join(mean, "label")), "label").withColumn("_t", vec.dot(F.zip_with("feature", "_mean", lambda x, y: x - y), F.col("vec")))
    return off.groupBy("label", "n").agg(F.round(F.sum(F.col("_t") * F.col("_t")) / F.first("explained"), 6).alias("total"))


def _proto(spark, sf):
    return prototype.fuse(prototype.ref_means(fx.refs(spark, sf)))


_SCORED = _PROTO0 + ", sc AS (SELECT c.*, list_dot_product(feature, vec) AS sim FROM cand_feat c JOIN proto USING (video_id))"


@query(with_views(_SCORED + " SELECT cand_id, video_id, round(sim, 6) AS sim FROM sc", "refs", "cand_feat"))
def match_single(spark, sf):
    return match.score(fx.cand_feat(spark, sf), _proto(spark, sf)).select("cand_id", "video_id", *r6("sim"))


_LISTS = _REF_MEAN + ", rl AS (SELECT video_id, ref_id, list(x ORDER BY pos) AS vec FROM rm GROUP BY ALL)"


@query(with_views(_LISTS + " SELECT cand_id, c.video_id, round(avg(list_dot_product(feature, vec)), 6) AS sim FROM cand_feat c JOIN rl USING (video_id) GROUP BY cand_id, c.video_id", "refs", "cand_feat"))
def match_multi_ref(spark, sf):
    return match.score_multi(fx.cand_feat(spark, sf), match.ref_list(prototype.ref_means(fx.refs(spark, sf)))).select("cand_id", "video_id", *r6("sim"))


@query(with_views(_SCORED + " SELECT video_id, count(*) AS n, round(min(sim), 6) AS min, round(quantile_cont(sim, 0.5), 6) AS p50, round(avg(sim), 6) AS mean, round(max(sim), 6) AS max FROM sc GROUP BY video_id", "refs", "cand_feat"))
def score_stats(spark, sf):
    return match.stats(match.score(fx.cand_feat(spark, sf), _proto(spark, sf))).select("video_id", "n", *r6("min", "p50", "mean", "max"))


_BARS = "SELECT video_id, least(greatest(avg(sim) + {} * stddev_pop(sim), 0.05), max(sim)) AS threshold FROM {} GROUP BY video_id"


@query(with_views(_SCORED + f", b AS ({_BARS.format(1.5, 'sc')}) SELECT video_id, round(threshold, 6) AS threshold FROM b", "refs", "cand_feat"))
def adaptive_threshold(spark, sf):
    return match.thresholds(match.score(fx.cand_feat(spark, sf), _proto(spark, sf))).select("video_id", *r6("threshold"))


@query(with_views(_SCORED + f", b AS ({_BARS.format(1.5, 'sc')}) SELECT v.video_id, round(coalesce(threshold, 0.55), 6) AS threshold FROM (SELECT DISTINCT video_id FROM cand) v LEFT JOIN b USING (video_id)", "refs", "cand_feat"))
def effective_threshold(spark, sf):
    bars = match.thresholds(match.score(fx.cand_feat(spark, sf), _proto(spark, sf)))
    return match.effective(fx.cand(spark, sf), bars).select("video_id", *r6("threshold"))


@query(with_views(_SCORED + " SELECT video_id, round(max(sim), 6) AS max, round(avg(sim), 6) AS mean, round(quantile_cont(sim, 0.95), 6) AS p95, count(*) FILTER (sim > 0.1) AS above_0, count(*) FILTER (sim > 0.2) AS above_1, count(*) FILTER (sim > 0.3) AS above_2 FROM sc GROUP BY video_id", "refs", "cand_feat"))
def threshold_counts(spark, sf):
    return match.threshold_counts(match.score(fx.cand_feat(spark, sf), _proto(spark, sf)), [0.1, 0.2, 0.3]).withColumns({c: F.round(c, 6) for c in ("max", "mean", "p95")})


def _sround(i: int) -> str:
    """A round of refinement from proto{i} to proto{i + 1} (video_id, vec, updated, going)."""
    return f"""
    s{i} AS (SELECT c.*, list_dot_product(feature, vec) AS sim FROM cand_feat c JOIN proto{i} USING (video_id)),
    bar{i} AS (SELECT video_id, greatest(quantile_cont(sim, 0.9), 0.15) AS bar FROM s{i} GROUP BY video_id),
    best{i} AS (SELECT s.* FROM s{i} s JOIN bar{i} USING (video_id) WHERE sim >= bar),
    cnt{i} AS (SELECT video_id, count(*) AS n FROM best{i} GROUP BY video_id HAVING count(*) >= 2),
    mean{i} AS (SELECT video_id, pos, avg(x) AS x FROM (SELECT video_id, unnest(feature) AS x, generate_subscripts(feature, 1) - 1 AS pos FROM best{i}) WHERE video_id IN (SELECT video_id FROM cnt{i}) GROUP BY ALL),
    mlist{i} AS (SELECT video_id, list(x ORDER BY pos) AS m FROM mean{i} GROUP BY video_id),
    unit{i} AS (SELECT video_id, list_transform(m, lambda x: x / (sqrt(list_dot_product(m, m)) + 1e-8)) AS m FROM mlist{i}),
    blend{i} AS (SELECT p.video_id, list_transform(list_zip(vec, m), lambda q: 0.7 * q[1] + 0.3 * q[2]) AS v FROM proto{i} p JOIN unit{i} USING (video_id) WHERE going),
    proto{i + 1} AS (SELECT p.video_id, CASE WHEN v IS NOT NULL THEN list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8)) ELSE vec END AS vec, updated OR v IS NOT NULL AS updated, v IS NOT NULL AS going FROM proto{i} p LEFT JOIN blend{i} USING (video_id))"""


_REFINED = _PROTO0 + ", proto0 AS (SELECT video_id, vec, false AS updated, true AS going FROM proto), " + _sround(0) + ", " + _sround(1)
_FINAL = _REFINED + ", sc AS (SELECT c.*, list_dot_product(feature, vec) AS sim FROM cand_feat c JOIN proto2 USING (video_id))"


@query(with_views(_REFINED + " SELECT video_id, updated, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS pos, round(unnest(vec), 6) AS value FROM proto2", "refs", "cand_feat"))
def dynamic_prototype(spark, sf):
    return exploded(match.refine(fx.cand_feat(spark, sf), _proto(spark, sf))[1], ["video_id", "updated"], "vec")


@query(with_views(_REFINED + " SELECT video_id, CASE WHEN updated THEN 'dynamic' ELSE 'base' END AS source, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, round(unnest(v), 6) AS value FROM (SELECT a.video_id, updated, CASE WHEN updated THEN b.vec ELSE a.vec END AS v FROM proto a JOIN proto2 b USING (video_id))", "refs", "cand_feat"))
def best_prototype(spark, sf):
    base = _proto(spark, sf)
    refined = match.refine(fx.cand_feat(spark, sf), base)[1].where("updated")
    return exploded(prototype.best_of(base, refined), ["video_id", "source"], "vec")


def _mround(i: int) -> str:
    """A round of refinement of lists of vectors: their mean's unit vector joins the list."""
    return f"""
    ms{i} AS (SELECT c.video_id, c.feature, list_avg(list_transform(p.vecs, lambda v: list_dot_product(c.feature, v))) AS sim FROM cand_feat c JOIN m{i} p USING (video_id)),
    mbar{i} AS (SELECT video_id, greatest(quantile_cont(sim, 0.9), 0.15) AS bar FROM ms{i} GROUP BY video_id),
    mbest{i} AS (SELECT s.* FROM ms{i} s JOIN mbar{i} USING (video_id) WHERE sim >= bar),
    mcnt{i} AS (SELECT video_id FROM mbest{i} GROUP BY video_id HAVING count(*) >= 2),
    mpos{i} AS (SELECT video_id, pos, avg(x) AS x FROM (SELECT video_id, unnest(feature) AS x, generate_subscripts(feature, 1) - 1 AS pos FROM mbest{i}) WHERE video_id IN (SELECT video_id FROM mcnt{i}) GROUP BY ALL),
    mvec{i} AS (SELECT video_id, list(x ORDER BY pos) AS v FROM mpos{i} GROUP BY video_id),
    m{i + 1} AS (SELECT p.video_id, CASE WHEN going AND v IS NOT NULL THEN list_append(vecs, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8))) ELSE vecs END AS vecs, updated OR (going AND v IS NOT NULL) AS updated, going AND v IS NOT NULL AS going FROM m{i} p LEFT JOIN mvec{i} USING (video_id))"""


@query(with_views(_LISTS + ", m0 AS (SELECT video_id, list(vec ORDER BY ref_id) AS vecs, false AS updated, true AS going FROM rl GROUP BY video_id), " + _mround(0) + ", " + _mround(1) + " SELECT video_id, updated, CAST(len(vecs) AS INTEGER) AS n_vecs, round(list_sum(vecs[-1]), 6) AS last_total FROM m2", "refs", "cand_feat"))
def dynamic_multi_ref(spark, sf):
    """The list of vectors grows by one a round."""
    protos = match.refine(fx.cand_feat(spark, sf), match.ref_list(prototype.ref_means(fx.refs(spark, sf))), multi=True)[1]
    return protos.select("video_id", "updated", F.size("vecs").alias("n_vecs"), F.round(vec.total(F.element_at("vecs", -1)), 6).alias("last_total"))


_DETECT = _FINAL + f", b AS ({_BARS.format(1.5, 'sc')}), kept AS (SELECT sc.video_id, frame, cand_id, x1, y1, x2, y2, score, sim FROM sc JOIN b USING (video_id) WHERE sim >= threshold QUALIFY row_number() OVER (PARTITION BY sc.video_id ORDER BY sim DESC, cand_id) <= 100)," + snms("kept", "d", "video_id, frame", "sim", 0.5)
_MATCHED = Config.model_validate({"matching": {"adaptive": True, "adaptive_z": 1.5, "global_topk": 100, "topk_per_keyframe": 2}})


@query(with_views(_DETECT + " SELECT video_id, frame, CAST(nms_rank AS INTEGER) AS det_rank, cand_id, round(score, 6) AS score, round(sim, 6) AS similarity, 'detect' AS source FROM d WHERE nms_rank <= 2", "refs", "cand_feat", recursive=True))
def stage3_detections(spark, sf):
    found = composite.detections(fx.cand_feat(spark, sf), prototype.ref_means(fx.refs(spark, sf)), _MATCHED)[0]
    return found.select(*KEYS, "det_rank", "cand_id", *r6("score", "similarity"), "source")


# ---- candidates -------------------------------------------------------------------------------------------------

_RAW = "raw AS (SELECT cand_id AS prop_id, video_id, frame, CASE cand_id % 2 WHEN 0 THEN CAST(1.0 AS DOUBLE) ELSE 0.75 END AS scale, score, x1 + 480 AS x1, y1 + 360 AS y1, x2 + 480 AS x2, y2 + 360 AS y2 FROM cand WHERE frame % 4 = 0)"
_PROPS = _RAW + "," + snms("raw", "rn", "video_id, frame, scale", "score", 0.5, "prop_id") + ", props AS (SELECT * EXCLUDE (nms_rank) FROM rn WHERE (x2 - x1) * (y2 - y1) >= 2000 QUALIFY row_number() OVER (PARTITION BY video_id, frame, scale ORDER BY score DESC, prop_id) <= 3)"


def _raw(spark, sf):
    c = tiles.keyframes(fx.cand(spark, sf), 4).withColumn("scale", F.when(F.col("cand_id") % 2 == 0, 1.0).otherwise(0.75))
    return c.select(F.col("cand_id").alias("prop_id"), *KEYS, "scale", *B, "score", F.lit(480).alias("tx1"), F.lit(360).alias("ty1"))


@query(with_views(_PROPS + " SELECT video_id, frame, scale, prop_id, x1, y1, x2, y2 FROM props", "cand", recursive=True))
def proposals(spark, sf):
    return composite.proposals(_raw(spark, sf), True, min_area=2000, most=3).select(*KEYS, "scale", "prop_id", *B)


_CANDS = _PROPS + ", scaled AS (SELECT video_id, frame, prop_id AS cand_id, x1 / scale AS x1, y1 / scale AS y1, x2 / scale AS x2, y2 / scale AS y2, score, 'candidate' AS source FROM props)," + snms("scaled", "c1", "video_id, frame", "score", 0.5) + ", c1c AS (SELECT * EXCLUDE (nms_rank) FROM c1 WHERE nms_rank <= 5)"
_DENSE = (
    ", keys AS (SELECT DISTINCT video_id, frame FROM raw), few AS (SELECT video_id, frame FROM keys ANTI JOIN (SELECT video_id, frame FROM c1c GROUP BY ALL HAVING count(*) >= 2) USING (video_id, frame)), dense AS (SELECT video_id, frame, cand_id + 10000000 AS cand_id, x1 + 300 AS x1, y1 + 200 AS y1, x2 + 300 AS x2, y2 + 200 AS y2, score / 2 AS score, 'candidate_dense' AS source FROM cand SEMI JOIN few USING (video_id, frame) QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY score / 2 DESC, cand_id) <= 2), both_ AS (SELECT * FROM c1c UNION ALL BY NAME SELECT * FROM dense),"
    + snms("both_", "c2", "video_id, frame", "score", 0.5)
)
_CAND_OUT = "SELECT video_id, frame, cand_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(score, 6) AS score, source FROM "


@query(with_views(_CANDS + " " + _CAND_OUT + "c1c", "cand", recursive=True))
def stage2_candidates(spark, sf):
    props = composite.proposals(_raw(spark, sf), True, min_area=2000, most=3)
    return composite.candidates(props, most=5).select(*KEYS, "cand_id", *r6("x1", "y1", "score"), "source")


@query(with_views(_CANDS + _DENSE + " " + _CAND_OUT + "c2 WHERE nms_rank <= 5", "cand", recursive=True))
def dense_merge(spark, sf):
    """Keyframes with fewer than two candidates get boxes of the dense scan."""
    props = composite.proposals(_raw(spark, sf), True, min_area=2000, most=3)
    dense = fx.cand(spark, sf).select(*KEYS, (F.col("cand_id") + 10_000_000).alias("cand_id"), *[(F.col(c) + d).alias(c) for c, d in zip(B, (300, 200, 300, 200))], (F.col("score") / 2).alias("score"))
    return composite.candidates(props, dense, _raw(spark, sf), most=5, trigger=2, dense_most=2).select(*KEYS, "cand_id", *r6("x1", "y1", "score"), "source")


@query(with_views("""c AS (SELECT tile, gx, gy, sim, tile * 256 + gy * 16 + gx AS id FROM patches WHERE sim >= 0.3),
  e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.tile = b.tile AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1),
  reach AS (SELECT id AS a, id AS b FROM c UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
  lab AS (SELECT a AS id, min(b) AS blob FROM reach GROUP BY a)
  SELECT tile, CAST(min(gx) * 14 AS DOUBLE) AS x1, CAST(min(gy) * 14 AS DOUBLE) AS y1, CAST((max(gx) + 1) * 14 AS DOUBLE) AS x2, CAST((max(gy) + 1) * 14 AS DOUBLE) AS y2, count(*) AS n_patches, round(max(sim), 6) AS score
  FROM c JOIN lab USING (id) GROUP BY tile, blob HAVING count(*) >= 2""", "patches", recursive=True))
def dense_blobs(spark, sf):
    found = blobs.blob_boxes(blobs.blobs(fx.patches(spark, sf), ["tile"], 0.3))
    return found.select("tile", *B, "n_patches", *r6("score"))


@query("""WITH RECURSIVE c AS (SELECT CAST(event_id % 256 AS BIGINT) AS gx, CAST(event_id // 256 AS BIGINT) AS gy, value / 500 AS sim, event_id AS id FROM events WHERE value / 500 >= 0.3),
  d AS (SELECT unnest([{'x': 1, 'y': 0}, {'x': -1, 'y': 0}, {'x': 0, 'y': 1}, {'x': 0, 'y': -1}, {'x': 1, 'y': 1}, {'x': -1, 'y': -1}, {'x': 1, 'y': -1}, {'x': -1, 'y': 1}]) AS s),
  e AS (SELECT a.id AS a, b.id AS b FROM (SELECT id, gx + s.x AS gx, gy + s.y AS gy FROM c, d) a JOIN c b USING (gx, gy)),
  reach AS (SELECT id AS a, id AS b FROM c UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
  lab AS (SELECT a AS id, min(b) AS blob FROM reach GROUP BY a)
  SELECT blob // 256 AS first_gy, blob % 256 AS first_gx, min(gx) AS gx1, min(gy) AS gy1, max(gx) AS gx2, max(gy) AS gy2, count(*) AS n_patches, round(max(sim), 6) AS score FROM c JOIN lab USING (id) GROUP BY blob HAVING count(*) >= 2""")
def blobs_across_tiles(spark, sf):
    """The events as one image of 256 columns, labelled in tiles of 32 x 32 cells."""
    grid = fx.read(spark, sf, "events").select(F.lit(0).alias("image"), (F.col("event_id") % 256).alias("gx"), F.expr("event_id div 256").alias("gy"), (F.col("value") / 500).alias("sim"))
    found = blobs.blobs_tiled(grid, ["image"], 0.3, side=32)
    return found.select(F.col("blob.gy").alias("first_gy"), F.col("blob.gx").alias("first_gx"), "gx1", "gy1", "gx2", "gy2", "n_patches", F.round("max_sim", 6).alias("score"))


# ---- tubes ------------------------------------------------------------------------------------------------------

_EMA = "ema AS (SELECT video_id, frame, score, " + ", ".join(f"list_reduce(list({c}) OVER w, lambda s, x: 0.4 * s + 0.6 * x) AS {c}" for c in B) + " FROM {} WINDOW w AS (PARTITION BY video_id ORDER BY frame ROWS UNBOUNDED PRECEDING))"
_FILL = "nxt AS (SELECT *, lead(frame) OVER v AS nf, lead(score) OVER v AS ns, " + ", ".join(f"lead({c}) OVER v AS n{c}" for c in B) + " FROM {} WINDOW v AS (PARTITION BY video_id ORDER BY frame)), stp AS (SELECT *, CASE WHEN nf - frame - 1 BETWEEN 1 AND 3 THEN nf - frame - 1 ELSE 0 END AS gap FROM nxt), fil AS (SELECT video_id, CAST(frame + j AS INTEGER) AS frame, " + ", ".join(f"CASE WHEN j = 0 THEN {c} ELSE {c} + j / (gap + 1) * (n{c} - {c}) END AS {c}" for c in B) + ", CASE WHEN j = 0 THEN score ELSE (score + ns) / 2 END AS score FROM (SELECT *, unnest(range(0, gap + 1)) AS j FROM stp))"
_SEG = "seg AS (SELECT *, count(*) OVER (PARTITION BY video_id, isl) AS len FROM (SELECT *, frame - row_number() OVER (PARTITION BY video_id ORDER BY frame) AS isl FROM {}))"
_TUBE_OUT = "SELECT video_id, frame, " + sr6(*B, "score") + " FROM "


def _tube_out(df):
    return df.select(*KEYS, *r6(*B, "score"))


@query(with_views(_EMA.format("pred") + " " + _TUBE_OUT + "ema", "pred"))
def ema_smooth(spark, sf):
    return _tube_out(tube.ema(fx.pred(spark, sf), 0.6))


@query(with_views(_FILL.format("pred") + " " + _TUBE_OUT + "fil", "pred"))
def gap_fill(spark, sf):
    return _tube_out(tube.fill_gaps(fx.pred(spark, sf), 3))


@query(with_views(_SEG.format("pred") + " SELECT video_id, frame, CAST(dense_rank() OVER (PARTITION BY video_id ORDER BY isl) AS INTEGER) AS segment, CAST(len AS INTEGER) AS segment_len FROM seg", "pred"))
def segments(spark, sf):
    return tube.segments(fx.pred(spark, sf)).select(*KEYS, "segment", "segment_len")


@query(with_views(_SEG.format("pred") + " " + _TUBE_OUT + "seg WHERE len >= 3", "pred"))
def tube_final(spark, sf):
    return _tube_out(tube.drop_short(fx.pred(spark, sf), 3))


_THIN = "thin AS (SELECT * FROM pred WHERE score >= 0.05), "


@query(with_views(_THIN + _EMA.format("thin") + ", " + _FILL.format("ema") + ", " + _SEG.format("fil") + " " + _TUBE_OUT + "seg WHERE len >= 2", "pred"))
def stage5_tube(spark, sf):
    return _tube_out(composite.final(fx.pred(spark, sf).where("score >= 0.05"), Config()))


# ---- tracking ---------------------------------------------------------------------------------------------------

_TRACK_IN = """v AS (SELECT CAST(video_id AS BIGINT) AS video_id, CAST(frame AS INTEGER) AS frame FROM (SELECT unnest(range(0, 10)) AS video_id), (SELECT unnest(range(0, 720)) AS frame)),
  ti AS (SELECT v.video_id, v.frame, (v.frame + v.video_id) % 37 <> 0 AS has, CAST(200 + v.frame % 700 AS DOUBLE) AS tx1, CAST(100 + v.frame % 300 AS DOUBLE) AS ty1, ((v.frame * 31 + v.video_id * 17) % 100) / 100.0 AS conf, ((v.frame * 13 + v.video_id * 7) % 100) / 100.0 AS sim,
    CASE WHEN v.frame % 8 = 0 THEN p.x1 END AS dx1, CASE WHEN v.frame % 8 = 0 THEN p.y1 END AS dy1, CASE WHEN v.frame % 3 = 0 THEN p.x1 END AS rx1, CASE WHEN v.frame % 3 = 0 THEN p.y1 END AS ry1 FROM v LEFT JOIN pred p USING (video_id, frame)),
  base AS (SELECT *, CASE WHEN dx1 IS NOT NULL THEN 'det' END AS d FROM ti),
  st AS (
    SELECT video_id, -1 AS frame, false AS active, 0 AS age, 0 AS since, CAST(NULL AS DOUBLE) AS x1, CAST(NULL AS DOUBLE) AS y1, '' AS source FROM base WHERE frame = 0
    UNION ALL
    SELECT video_id, frame, out IN ('det', 'track', 'red'), CASE WHEN out = 'track' THEN age + 1 ELSE 0 END, CASE WHEN out = 'track' THEN CASE WHEN due THEN 0 ELSE since + 1 END ELSE 0 END,
      CASE out WHEN 'det' THEN dx1 WHEN 'track' THEN tx1 WHEN 'red' THEN rx1 END, CASE out WHEN 'det' THEN dy1 WHEN 'track' THEN ty1 WHEN 'red' THEN ry1 END, CASE out WHEN 'track' THEN 'track' WHEN 'none' THEN 'none' ELSE 'detect' END
    FROM (SELECT *, since + 1 >= 5 AS due, CASE WHEN d IS NOT NULL THEN 'det' WHEN NOT active THEN 'none' WHEN has AND conf >= 0.40 AND age + 1 <= 30 AND (since + 1 < 5 OR sim >= 0.55) THEN 'track' WHEN rx1 IS NOT NULL THEN 'red' ELSE 'none' END AS out
      FROM (SELECT b.*, s.active, s.age, s.since FROM st s JOIN base b ON b.video_id = s.video_id AND b.frame = s.frame + 1)))"""


@query(with_views(_TRACK_IN + " SELECT video_id, frame, x1, y1, source FROM st WHERE frame >= 0", "pred", recursive=True))
def track_sm(spark, sf):
    return track.track(fx.track_inputs(spark, sf)).select(*KEYS, "x1", "y1", "source")


@query(with_views(_TRACK_IN + " SELECT video_id, count(*) AS n_frames, count(x1) AS n_present, count(*) FILTER (source = 'detect') AS n_detect, count(*) FILTER (source = 'track') AS n_track, count(*) FILTER (source = 'none') AS n_none FROM st WHERE frame >= 0 GROUP BY video_id", "pred", recursive=True))
def track_coverage(spark, sf):
    return track.coverage(track.track(fx.track_inputs(spark, sf)))


@query(with_views("v AS (SELECT unnest(range(0, 10)) AS video_id), f AS (SELECT unnest(range(0, 720)) AS frame) SELECT CAST(v.video_id AS BIGINT) AS video_id, CAST(f.frame AS INTEGER) AS frame, p.x1, CASE WHEN p.x1 IS NULL THEN 'none' ELSE 'detect' END AS source FROM v CROSS JOIN f LEFT JOIN (SELECT * FROM pred WHERE frame % 3 = 0) p ON p.video_id = v.video_id AND p.frame = f.frame", "pred"))
def track_without_tracker(spark, sf):
    return track.track(fx.track_inputs(spark, sf), track.Rules(tracker=False)).select(*KEYS, "x1", "source")


# ---- evaluation -------------------------------------------------------------------------------------------------


def _sst(pred: str, gt: str, extra: str = "") -> str:
    keys = "video_id, frame" + extra
    return f"fi AS (SELECT {keys}, CASE WHEN p.x1 IS NOT NULL AND g.x1 IS NOT NULL THEN {siou('p.', 'g.')} ELSE 0.0 END AS iou FROM {pred} p FULL JOIN {gt} g USING ({keys})), st AS (SELECT video_id{extra}, avg(iou) AS st_iou, count(*) AS n_union FROM fi GROUP BY ALL)"


@query(with_views(_sst("pred", "gt") + " SELECT video_id, round(st_iou, 6) AS st_iou, n_union FROM st", "pred", "gt"))
def st_iou_per_video(spark, sf):
    return evaluate.st_iou(fx.pred(spark, sf), fx.gt(spark, sf)).select("video_id", *r6("st_iou"), "n_union")


@query(with_views(_sst("pred", "gt") + " SELECT round(coalesce(avg(coalesce(st_iou, 0)), 0), 6) AS mean_st_iou, count(*) AS n_videos FROM (SELECT DISTINCT video_id FROM gt) LEFT JOIN st USING (video_id)", "pred", "gt"))
def st_iou_mean(spark, sf):
    return evaluate.mean_st_iou(fx.pred(spark, sf), fx.gt(spark, sf)).select(*r6("mean_st_iou"), "n_videos")


@query(with_views(_sst("pred", "gt") + ", e AS (SELECT video_id, coalesce(st_iou, 0) AS st_iou FROM (SELECT DISTINCT video_id FROM gt) LEFT JOIN st USING (video_id)) SELECT video_id || ': ' || printf('%.4f', st_iou) AS line FROM e UNION ALL SELECT 'mean ST-IoU: ' || printf('%.4f', avg(st_iou)) || ' over ' || count(*) FROM e", "pred", "gt"))
def evaluation_report(spark, sf):
    """A line a video, in order, and the mean."""
    return models.report(evaluate.evaluate(fx.pred(spark, sf), fx.gt(spark, sf)))


@query(with_views(f"keys AS (SELECT DISTINCT video_id, frame FROM cand WHERE frame % 8 = 0), on_ AS (SELECT g.* FROM gt g SEMI JOIN keys USING (video_id, frame)), b AS (SELECT g.video_id, g.frame, coalesce(max(CASE WHEN c.x1 IS NOT NULL THEN {siou('g.', 'c.')} END), 0.0) AS best FROM on_ g LEFT JOIN (SELECT * FROM cand WHERE event_type IN ('view', 'click')) c ON c.video_id = g.video_id AND c.frame = g.frame GROUP BY ALL) SELECT n.video_id, n_gt, count(best) AS on_keyframe, round(coalesce(avg(best), 0), 6) AS mean_best, round(coalesce(max(best), 0), 6) AS max_best, count(*) FILTER (best >= 0.3) AS hits_03, count(*) FILTER (best >= 0.5) AS hits_05 FROM (SELECT video_id, count(*) AS n_gt FROM gt GROUP BY video_id) n LEFT JOIN b USING (video_id) GROUP BY n.video_id, n_gt", "cand", "gt"))
def stage2_recall(spark, sf):
    c = fx.cand(spark, sf)
    return evaluate.recall(c.where(F.col("event_type").isin("view", "click")), fx.gt(spark, sf), tiles.keyframes(c, 8)).withColumns({k: F.round(k, 6) for k in ("mean_best", "max_best")})


@query(with_views(f"d AS (SELECT * FROM cand WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY score DESC, cand_id) = 1), s AS (SELECT d.video_id, d.frame, d.score AS similarity, {siou('d.', 'g.')} AS iou FROM d JOIN gt g USING (video_id, frame)), w AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY iou, frame) AS a, row_number() OVER (PARTITION BY video_id ORDER BY iou DESC, frame DESC) AS z FROM s) SELECT video_id, max(frame) FILTER (a = 1) AS worst_frame, round(max(iou) FILTER (a = 1), 6) AS worst_iou, round(max(similarity) FILTER (a = 1), 6) AS worst_similarity, max(frame) FILTER (z = 1) AS best_frame, round(max(iou) FILTER (z = 1), 6) AS best_iou, round(max(similarity) FILTER (z = 1), 6) AS best_similarity FROM w GROUP BY video_id", "cand", "gt"))
def best_worst_match(spark, sf):
    d = fx.cand(spark, sf).where("event_type = 'view'").withColumn("similarity", F.col("score"))
    found = evaluate.best_and_worst(d, fx.gt(spark, sf), "cand_id")
    return found.withColumns({f"{k}_{f}": F.round(f"{k}_{f}", 6) for k in ("worst", "best") for f in ("iou", "similarity")})


@query(with_views(_PROTO0 + ", smp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS rn FROM gt) WHERE (rn - 1) % 5 = 0), crop AS (SELECT s.video_id, list_dot_product(e.feature, p.vec) AS sim FROM smp s JOIN emb e ON e.vec_id = (s.frame * 3 + s.video_id) % (SELECT nv FROM nv) JOIN proto p ON p.video_id = s.video_id) SELECT video_id, count(*) AS n, round(min(sim), 6) AS min, round(quantile_cont(sim, 0.5), 6) AS p50, round(avg(sim), 6) AS mean, round(max(sim), 6) AS max FROM crop GROUP BY video_id", "gt", "refs", "nv"))
def gt_ceiling(spark, sf):
    """Similarity of ground-truth crops, every fifth frame of a video that has one."""
    crops = frame_source.sample(fx.gt(spark, sf), 5).withColumn("vec_id", (F.col("frame") * 3 + F.col("video_id")) % fx.n_vectors(spark, sf)).join(fx.embeddings(spark, sf).drop("label"), "vec_id")
    return match.stats(match.score(crops, _proto(spark, sf))).select("video_id", "n", *r6("min", "p50", "mean", "max"))


_SWEEP = (
    _SCORED + ", zs AS (SELECT unnest([CAST(1.0 AS DOUBLE), 1.5, 2.0, 2.5, 3.0]) AS z, unnest(range(0, 5)) AS z_order), ab AS (SELECT video_id, avg(sim) AS m, stddev_pop(sim) AS s, max(sim) AS top FROM sc GROUP BY video_id), zb AS (SELECT z, z_order, video_id, least(greatest(m + z * s, 0.05), top) AS threshold FROM ab, zs), "
    "bst AS (SELECT zb.z, zb.z_order, sc.video_id, frame, x1, y1, x2, y2, score FROM sc JOIN zb USING (video_id) WHERE sim >= threshold QUALIFY row_number() OVER (PARTITION BY z_order, sc.video_id, frame ORDER BY sim DESC, cand_id) = 1), "
    + _EMA.format("bst").replace("SELECT video_id,", "SELECT z, z_order, video_id,").replace("PARTITION BY video_id", "PARTITION BY z_order, video_id") + ", "
    + _FILL.format("ema").replace("PARTITION BY video_id", "PARTITION BY z_order, video_id").replace("fil AS (SELECT video_id,", "fil AS (SELECT z, z_order, video_id,") + ", "
    + _SEG.format("fil").replace("PARTITION BY video_id", "PARTITION BY z_order, video_id") + ", tb AS (SELECT * FROM seg WHERE len >= 2), gz AS (SELECT z, z_order, gt.* FROM gt, zs), "
    + _sst("tb", "gz", ", z, z_order") + ", sweep AS (SELECT z, z_order, v.video_id, coalesce(st_iou, 0) AS st_iou FROM (SELECT DISTINCT video_id, z, z_order FROM gz) v LEFT JOIN st USING (video_id, z, z_order))"
)


def _sweep(spark, sf):
    scored = match.score(fx.cand_feat(spark, sf), _proto(spark, sf))
    return composite.sweep(scored, fx.gt(spark, sf), ZS, Config())


@query(with_views(_SWEEP + " SELECT z, video_id, round(st_iou, 6) AS st_iou FROM sweep", "refs", "cand_feat", "gt"))
def zsweep(spark, sf):
    return _sweep(spark, sf).select("z", "video_id", *r6("st_iou"))


@query(with_views(_SWEEP + " SELECT z, round(avg(st_iou), 6) AS mean_st_iou FROM sweep GROUP BY z, z_order ORDER BY round(avg(st_iou), 12) DESC, z_order LIMIT 1", "refs", "cand_feat", "gt"))
def zsweep_best(spark, sf):
    return evaluate.best_z(_sweep(spark, sf)).select("z", *r6("mean_st_iou"))


_LOO = _SWEEP + ", ot AS (SELECT a.video_id, a.z, a.z_order, a.st_iou, avg(b.st_iou) AS others FROM sweep a JOIN sweep b ON a.z_order = b.z_order AND a.video_id <> b.video_id GROUP BY ALL), fold AS (SELECT * FROM ot QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(others, 12) DESC, z_order) = 1)"


@query(with_views(_LOO + " SELECT video_id, z, round(others, 6) AS train_mean, round(st_iou, 6) AS held_out FROM fold", "refs", "cand_feat", "gt"))
def loocv(spark, sf):
    return evaluate.loocv(_sweep(spark, sf)).select("video_id", "z", *r6("train_mean", "held_out"))


@query(with_views(_LOO + " SELECT round(avg(st_iou), 6) AS loocv_mean, count(*) AS n_videos FROM fold", "refs", "cand_feat", "gt"))
def loocv_mean(spark, sf):
    return evaluate.loocv(_sweep(spark, sf)).agg(F.round(F.avg("held_out"), 6).alias("loocv_mean"), F.count("*").alias("n_videos"))


@query(with_views(_LOO + ", top AS (SELECT z AS best_z, round(avg(st_iou), 6) AS naive_mean FROM sweep GROUP BY z, z_order ORDER BY round(avg(st_iou), 12) DESC, z_order LIMIT 1) SELECT best_z, naive_mean, (SELECT round(avg(st_iou), 6) FROM fold) AS loocv_mean, CAST(video_id AS VARCHAR) AS video_id, z, round(st_iou, 6) AS st_iou FROM fold, top", "refs", "cand_feat", "gt"))
def loocv_report(spark, sf):
    """The JSON report, read back: engines write small numbers differently."""
    s = settle(_sweep(spark, sf))
    report = submissions.loocv_report(evaluate.loocv(s), evaluate.best_z(s))
    kind = "best_z double, naive_mean double, loocv_mean double, folds map<string, struct<z: double, st_iou: double>>"
    read = report.select(F.from_json("report", kind).alias("r")).select("r.best_z", "r.naive_mean", "r.loocv_mean", F.explode("r.folds").alias("video_id", "fold"))
    return read.select("best_z", "naive_mean", "loocv_mean", "video_id", "fold.z", "fold.st_iou")


# ---- documents, labels, frames ----------------------------------------------------------------------------------


@query(with_views("SELECT video_id, frame, " + ", ".join(f"CAST(round_even({c} / 3, 0) AS INTEGER) AS {c}" for c in B) + " FROM pred", "pred"))
def submission_rows(spark, sf):
    return submissions.rows(fx.pred(spark, sf).withColumns({c: F.col(c) / 3 for c in B}))


@query(with_views("SELECT CAST(video_id AS VARCHAR) AS video_id, frame, x1, y1, x2, y2 FROM gt", "gt"))
def gt_round_trip(spark, sf):
    """Ground truth to nested documents and back."""
    docs = submissions.documents(fx.gt(spark, sf)).select(F.concat(F.lit("["), "entry", F.lit("]")).alias("value"))
    return submissions.last_tubes(submissions.entries(docs))


@query(with_views("SELECT frame, x1, y1, x2, y2 FROM gt WHERE video_id = 4", "gt"))
def gt_one_video(spark, sf):
    docs = submissions.documents(fx.gt(spark, sf)).select(F.concat(F.lit("["), "entry", F.lit("]")).alias("value"))
    return submissions.first_tube(submissions.entries(docs), "4")


@query(with_views("SELECT DISTINCT CAST(video_id AS VARCHAR) AS video_id FROM gt", "gt"))
def list_video_ids(spark, sf):
    docs = submissions.documents(fx.gt(spark, sf)).select(F.concat(F.lit("["), "entry", F.lit("]")).alias("value"))
    return submissions.video_ids(submissions.entries(docs).select("doc", "entry", "e.video_id"))


@query(with_views("SELECT * FROM (SELECT video_id * 2 AS video_id, frame, x1 FROM gt WHERE video_id * 2 NOT IN (SELECT video_id FROM pred) UNION ALL SELECT video_id, frame, x1 FROM pred)", "gt", "pred"))
def submission_upsert(spark, sf):
    """Old documents of other videos stay, those of the new ones' videos go."""
    old = fx.gt(spark, sf).withColumn("video_id", F.col("video_id") * 2)
    return submissions.upsert(old.select(*KEYS, "x1"), fx.pred(spark, sf).select(*KEYS, "x1"))


@query(with_views("""l AS (SELECT cand_id // 4 AS stem, cand_id AS line_no, cand_id % 3 AS cls, concat_ws(' ', cand_id % 3, CAST(x1 AS INTEGER), CAST(y1 AS INTEGER)) AS rest FROM cand),
  i AS (SELECT DISTINCT cand_id // 4 AS stem FROM cand), one AS (SELECT 'a_' || stem AS image, coalesce(string_agg('0' || substr(rest, 2), chr(10) ORDER BY line_no) FILTER (cls = 1), '') AS lines, count(*) FILTER (cls = 1) AS n_lines FROM i LEFT JOIN l USING (stem) GROUP BY stem) SELECT * FROM one""", "cand"))
def label_remap(spark, sf):
    """Lines of class 1 as class 0; images without any stay."""
    c = fx.cand(spark, sf).withColumn("stem", F.expr("cand_id div 4"))
    lines = c.select("stem", F.col("cand_id").alias("line_no"), F.concat_ws(" ", (F.col("cand_id") % 3).cast("string"), F.col("x1").cast("int").cast("string"), F.col("y1").cast("int").cast("string")).alias("line"))
    return labels.keep_class(c.select("stem").distinct(), lines, 1, "a")


@query(with_views("SELECT count(DISTINCT cand_id // 4) AS n_images, count(DISTINCT cand_id // 4) FILTER (cand_id % 3 = 1) AS n_with_class FROM cand", "cand"))
def label_counts(spark, sf):
    return labels.counts(label_remap(spark, sf))


@query(with_views("SELECT video_id, count(*) AS total_frames, CAST(10 AS DOUBLE) AS fps, 1920 AS width, 1080 AS height FROM (SELECT DISTINCT video_id, frame FROM cand) GROUP BY video_id", "cand"))
def video_metadata(spark, sf):
    return frame_source.metadata(fx.cand(spark, sf).select(*KEYS, F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.lit(10.0).alias("fps")).distinct())


@query(with_views("SELECT video_id, frame FROM (SELECT video_id, frame, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS rn FROM gt) WHERE (rn - 1) % 7 = 0", "gt"))
def frame_sample(spark, sf):
    return frame_source.sample(fx.gt(spark, sf), 7).select(*KEYS)


@query(with_views("SELECT CAST(video_id AS VARCHAR) AS video_id, CAST(r - 1 AS INTEGER) AS ref_id, path FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY path) AS r FROM (SELECT video_id, 'd/' || video_id || '/' || cand_id || '.JPG' AS path FROM cand WHERE cand_id % 2 = 0)) WHERE r <= 3", "cand"))
def first_references(spark, sf):
    ext = F.when(F.col("cand_id") % 2 == 0, ".JPG").otherwise(".txt")
    return frame_source.references(fx.cand(spark, sf).select(F.concat(F.lit("d/"), F.col("video_id").cast("string"), F.lit("/"), F.col("cand_id").cast("string"), ext).alias("path")), 3)


@query(with_views("SELECT CAST(video_id AS VARCHAR) AS video_id, min('d/' || video_id || '/' || cand_id || '.mp4') AS path FROM cand GROUP BY video_id", "cand"))
def video_discovery(spark, sf):
    return frame_source.discover(fx.cand(spark, sf).select(F.concat(F.lit("d/"), F.col("video_id").cast("string"), F.lit("/"), F.col("cand_id").cast("string"), F.lit(".mp4")).alias("path")))


# ---- further operators ------------------------------------------------------------------------------------------


@query(with_views("m AS (SELECT video_id, ref_id, pos, avg(x) AS x FROM (SELECT video_id, ref_id, unnest(feature) AS x, generate_subscripts(feature, 1) - 1 AS pos FROM refs) GROUP BY ALL), w AS (SELECT video_id, ref_id, max(CASE WHEN mask_ratio >= 0.2 AND mask_ratio <= 0.6 THEN mask_ratio ELSE 448 * 336 / (640.0 * 480) END) AS mr FROM refs GROUP BY ALL), p0 AS (SELECT video_id, pos, sum(x * (mr + 1e-4)) / sum(mr + 1e-4) AS x FROM m JOIN w USING (video_id, ref_id) GROUP BY ALL), pn AS (SELECT video_id, sqrt(sum(x * x)) AS n FROM p0 GROUP BY video_id) SELECT video_id, CAST(pos AS INTEGER) AS pos, round(x / n, 6) AS value FROM p0 JOIN pn USING (video_id)", "refs"))
def stage1_prototype(spark, sf):
    """Masks checked and replaced, views to references, references to a prototype."""
    views = prototype.masks(fx.refs(spark, sf).withColumns({"width": F.lit(640), "height": F.lit(480)}), 0.2, 0.6)
    refs = prototype.ref_means(views.drop("mask_ratio").withColumnRenamed("used_ratio", "mask_ratio"))
    return exploded(prototype.fuse(refs), ["video_id"], "vec")


@query(with_views(_SCORED + ", hb AS (SELECT video_id, greatest(0.15, quantile_cont(sim, 0.9)) AS bar FROM sc GROUP BY video_id) SELECT cand_id, video_id FROM sc JOIN hb USING (video_id) WHERE sim >= bar", "refs", "cand_feat"))
def high_confidence(spark, sf):
    scored = match.score(fx.cand_feat(spark, sf), _proto(spark, sf))
    return match.high_confidence(scored, 90, 0.15).select("cand_id", "video_id")


@query(with_views("SELECT video_id, frame, cand_id FROM cand WHERE video_id = 0 AND frame = 17", "cand"))
def point_lookup(spark, sf):
    return fx.cand(spark, sf).where("video_id = 0 AND frame = 17").select(*KEYS, "cand_id")


@query(with_views("SELECT video_id, frame, x1 FROM pred WHERE frame % 3 = 0", "pred"))
def present_frames(spark, sf):
    """Dense tracks to a tube: frames without a box have no row."""
    tracks = track.track(fx.track_inputs(spark, sf), track.Rules(tracker=False))
    return tracks.where(F.col("x1").isNotNull()).select(*KEYS, "x1")


@query(with_views("SELECT vec_id, CAST(pos AS INTEGER) AS pos, round((value * 1000 / 255 - CASE pos % 3 WHEN 0 THEN 0.485 WHEN 1 THEN 0.456 ELSE 0.406 END) / CASE pos % 3 WHEN 0 THEN 0.229 WHEN 1 THEN 0.224 ELSE 0.225 END, 6) AS value FROM (SELECT vec_id, unnest(feature) AS value, generate_subscripts(feature, 1) - 1 AS pos FROM emb)", "emb"))
def standardized(spark, sf):
    """Interleaved channels, scaled and standardised."""
    e = fx.embeddings(spark, sf).withColumn("v", F.transform("feature", lambda x: x * 1000))
    return exploded(e.select("vec_id", vec.standardize(F.col("v"), [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]).alias("s")), ["vec_id"], "s")


@query(with_views("SELECT 'gt/' || video_id AS video_id, frame, x1 FROM gt UNION ALL SELECT 'pred/' || video_id, frame, x1 FROM pred", "gt", "pred"))
def gather_documents(spark, sf):
    """Documents of several files together."""
    text = lambda df, name: submissions.documents(df.withColumn("video_id", F.concat(F.lit(name), F.col("video_id").cast("string")))).select(F.concat(F.lit("["), "entry", F.lit("]")).alias("value"))
    both = text(fx.gt(spark, sf), "gt/").unionByName(text(fx.pred(spark, sf), "pred/"))
    return submissions.last_tubes(submissions.entries(both)).select(*KEYS, "x1")


@query(with_views("SELECT CAST(video_id AS VARCHAR) AS video_id, frame, CAST(round_even(x1, 0) AS INTEGER) AS x1, CAST(round_even(y2, 0) AS INTEGER) AS y2 FROM pred", "pred"))
def submission_scan(spark, sf):
    """Files of arrays, each read in ranges of 8 KB: borders of elements are found wherever a range begins."""
    path = shared_path(spark, "submissions")
    submissions.write(fx.pred(spark, sf), path)
    found = submissions.last_tubes(submissions.scan(spark, path, range_bytes=1 << 13))
    return found.select(*KEYS, F.col("x1").cast("int").alias("x1"), F.col("y2").cast("int").alias("y2"))


@query()
def propose_and_embed(spark, sf):
    """Stub models over keyframes: proposals, then features of their crops."""
    from .plans import plugins

    frames = tiles.keyframes(fx.cand(spark, sf).select(*KEYS).distinct(), 8).withColumns({"width": F.lit(1920), "height": F.lit(1080), "payload": F.encode(F.concat_ws("/", *KEYS), "utf-8")})
    crops = plugins.propose(frames).withColumn("payload", F.encode(F.concat_ws("/", *KEYS, "prop_id"), "utf-8"))
    return plugins.embed(crops).select(*KEYS, "prop_id", *r6(*B, "score"), F.round(vec.norm(F.col("feature")), 4).alias("norm"))


# ---- masks, rasters, uncompressed video -------------------------------------------------------------------------

#: In SQL: the sums of the three channels of each of an image's 21 pixels, and which of them a level leaves in a mask.
_LIGHT = "light AS (SELECT vec_id, label, v, list_transform(range(0, 21), lambda i: v[3 * i + 1] + v[3 * i + 2] + v[3 * i + 3]) AS l FROM img)"
_ON = "list_filter(range(0, 21), lambda i: l[i + 1] > {})"


def light(values):
    """Brightness by pixel."""
    return F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.get(values, 3 * i) + F.get(values, 3 * i + 1) + F.get(values, 3 * i + 2))


def bright(images, level: int):
    """The mask of the pixels above a level, from numbers in columns."""
    return mk.of_flags(F.transform(light(images), lambda x: x > level))


@query(with_views(f"{_LIGHT}, m AS (SELECT vec_id, {_ON.format(400)} AS p FROM light) SELECT vec_id, CAST(len(p) AS BIGINT) AS area, round(len(p) / 21, 6) AS share, CAST(len(list_filter(p, lambda i: NOT list_contains(p, i - 1))) AS INTEGER) AS runs, CAST(list_min(list_transform(p, lambda i: i % 7)) AS INTEGER) AS x1, CAST(list_min(p) // 7 AS INTEGER) AS y1, CAST(list_max(list_transform(p, lambda i: i % 7)) + 1 AS INTEGER) AS x2, CAST(list_max(p) // 7 + 1 AS INTEGER) AS y2 FROM m", "img"))
def mask_statistics(spark, sf):
    """Area, share, runs and box of a mask that is made of columns."""
    rows = fx.images(spark, sf).withColumn("m", bright(F.col("values"), 400))
    box = mk.bounds(F.col("m"), F.col("width"))
    return rows.select("vec_id", mk.area(F.col("m")).alias("area"), F.round(mk.share(F.col("m"), F.col("width"), F.col("height")), 6).alias("share"), F.size("m").alias("runs"), *[box[c].alias(c) for c in B])


@query(with_views(f"{_LIGHT}, m AS (SELECT vec_id, {_ON.format(400)} AS p FROM light) SELECT a.vec_id, CAST(len(list_intersect(a.p, b.p)) AS BIGINT) AS shared, CAST(21 - len(list_distinct(list_concat(a.p, b.p))) AS BIGINT) AS outside, round(CASE WHEN len(list_concat(a.p, b.p)) > 0 THEN len(list_intersect(a.p, b.p)) / len(list_distinct(list_concat(a.p, b.p))) ELSE 0.0 END, 6) AS iou FROM m a CROSS JOIN nv JOIN m b ON b.vec_id = (a.vec_id + 1) % nv", "img", "nv"))
def mask_overlap(spark, sf):
    """Shared pixels, pixels of neither, and IoU of the masks of two images."""
    m = fx.images(spark, sf).select("vec_id", bright(F.col("values"), 400).alias("a"))
    other = m.select(F.col("vec_id").alias("_v"), F.col("a").alias("b"))
    both = m.join(other, (F.col("vec_id") + 1) % fx.n_vectors(spark, sf) == F.col("_v"))
    a, b = F.col("a"), F.col("b")
    return both.select("vec_id", mk.area(mk.both(a, b)).alias("shared"), mk.area(mk.without(mk.either(a, b), F.lit(21))).alias("outside"), F.round(mk.iou(a, b), 6).alias("iou"))


_SEGMENT = f"{_LIGHT}, s AS (SELECT vec_id, label, v, l, k, p, CASE WHEN len(p) BETWEEN 1 AND 20 THEN (list_sum(list_transform(p, lambda i: l[i + 1])) / len(p) - (list_sum(l) - list_sum(list_transform(p, lambda i: l[i + 1]))) / (21 - len(p))) * sqrt(len(p) / 21 * (1 - len(p) / 21)) ELSE 0.0 END AS score FROM (SELECT *, list_filter(range(0, 21), lambda i: l[i + 1] > k) AS p FROM light, (SELECT unnest([250, 400, 550]) AS k))), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 6) DESC, k) = 1)"
_LEVELS = [250, 400, 550]


def segmented(spark, sf):
    """Images with the best of a model's masks, the smaller level's of equal ones."""
    found = raster.segmented(fx.images(spark, sf), _LEVELS)
    scores = F.transform("scores", lambda s: F.round(s, 6))
    return found.withColumn("mask", mk.best(F.col("masks"), scores)).withColumn("score", F.array_max(scores))


@query(with_views(_SEGMENT + " SELECT vec_id, round(score, 6) AS score, CAST(len(p) AS BIGINT) AS area, round(CASE WHEN len(p) / 21 BETWEEN 0.2 AND 0.6 THEN len(p) ELSE 10 END / 21, 6) AS used_share FROM best", "img"))
def best_masks(spark, sf):
    """A segmenter's masks of raw pixels, the best of them, and the middle of the image where its share is implausible."""
    used = mk.plausible(F.col("mask"), F.col("width"), F.col("height"), 0.2, 0.6, 0.75)
    return segmented(spark, sf).select("vec_id", "score", mk.area(F.col("mask")).alias("area"), F.round(mk.share(used, F.col("width"), F.col("height")), 6).alias("used_share"))


@query(with_views("SELECT vec_id, CAST(c AS INTEGER) AS channel, round(list_sum(list_transform(range(0, 21), lambda i: v[3 * i + 1 + c])) / 21, 6) AS mean FROM img, (SELECT unnest([0, 1, 2]) AS c)", "img"))
def background_means(spark, sf):
    """The mean colour of raw pixels."""
    done = raster.measured(fx.images(spark, sf)).select("vec_id", F.posexplode(raster.mean_color(F.col("sums"), F.col("width"), F.col("height"))).alias("channel", "mean"))
    return done.select("vec_id", "channel", F.round("mean", 6).alias("mean"))


@query(with_views(_SEGMENT + " SELECT vec_id, CAST(c AS INTEGER) AS channel, CAST(coalesce(list_sum(list_transform(p, lambda i: v[3 * i + 1 + c])), 0) + (21 - len(p)) * (list_sum(list_transform(range(0, 21), lambda i: v[3 * i + 1 + c])) // 21) AS BIGINT) AS total FROM best, (SELECT unnest([0, 1, 2]) AS c)", "img"))
def masked_images(spark, sf):
    """Images whose background has their mean colour."""
    done = raster.measured(raster.painted(segmented(spark, sf)).select("vec_id", "width", "height", "pixels"))
    return done.select("vec_id", F.posexplode("sums").alias("channel", "total"))


_MIXED = "round_even(CAST(v[22 + 3 * {a} + c] AS DOUBLE) * (1 - {p}) + v[22 + 3 * {b} + c] * {p}, 0)"


@query(with_views("SELECT vec_id, CAST(level AS INTEGER) AS level, CAST(c AS INTEGER) AS channel, CAST(CASE WHEN level = 0 THEN list_sum(list_transform(range(0, 21), lambda i: v[3 * i + 1 + c])) ELSE " + " + ".join(_MIXED.format(a=a, b=b, p=p) for a, b, p in ((0, 1, "(2.0 / 3)"), (3, 4, "0.0"), (5, 6, "(1.0 / 3)"))) + " END AS BIGINT) AS total FROM img, (SELECT unnest([0, 1, 2]) AS c), (SELECT unnest([0, 1]) AS level)", "img"))
def image_pyramid(spark, sf):
    """Channel sums of the images and of their halves, 3 x 1 pixels sampled from 7 x 3."""
    done = raster.measured(raster.pyramid(fx.images(spark, sf).select("vec_id", "width", "height", "pixels"), [1.0, 0.5]))
    return done.select("vec_id", "level", F.posexplode("sums").alias("channel", "total"))


@query(with_views("SELECT vec_id, CAST(c AS INTEGER) AS channel, CAST(list_sum(list_transform(range(0, 21), lambda i: v[3 * (7 * greatest(i // 7 - 1, 0) + greatest(i % 7 - 2, 0)) + 1 + c])) AS BIGINT) AS total FROM img, (SELECT unnest([0, 1, 2]) AS c)", "img"))
def warped_images(spark, sf):
    """Images under a projective map that moves them by two pixels and one, with the border repeated."""
    matrix = F.array(*[F.lit(float(x)) for x in (1, 0, 2, 0, 1, 1, 0, 0, 1)])
    done = raster.measured(raster.warp(fx.images(spark, sf).select("vec_id", "width", "height", "pixels", matrix.alias("matrix"))))
    return done.select("vec_id", F.posexplode("sums").alias("channel", "total"))


_VIDEO = "SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM img"


def stored_videos(spark, sf) -> str:
    """The folder of uncompressed videos, one a label, that the images in order of vec_id make."""
    path = shared_path(spark, "videos")
    order = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = fx.images(spark, sf).select(F.col("label").cast("string").alias("video_id"), order.alias("frame"), "width", "height", F.lit(25.0).alias("fps"), F.col("pixels").alias("payload"))
    video.save(rows, path)
    return path


@query(with_views(f"SELECT CAST(label AS VARCHAR) AS video_id, CAST(frame AS INTEGER) AS frame, CAST(list_sum(v) AS BIGINT) AS total FROM ({_VIDEO}) WHERE frame % 8 = 0 AND frame >= 8", "img"))
def video_frames(spark, sf):
    """Every eighth frame from the eighth on, of videos that were written and are read again by their index."""
    rows = video.load(spark, stored_videos(spark, sf), stride=8).where("frame >= 8")
    total = lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x)
    return raster.measured(rows.withColumnRenamed("payload", "pixels")).select("video_id", "frame", total(F.col("sums")).alias("total"))


@query(with_views(f"SELECT CAST(label AS VARCHAR) AS video_id, count(*) AS total_frames, 25.0::DOUBLE AS fps, 7 AS width, 3 AS height FROM ({_VIDEO}) GROUP BY label", "img"))
def video_headers(spark, sf):
    """What videos' headers and lengths say."""
    return video.metadata(spark, stored_videos(spark, sf)).drop("path")

"""Queries over the driver's tables, and the DuckDB text that each must equal.

The tables stand for the engine's data: ``embeddings`` is a movie of 8 x 8
frames (t = vec_id) and, clipped at zero, a set of footprints; ``events`` holds
one trace per user; the other tables serve the relational operators.  Floats
are rounded in both texts, and every tie is broken.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaflow.folders import new_folder
from somaflow.operators import frames as frame_ops
from somaflow.operators import geometry, graph, layout, linear, stats, traces

H = W = 8
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    from somaflow.plans import kernels_catalogue

    return _QUERIES | kernels_catalogue.queries()


def oracle_sql() -> dict[str, str]:
    from somaflow.plans import kernels_catalogue

    return _SQL | kernels_catalogue.oracle_sql()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def movie(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("t"), F.col("embedding").alias("px"))


def footprints(spark: SparkSession, sf: str) -> DataFrame:
    """(k, patch, p, a): frames clipped at zero, zero weights left out."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("k"), F.col("label").alias("patch"), F.posexplode("embedding").alias("p", "a")).withColumn("a", F.col("a").cast("double")).where("a > 0")


def mean_footprints(spark: SparkSession, sf: str) -> DataFrame:
    """(k, p, a): ten footprints, the clipped means of each label's frames."""
    e = table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("k"), F.posexplode("embedding").alias("p", "v"))
    return e.groupBy("k", "p").agg(F.avg(F.col("v").cast("double")).alias("a")).select("k", "p", F.round(F.greatest("a", F.lit(0.0)), 9).alias("a")).where("a > 0")


def event_traces(spark: SparkSession, sf: str) -> DataFrame:
    return layout.ordered_traces(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value")


def r6(c, digits: int = 6):
    """Rounded, and never minus zero."""
    return F.round(c, digits) + F.lit(0.0)


PX = "px AS (SELECT vec_id AS t, i::INT AS p, (i // 8)::INT AS y, (i % 8)::INT AS x, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) r(i))"
FP = "fp AS (SELECT vec_id AS k, label AS patch, i::INT AS p, embedding[i + 1]::DOUBLE AS a FROM embeddings, range(64) r(i) WHERE embedding[i + 1] > 0)"
MF = "mf AS (SELECT * FROM (SELECT label::BIGINT AS k, i::INT AS p, round(greatest(avg(embedding[i + 1]::DOUBLE), 0), 9) AS a FROM embeddings, range(64) r(i) GROUP BY 1, 2) WHERE a > 0)"
TR = "tr AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS v FROM events)"
AROUND = "nb AS (SELECT dy::INT AS dy, dx::INT AS dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE dy <> 0 OR dx <> 0)"
#: Power of each pixel's upper band; the phase is reduced before the sine so that it stays exact.
DFT = """n AS (SELECT count(*) AS n FROM embeddings),
pw AS (SELECT y, x, k, sum(v * cos(2 * pi() * ((k * t) % n) / n)) AS re, sum(v * sin(2 * pi() * ((k * t) % n) / n)) AS im
       FROM px, n, (SELECT k FROM n, range(n // 2 + 1) r(k) WHERE k * 4 > n AND 2 * k <= n) GROUP BY y, x, k, n),
psd AS (SELECT y, x, re * re / n + im * im AS p FROM pw, n)"""
NOISE = {"mean": "sqrt(avg(p))", "median": "sqrt(median(p))", "logmexp": "sqrt(exp(avg(ln(p + 1e-10))))"}
CORR = f"""zm AS (SELECT y, x, avg(v) AS m, stddev_pop(v) AS s FROM px GROUP BY y, x),
z AS (SELECT t, px.y, px.x, (v - m) / s AS z FROM px JOIN zm ON px.y = zm.y AND px.x = zm.x),
{AROUND},
pc AS (SELECT a.y, a.x, avg(a.z * b.z) AS r FROM z a, nb, z b WHERE b.t = a.t AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.y, a.x, b.y, b.x),
cn AS (SELECT y, x, avg(r) AS cn FROM pc GROUP BY y, x)"""
PNR = "sn AS (SELECT y, x, {noise} AS sn FROM psd GROUP BY y, x), pk AS (SELECT y, x, max(v) - avg(v) AS pk FROM px GROUP BY y, x), pnr AS (SELECT pk.y, pk.x, pk / sn AS pnr, sn FROM pk JOIN sn ON pk.y = sn.y AND pk.x = sn.x)"


# -- statistics of pixels


@query(f"WITH {PX} SELECT y, x, round(median(v), 6) + 0.0 AS template FROM px WHERE t < 500 GROUP BY y, x")
def template_median(spark, sf):
    return layout.with_place(stats.template(layout.in_range(movie(spark, sf), 0, 500)), W).select("y", "x", r6(F.col("template")).alias("template"))


@query(f"WITH {PX} SELECT y, x, round(max(v), 6) + 0.0 AS vmax, round(avg(v), 6) + 0.0 AS vmean, round(stddev_pop(v), 6) AS vstd FROM px GROUP BY y, x")
def pixel_stats(spark, sf):
    return layout.with_place(stats.pixel_stats(movie(spark, sf)), W).select("y", "x", *(r6(F.col(c)).alias(c) for c in ("vmax", "vmean", "vstd")))


@query(f"""WITH {PX}, c AS (SELECT t, p, v, (t * 5 + p) % 7 = 0 AS bad FROM px), m AS (SELECT t, avg(v) AS m FROM c WHERE NOT bad GROUP BY t)
SELECT c.t, p, round(CASE WHEN bad THEN m ELSE v END, 6) + 0.0 AS v FROM c JOIN m ON c.t = m.t""")
def finite_values(spark, sf):
    """Every seventh value counts as missing, NaN or infinite."""
    hole = F.when(F.col("t") % 3 == 0, F.lit(float("nan"))).when(F.col("t") % 3 == 1, F.lit(float("inf")))
    m = movie(spark, sf).select("t", F.transform("px", lambda v, i: F.when((F.col("t") * 5 + i) % 7 == 0, hole).otherwise(v.cast("double"))).alias("px"))
    return layout.pixels(stats.finite(m)).select("t", "p", r6(F.col("v")).alias("v"))


def _noise(method: str):
    def f(spark, sf):
        return layout.with_place(stats.noise_image(movie(spark, sf), method, None), W).select("y", "x", r6(F.col("sn")).alias("sn"))

    f.__name__ = f"noise_fft_{method}"
    return query(f"WITH {PX}, {DFT} SELECT y, x, round({NOISE[method]}, 6) AS sn FROM psd GROUP BY y, x")(f)


for _method in NOISE:
    _noise(_method)


@query(f"WITH {PX}, {DFT}, {PNR.format(noise=NOISE['logmexp'])} SELECT y, x, round(pnr, 5) AS pnr FROM pnr")
def pnr_image(spark, sf):
    return layout.with_place(stats.pnr_image(movie(spark, sf), most=None), W).select("y", "x", r6(F.col("pnr"), 5).alias("pnr"))


@query(f"WITH {PX}, {CORR} SELECT y, x, round(cn, 6) + 0.0 AS cn FROM cn")
def corr_image(spark, sf):
    return layout.with_place(stats.correlation_image(movie(spark, sf), H, W), W).select("y", "x", r6(F.col("cn")).alias("cn"))


INFO = f"{PX}, {DFT}, {PNR.format(noise=NOISE['mean'])}, {CORR}, info AS (SELECT cn.y, cn.x, cn, pnr FROM cn JOIN pnr ON cn.y = pnr.y AND cn.x = pnr.x)"


@query(f"WITH {INFO} SELECT y, x, round(cn, 6) + 0.0 AS cn, round(pnr, 5) AS pnr FROM info")
def correlation_info(spark, sf):
    return stats.correlation_info(movie(spark, sf), H, W, "mean", None).select("y", "x", r6(F.col("cn")).alias("cn"), r6(F.col("pnr"), 5).alias("pnr"))


SEED = f"{INFO}, seed AS (SELECT y, x, CASE WHEN cn < 0.0 OR pnr < 0.17 OR y < 1 OR y >= 7 OR x < 1 OR x >= 7 THEN 0 ELSE round(cn * pnr, 6) END AS score FROM info)"


def _seeds(spark, sf):
    return stats.seed_mask(stats.correlation_info(movie(spark, sf), H, W, "mean", None), H, W, 0.0, 0.17, 1).select("y", "x", r6(F.col("score")).alias("score"))


@query(f"WITH {SEED} SELECT y, x, score::DOUBLE AS score FROM seed")
def seed_mask(spark, sf):
    return _seeds(spark, sf)


@query(f"WITH {SEED} SELECT y, x, score::DOUBLE AS score, row_number() OVER (ORDER BY score DESC, y, x) AS rank FROM seed WHERE score > 0")
def seed_rank(spark, sf):
    return stats.ranked_seeds(_seeds(spark, sf))


def _maxima_sql(before: int, after: int) -> str:
    return f"""WITH {PX}, im AS (SELECT y, x, round(avg(v), 9) AS v FROM px GROUP BY y, x),
mx AS (SELECT a.y, a.x, max(b.v) AS m FROM im a, im b WHERE b.y - a.y BETWEEN -{before} AND {after} AND b.x - a.x BETWEEN -{before} AND {after} GROUP BY a.y, a.x)
SELECT im.y, im.x, round(v, 6) + 0.0 AS v FROM im JOIN mx ON im.y = mx.y AND im.x = mx.x WHERE v = m"""


def _maxima(spark, sf, size):
    mean = layout.with_place(layout.pixels(movie(spark, sf)).groupBy("p").agg(F.round(F.avg("v"), 9).alias("v")), W).select("y", "x", "v")
    return stats.local_maxima(mean, H, W, size).select("y", "x", r6(F.col("v")).alias("v"))


@query(_maxima_sql(1, 1))
def local_maxima(spark, sf):
    return _maxima(spark, sf, 3)


@query(_maxima_sql(2, 1))
def local_maxima_even(spark, sf):
    """A window of four has two places before a pixel and one after it."""
    return _maxima(spark, sf, 4)


@query(f"WITH {PX}, mx AS (SELECT max(t) + 1 AS n FROM px) SELECT t, round(sum(v), 6) + 0.0 AS total FROM px, mx WHERE t < 64 OR (t >= n // 2 - 32 AND t < n // 2 + 32) OR t >= n - 64 GROUP BY t")
def frame_sample(spark, sf):
    m = movie(spark, sf)
    n = m.agg(F.max("t") + 1).first()[0]
    wanted = " OR ".join(f"(t >= {a} AND t < {b})" for a, b in layout.frame_sample(n, 192))
    return layout.pixels(m.where(wanted)).groupBy("t").agg(r6(F.sum("v")).alias("total"))


# -- frames to frames


def _kernel_sql(kernel) -> str:
    r = kernel.shape[0] // 2
    rows = ", ".join(f"({i - r}, {j - r}, {v!r})" for i, row in enumerate(kernel.tolist()) for j, v in enumerate(row) if v)
    return f"ker(dy, dx, w) AS (VALUES {rows})"


def _filter_sql(kernel, border: str) -> str:
    index = {"reflect": "CASE WHEN {0} < 0 THEN -1 - ({0}) WHEN {0} > 7 THEN 15 - ({0}) ELSE {0} END", "replicate": "greatest(0, least(7, {0}))"}[border]
    return f"""{PX}, {_kernel_sql(kernel)},
sp AS (SELECT y, x, {index.format("y + dy")} AS sy, {index.format("x + dx")} AS sx, w FROM range(8) a(y), range(8) b(x), ker),
ft AS (SELECT t, sp.y::INT AS y, sp.x::INT AS x, round(sum(px.v * w), 6) + 0.0 AS v FROM sp JOIN px ON px.y = sy AND px.x = sx GROUP BY t, sp.y, sp.x)"""


def _pixels_of(df: DataFrame) -> DataFrame:
    return layout.with_place(layout.pixels(df), W).select("t", "y", "x", r6(F.col("v")).alias("v"))


from somaflow.functions import images as _images  # noqa: E402

BAND = _filter_sql(_images.disc_kernel(2), "reflect")
_g = _images.gaussian(7, 2)
_dog = [[_g[i] * _g[j] - 1 / 49 for j in range(7)] for i in range(7)]


@query(f"WITH {BAND} SELECT * FROM ft")
def bandpass_filter(spark, sf):
    return _pixels_of(frame_ops.band_pass(movie(spark, sf), H, W, 2))


import numpy as _np  # noqa: E402


@query(f"WITH {_filter_sql(_np.array(_dog), 'replicate')} SELECT * FROM ft")
def dog_filter(spark, sf):
    return _pixels_of(frame_ops.centred_gaussian(movie(spark, sf), H, W, 2))


@query(f"WITH {BAND} SELECT t, arg_max(y * 8 + x, v * 1e6 - (y * 8 + x) / 100.0) // 8 AS y, arg_max(y * 8 + x, v * 1e6 - (y * 8 + x) / 100.0) % 8 AS x, max(v) AS v FROM ft GROUP BY t")
def max_fluo(spark, sf):
    ft = frame_ops.band_pass(movie(spark, sf), H, W, 2).select("t", F.transform("px", lambda v: F.round(v, 6) + F.lit(0.0)).alias("px"))
    return stats.brightest(ft, W)


@query(f"WITH {PX} SELECT t // 2 AS t, (y // 2)::INT AS y, (x // 2)::INT AS x, round(avg(v), 6) + 0.0 AS v FROM px GROUP BY 1, 2, 3")
def downsample(spark, sf):
    return layout.downsampled(movie(spark, sf), W, 2, 2).select("t", "y", "x", r6(F.col("v")).alias("v"))


@query(f"""WITH {PX}, sm AS (SELECT t // 2 AS t, y // 2 AS y, x // 2 AS x, round(avg(v), 6) + 0.0 AS v FROM px GROUP BY 1, 2, 3)
SELECT px.t, px.y, px.x, sm.v FROM px JOIN sm ON px.t // 2 = sm.t AND px.y // 2 = sm.y AND px.x // 2 = sm.x""")
def upsample_nearest(spark, sf):
    up = layout.upsampled_nearest(layout.downsampled(movie(spark, sf), W, 2, 2), 2, 2)
    return up.select("t", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), r6(F.col("v")).alias("v"))


@query(f"""WITH {PX}, fr AS (SELECT t, y, x, v FROM px), g AS (
  SELECT max(abs(b.v - a.v)) AS m, a.t, 0 AS axis FROM fr a JOIN fr b ON a.t = b.t AND b.y = a.y + 1 AND a.x = b.x GROUP BY a.t
  UNION ALL SELECT max(abs(b.v - a.v)), a.t, 1 FROM fr a JOIN fr b ON a.t = b.t AND a.y = b.y AND b.x = a.x + 1 GROUP BY a.t
  UNION ALL SELECT max(abs(b.v * b.v - a.v * a.v)), a.t, 2 FROM fr a JOIN fr b ON a.t = b.t AND b.y = a.y + 1 AND a.x = b.x GROUP BY a.t
  UNION ALL SELECT max(abs(b.v * b.v - a.v * a.v)), a.t, 3 FROM fr a JOIN fr b ON a.t = b.t AND a.y = b.y AND b.x = a.x + 1 GROUP BY a.t)
SELECT t, round(quantile_cont(m, 0.75), 6) AS shear FROM g GROUP BY t""")
def max_shear(spark, sf):
    """The shift images are each frame and its square."""
    m = movie(spark, sf).select("t", F.transform("px", lambda v: v.cast("double")).alias("a")).withColumn("b", F.transform("a", lambda v: v * v))
    return geometry.max_shear(m, H, W).select("t", r6(F.col("shear")).alias("shear"))


# -- patches, rings, nearest centres


@query("""WITH e AS (SELECT i, greatest(0, i * 4 - 2) AS lo, least(8, (i + 1) * 4 + 2) AS hi FROM range(2) r(i))
SELECT (a.i * 2 + b.i)::INT AS patch, y::INT AS y, x::INT AS x FROM e a, e b, range(8) p(y), range(8) q(x) WHERE y >= a.lo AND y < a.hi AND x >= b.lo AND x < b.hi""")
def patch_grid_cnmfe(spark, sf):
    at = spark.range(H * W).select((F.col("id") / W).cast("int").alias("y"), (F.col("id") % W).cast("int").alias("x"))
    return geometry.in_patches(at, geometry.analysis_patches(H, W, (2, 2), 4)).select("patch", "y", "x")


@query("""SELECT (a.i * 3 + b.i)::INT AS patch, y::INT AS y, x::INT AS x FROM range(3) a(i), range(3) b(i), range(8) p(y), range(8) q(x)
WHERE y >= a.i * 3 AND y < least(8, a.i * 3 + 5) AND x >= b.i * 3 AND x < least(8, b.i * 3 + 5)""")
def patch_grid_mc(spark, sf):
    at = spark.range(H * W).select((F.col("id") / W).cast("int").alias("y"), (F.col("id") % W).cast("int").alias("x"))
    return geometry.in_patches(at, geometry.motion_patches(H, W, (3, 3), (2, 2))).select("patch", "y", "x")


@query(f"""WITH {PX}, e AS (SELECT i, greatest(0, i * 4 - 2) AS lo, least(8, (i + 1) * 4 + 2) AS hi FROM range(2) r(i))
SELECT t, (a.i * 2 + b.i)::INT AS patch, round(avg(v), 6) + 0.0 AS v FROM e a, e b, px WHERE y >= a.lo AND y < a.hi AND x >= b.lo AND x < b.hi GROUP BY 1, 2""")
def patch_means(spark, sf):
    m = geometry.in_patches(layout.with_place(layout.pixels(movie(spark, sf)), W), geometry.analysis_patches(H, W, (2, 2), 4))
    return m.groupBy("t", "patch").agg(r6(F.avg("v")).alias("v"))


COM = f"{FP}, com AS (SELECT k, round(sum(a * (p // 8)) / sum(a), 6) AS cy, round(sum(a * (p % 8)) / sum(a), 6) AS cx FROM fp GROUP BY k)"


def _centers(spark, sf):
    return geometry.centers_of_mass(footprints(spark, sf), W).select("k", r6(F.col("cy")).alias("cy"), r6(F.col("cx")).alias("cx"))


@query(f"WITH {COM} SELECT k, cy + 0.0 AS cy, cx + 0.0 AS cx FROM com")
def center_of_mass(spark, sf):
    return _centers(spark, sf)


@query(f"""WITH {COM}, c AS (SELECT i * 2 + j AS patch, 1.5 + 4 * i AS py, 1.5 + 4 * j AS px FROM range(2) a(i), range(2) b(j)),
d AS (SELECT k, patch, row_number() OVER (PARTITION BY k ORDER BY (cy - py) * (cy - py) + (cx - px) * (cx - px), patch) AS r FROM com, c)
SELECT k, patch, k % 4 = patch AS keep FROM d WHERE r = 1""")
def nearest_patch(spark, sf):
    """A neuron stays only with the patch whose centre is nearest; here it was found by patch k % 4."""
    centers = spark.createDataFrame([(i * 2 + j, 1.5 + 4 * i, 1.5 + 4 * j) for i in range(2) for j in range(2)], "patch bigint, cy double, cx double")
    near = geometry.nearest_center(_centers(spark, sf), centers, ["k"], ["cy", "cx"], "patch")
    return near.select("k", "patch", (F.col("k") % 4 == F.col("patch")).alias("keep"))


@query("""WITH d AS (SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS d, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS r FROM customer, supplier)
SELECT c_custkey AS k, s_suppkey AS center, round(d, 6) AS distance FROM d WHERE r = 1""")
def center_match(spark, sf):
    points = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("at"))
    centers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("center"), F.col("s_acctbal").alias("at"))
    return geometry.nearest_center(points, centers, ["k"], ["at"], "center").withColumn("distance", r6(F.col("distance")))


OV = f"{FP}, ov AS (SELECT a.k AS i, b.k AS j, round(sum(a.a * b.a), 6) AS overlap FROM fp a JOIN fp b ON a.p = b.p AND a.patch = b.patch AND a.k < b.k GROUP BY 1, 2 HAVING sum(a.a * b.a) > 0)"


@query(f"WITH {OV} SELECT i, j, overlap FROM ov")
def overlap_graph(spark, sf):
    return geometry.overlap_graph(footprints(spark, sf), "patch", 6)


@query(f"""WITH RECURSIVE {OV}, e AS (SELECT i, j FROM ov WHERE overlap > 0.4),
s AS (SELECT i AS a, j AS b FROM e UNION SELECT j, i FROM e),
r(k, root) AS (SELECT a, a FROM s UNION SELECT s.a, r.root FROM r JOIN s ON s.b = r.k)
SELECT k, min(root) AS root FROM r GROUP BY k""")
def merge_groups(spark, sf):
    from somaflow.operators.motion import session_save

    return graph.connected(geometry.overlap_links(footprints(spark, sf), "patch", 0.4), session_save(spark, new_folder(spark, "groups")))


@query("""WITH o AS (SELECT y, x FROM range(-3, 4) a(y), range(-3, 4) b(x) WHERE y * y + x * x > 4 AND y * y + x * x <= 9)
SELECT p.y::INT AS y, q.x::INT AS x, (p.y + o.y)::INT AS ny, (q.x + o.x)::INT AS nx FROM range(8) p(y), range(8) q(x), o
WHERE p.y + o.y BETWEEN 0 AND 7 AND q.x + o.x BETWEEN 0 AND 7""")
def ring_neighbours(spark, sf):
    return geometry.ring_pairs(spark, H, W, 2)


@query("""SELECT event_id, (floor((value - 2 * pi() * floor(value / (2 * pi()))) / (2 * pi() / 60) + 0.5)::BIGINT) % 60 AS bin FROM events""")
def asof_tuning(spark, sf):
    """Nearest of 60 evenly spaced angles: arithmetic instead of a join."""
    v, turn = F.col("value"), F.lit(2 * math.pi)
    angle = v - turn * F.floor(v / turn)
    return table(spark, sf, "events").select("event_id", (F.floor(angle / F.lit(2 * math.pi / 60) + 0.5) % 60).alias("bin"))


@query("""SELECT event_id, last.event_id AS last_id, last.value AS last_value FROM (
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN {'event_id': event_id, 'value': value} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events)""")
def asof_event(spark, sf):
    """Each event with its user's last purchase up to then."""
    e = table(spark, sf, "events")
    bought = e.where("event_type = 'purchase'").select(F.col("user_id").alias("k"), F.struct("ts", "event_id").alias("at"), F.struct("event_id", "value").alias("row"))
    out = traces.as_of(e.select(F.col("user_id").alias("k"), F.struct("ts", "event_id").alias("at"), "event_id"), bought)
    return out.select("event_id", F.col("row.event_id").alias("last_id"), F.col("row.value").alias("last_value"))


# -- joins, sets and products


@query(f"WITH {FP}, keep AS (SELECT k FROM fp GROUP BY k HAVING count(*) >= 32) SELECT k, p, round(a, 6) AS a FROM fp WHERE k IN (SELECT k FROM keep)")
def semi_keep(spark, sf):
    f = footprints(spark, sf)
    keep = f.groupBy("k").count().where("count >= 32").select("k")
    return f.join(keep, "k", "left_semi").select("k", "p", r6(F.col("a")).alias("a"))


@query(f"WITH {OV} SELECT vec_id AS k FROM embeddings WHERE vec_id NOT IN (SELECT i FROM ov WHERE overlap > 0.4 UNION SELECT j FROM ov WHERE overlap > 0.4)")
def anti_merged(spark, sf):
    merged = geometry.overlapping(footprints(spark, sf), "patch", 0.4)
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("k")).join(merged, "k", "left_anti")


@query(f"WITH {PX}, {MF} SELECT t, k, round(sum(v * a), 6) + 0.0 AS v FROM px JOIN mf USING (p) GROUP BY t, k")
def matmul_ya(spark, sf):
    return linear.product(layout.pixels(movie(spark, sf)), mean_footprints(spark, sf), "p", "t", "k", "v", "a").select("t", "k", r6(F.col("v")).alias("v"))


@query("""WITH o AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
SELECT a.l_suppkey AS i, b.l_suppkey AS j, round(sum(a.v * b.v), 4) AS v FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <= b.l_suppkey GROUP BY 1, 2""")
def gram_sparse(spark, sf):
    return linear.gram(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", "l_quantity").select("i", "j", F.round("v", 4).alias("v"))


@query(f"""WITH {PX}, f AS (SELECT t, round(avg(v), 9) AS f FROM px GROUP BY t), b AS (SELECT p, round(avg(v), 9) AS b FROM px GROUP BY p)
SELECT t, p, round(f * b * 1000, 6) + 0.0 AS v FROM f, b""")
def outer_fb(spark, sf):
    """Background f b'."""
    long = layout.pixels(movie(spark, sf))
    f = long.groupBy("t").agg(F.round(F.avg("v"), 9).alias("f"))
    b = long.groupBy("p").agg(F.round(F.avg("v"), 9).alias("b"))
    return linear.outer(f, b).select("t", "p", r6(F.col("v") * 1000).alias("v"))


@query(f"""WITH {PX}, {MF}, c AS (SELECT t, k, greatest(sum(v * a), 0) AS c FROM px JOIN mf USING (p) GROUP BY t, k), nn AS (SELECT k, sum(a * a) AS nn FROM mf GROUP BY k),
ya AS (SELECT t, k, sum(v * a) AS ya FROM px JOIN mf USING (p) GROUP BY t, k),
aa AS (SELECT a.k, b.k AS kk, sum(a.a * b.a) AS w FROM mf a JOIN mf b USING (p) GROUP BY 1, 2),
ca AS (SELECT t, aa.k, sum(w * c) AS ca FROM aa JOIN c ON c.k = aa.kk GROUP BY 1, 2)
SELECT ya.k, ya.t, round((ya - ca) / nn, 5) + 0.0 AS v FROM ya JOIN ca ON ya.k = ca.k AND ya.t = ca.t JOIN nn ON nn.k = ya.k""")
def residual_traces(spark, sf):
    px, mf = layout.pixels(movie(spark, sf)), mean_footprints(spark, sf)
    c = linear.product(px, mf, "p", "t", "k", "v", "a").select("k", "t", F.greatest("v", F.lit(0.0)).alias("v"))
    return linear.residual_traces(px, mf, c).select("k", "t", r6(F.col("v"), 5).alias("v"))


@query(f"WITH {MF}, n AS (SELECT k, sqrt(sum(a * a)) AS norm FROM mf GROUP BY k) SELECT mf.k, p, round(a / norm, 6) AS a, round(norm, 6) AS norm FROM mf JOIN n ON mf.k = n.k")
def normalize_ac(spark, sf):
    return linear.unit_footprints(mean_footprints(spark, sf)).select("k", "p", r6(F.col("a")).alias("a"), r6(F.col("norm")).alias("norm"))


@query(f"""WITH {PX}, {MF}, m AS (SELECT p, avg(v) AS m FROM px GROUP BY p), c AS (SELECT k, avg(c) AS c FROM (SELECT t, k, sum(v * a) AS c FROM px JOIN mf USING (p) GROUP BY t, k) GROUP BY k)
SELECT m.p, round(m - coalesce(s, 0), 6) + 0.0 AS b0 FROM m LEFT JOIN (SELECT p, sum(a * c) AS s FROM mf JOIN c ON mf.k = c.k GROUP BY p) q ON m.p = q.p""")
def ring_b0(spark, sf):
    px, mf = layout.pixels(movie(spark, sf)), mean_footprints(spark, sf)
    c = linear.product(px, mf, "p", "t", "k", "v", "a").groupBy("k").agg(F.avg("v").alias("c"))
    explained = mf.join(c, "k").groupBy("p").agg(F.sum(F.col("a") * F.col("c")).alias("s"))
    mean = px.groupBy("p").agg(F.avg("v").alias("m"))
    return mean.join(explained, "p", "left").select("p", r6(F.col("m") - F.coalesce("s", F.lit(0.0))).alias("b0"))


#: Footprints that overlap another one of their patch by enough to be merged.
_MERGED = f"{OV}, mg AS (SELECT i AS k FROM ov WHERE overlap > 0.4 UNION SELECT j FROM ov WHERE overlap > 0.4)"


@query(f"""WITH {_MERGED}, s AS (SELECT k, p, a FROM fp WHERE k NOT IN (SELECT k FROM mg) UNION ALL SELECT k + 1000000, p, a * 2 FROM fp WHERE k IN (SELECT k FROM mg))
SELECT k, count(*) AS n, round(sum(a), 6) AS total FROM s GROUP BY k""")
def union_components(spark, sf):
    """Components that overlap no other one by much, and those that do under new names: every one is on one side."""
    f, merged = footprints(spark, sf).select("k", "p", "a"), geometry.overlapping(footprints(spark, sf), "patch", 0.4)
    new = f.join(merged, "k", "left_semi").select((F.col("k") + 1000000).alias("k"), "p", (F.col("a") * 2).alias("a"))
    return f.join(merged, "k", "left_anti").unionByName(new).groupBy("k").agg(F.count("*").alias("n"), r6(F.sum("a")).alias("total"))


@query(f"WITH {_MERGED} SELECT DISTINCT patch FROM fp WHERE k IN (SELECT i FROM ov UNION SELECT j FROM ov) EXCEPT SELECT DISTINCT patch FROM fp WHERE k IN (SELECT k FROM mg)")
def except_patches(spark, sf):
    """Patches with overlapping components none of which overlap by much."""
    f = footprints(spark, sf)
    blocks = geometry.laid(f, "patch")
    within = lambda least: f.join(geometry.overlapping(f, "patch", least, blocks), "k", "left_semi").select("patch")
    return within(0).subtract(within(0.4))


@query("SELECT l_partkey AS k, sum(l_quantity) AS total FROM lineitem GROUP BY l_partkey HAVING sum(l_quantity) > 600")
def drop_empty(spark, sf):
    """Components survive by their sum."""
    return linear.non_empty(table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "k"), "k", "l_quantity", 600)


# -- footprints


@query(f"""WITH {FP}, q AS (SELECT k, p, a, sum(a * a) OVER (PARTITION BY k ORDER BY a DESC, p) AS e, sum(a * a) OVER (PARTITION BY k) AS total FROM fp),
c AS (SELECT k, min(a) FILTER (WHERE e < 0.9 * total) AS cut FROM q GROUP BY k)
SELECT q.k, p, round(a, 6) AS a FROM q JOIN c ON q.k = c.k WHERE a >= cut""")
def nrg_threshold(spark, sf):
    return linear.strongest(footprints(spark, sf), 0.9).select("k", "p", r6(F.col("a")).alias("a"))


@query(f"""WITH {PX}, c AS (SELECT t, y, x, greatest(v, 0) AS v FROM px), s AS (SELECT dy, dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx)),
sp AS (SELECT y, x, CASE WHEN y + dy < 0 THEN 0 WHEN y + dy > 7 THEN 7 ELSE y + dy END AS sy, CASE WHEN x + dx < 0 THEN 0 WHEN x + dx > 7 THEN 7 ELSE x + dx END AS sx FROM range(8) a(y), range(8) b(x), s)
SELECT t, sp.y::INT AS y, sp.x::INT AS x, round(median(v), 6) + 0.0 AS v FROM sp JOIN c ON c.y = sy AND c.x = sx GROUP BY 1, 2, 3""")
def median3(spark, sf):
    clip = lambda b: _np.stack([_images.median3(f) for f in _np.maximum(b, 0)])
    return _pixels_of(frame_ops.map_frames(movie(spark, sf), H, W, clip))


MORPH = f"""{PX}, s AS (SELECT dy, dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx)), m AS (SELECT t, y, x, v > 0.1 AS b FROM px),
di AS (SELECT m.t, m.y, m.x, bool_or(n.b) AS b FROM m, s, m n WHERE n.t = m.t AND n.y = m.y + dy AND n.x = m.x + dx GROUP BY 1, 2, 3),
er AS (SELECT m.t, m.y, m.x, bool_and(n.b) AND count(*) = 9 AS b FROM di m, s, di n WHERE n.t = m.t AND n.y = m.y + dy AND n.x = m.x + dx GROUP BY 1, 2, 3)"""


@query(f"WITH {MORPH} SELECT t, y, x FROM er WHERE b")
def closing(spark, sf):
    close = lambda b: _np.stack([_images.closing(f > 0.1) for f in b.astype(_np.float32)]).astype(float)
    return _pixels_of(frame_ops.map_frames(movie(spark, sf), H, W, close)).where("v > 0").select("t", "y", "x")


DIL = f"""{PX}, o AS (SELECT dy, dx FROM range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE abs(dy) + abs(dx) <= 2),
su AS (SELECT DISTINCT t AS k, (y + dy)::INT AS y, (x + dx)::INT AS x FROM px, o WHERE v > 0.2::FLOAT AND y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7)"""


def _supports(spark, sf):
    grow = lambda b: _np.stack([_images.dilate(f > _np.float32(0.2)) for f in b.astype(_np.float32)]).astype(float)
    return _pixels_of(frame_ops.map_frames(movie(spark, sf), H, W, grow)).where("v > 0").select(F.col("t").alias("k"), "y", "x")


@query(f"WITH {DIL} SELECT k, y, x FROM su")
def dilate_support(spark, sf):
    return _supports(spark, sf)


@query(f"WITH {DIL} SELECT y, x, count(*) AS n, min(k) AS first, max(k) AS last, sum(k)::BIGINT AS total FROM su GROUP BY y, x")
def pixel_candidates(spark, sf):
    return _supports(spark, sf).groupBy("y", "x").agg(F.count("*").alias("n"), F.min("k").alias("first"), F.max("k").alias("last"), F.sum("k").alias("total"))


@query(f"WITH {PX}, q AS (SELECT t, p, v, min(v) OVER (PARTITION BY t) AS lo, max(v) OVER (PARTITION BY t) AS hi FROM px) SELECT p, round(sum((v - lo) / (hi - lo)), 5) AS total FROM q GROUP BY p")
def projection_image(spark, sf):
    """Each footprint scaled to [0, 1]; their sum is the projection."""
    return stats.projection_image(movie(spark, sf)).select("p", r6(F.col("total"), 5).alias("total"))


@query(f"""WITH {PX}, {DFT}, sn AS (SELECT y, x, {NOISE['mean']} AS sn FROM psd GROUP BY y, x) SELECT px.p, count(*) FILTER (WHERE v >= 0.5 * round(sn, 6)) AS kept FROM px JOIN sn ON px.y = sn.y AND px.x = sn.x GROUP BY px.p""")
def pixel_threshold(spark, sf):
    """Values under a multiple of the pixel's noise count as zero."""
    sn = stats.noise_image(movie(spark, sf), "mean", None).select("p", F.round("sn", 6).alias("sn"))
    return stats.thresholded(movie(spark, sf), sn, 0.5).groupBy("p").agg(F.count_if("kept").alias("kept"))


@query(f"""WITH {PX}, seed AS (SELECT t, v AS s FROM px WHERE p = 27), c AS (SELECT p, corr(v, s) AS r FROM px JOIN seed USING (t) GROUP BY p)
SELECT p, CASE WHEN r > 0.7 THEN 'neuron' WHEN r < 0.3 THEN 'background' ELSE 'between' END AS part, round(r, 6) + 0.0 AS r FROM c""")
def seed_correlation(spark, sf):
    return stats.seed_correlations(movie(spark, sf), 27).select("p", "part", r6(F.col("r")).alias("r"))


# -- traces


@query(f"""WITH {TR}, q AS (SELECT *, count(*) OVER w AS n, min(v) OVER w AS lo FROM tr WINDOW w AS (PARTITION BY k)),
ok AS (SELECT * FROM q WHERE lo > 0 AND n > 10), la AS (SELECT k, quantile_cont(v, 0.2) AS l FROM ok WHERE t >= n - 10 GROUP BY k),
b AS (SELECT k, t, v, n, quantile_cont(v, 0.2) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS r FROM ok)
SELECT b.k, t, round((v - CASE WHEN t <= n - 12 THEN r ELSE l END) / CASE WHEN t <= n - 12 THEN r ELSE l END, 6) + 0.0 AS dff FROM b JOIN la ON b.k = la.k""")
def dff(spark, sf):
    return traces.dff(event_traces(spark, sf), 10).select("k", "t", r6(F.col("dff")).alias("dff"))


@query(f"""WITH {TR}, q AS (SELECT k, t, avg(v) OVER w AS m, count(*) OVER w AS n FROM tr WINDOW w AS (PARTITION BY k ORDER BY t ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)),
z AS (SELECT k, t, CASE WHEN n = 10 THEN m ELSE 0 END AS m FROM q) SELECT k, t, round(m - 2 * pi() * floor(m / (2 * pi())), 6) + 0.0 AS v FROM z""")
def rolling_mean(spark, sf):
    return traces.rolling_mean(event_traces(spark, sf)).select("k", "t", r6(F.col("v")).alias("v"))


@query(f"WITH {TR}, d AS (SELECT k, v - lag(v) OVER (PARTITION BY k ORDER BY t) AS d FROM tr) SELECT k, round(max(d), 6) AS top, round(stddev_pop(d), 6) AS spread, max(d) >= 3 * stddev_pop(d) AS keep FROM d WHERE d IS NOT NULL GROUP BY k")
def diff_heuristic(spark, sf):
    return traces.jumps(event_traces(spark, sf)).select("k", r6(F.col("top")).alias("top"), r6(F.col("spread")).alias("spread"), "keep")


ACOV = f"""{TR}, z AS (SELECT k, t, v - avg(v) OVER (PARTITION BY k) AS z, count(*) OVER (PARTITION BY k) AS n FROM tr),
ac AS (SELECT a.k, l::INT AS lag, sum(a.z * b.z) / max(a.n) AS v FROM z a, range(7) r(l), z b WHERE b.k = a.k AND b.t = a.t + l GROUP BY 1, 2)"""


@query(f"WITH {ACOV} SELECT k, lag, round(v, 6) + 0.0 AS v FROM ac")
def autocov(spark, sf):
    return traces.autocovariance(event_traces(spark, sf), 6).select("k", "lag", r6(F.col("v")).alias("v"))


WELCH = f"""{TR}, c AS (SELECT k, t, count(*) OVER (PARTITION BY k) AS n, v - avg(v) OVER (PARTITION BY k) AS z FROM tr),
wz AS (SELECT k, t, n, z * (0.5 - 0.5 * cos(2 * pi() * t / n)) AS z FROM c), wn AS (SELECT k, max(n) AS n, sum(power(0.5 - 0.5 * cos(2 * pi() * t / n), 2)) AS s FROM c GROUP BY k),
f AS (SELECT wz.k, f, sum(z * cos(2 * pi() * ((f * t) % n) / n)) AS re, sum(z * sin(2 * pi() * ((f * t) % n) / n)) AS im FROM wz, unnest(range(0, n // 2 + 1)) u(f) WHERE 4 * f > n AND 2 * f < n GROUP BY 1, 2),
tn AS (SELECT f.k, sqrt(exp(avg(ln((re * re + im * im) / s)))) AS sn FROM f JOIN wn ON f.k = wn.k GROUP BY f.k)"""


@query(f"WITH {WELCH} SELECT k, round(sn, 6) AS sn FROM tn")
def trace_noise(spark, sf):
    """Traces here are shorter than a Welch segment, which then is the whole trace."""
    return traces.trace_noise(event_traces(spark, sf)).select("k", r6(F.col("sn")).alias("sn"))


@query(f"""WITH {ACOV}, {WELCH.removeprefix(TR + ', ')}, a AS (SELECT ac.k, lag, v - CASE WHEN lag = 0 THEN sn * sn ELSE 0 END AS a FROM ac JOIN tn ON ac.k = tn.k WHERE lag <= 5),
g AS (SELECT a.k, sum(a * b.v) / sum(a * a) AS g FROM a JOIN ac b ON a.k = b.k AND b.lag = a.lag + 1 GROUP BY a.k)
SELECT k, round(0.96 * CASE WHEN g > 1 THEN 0.95 WHEN g < 0 THEN 0.15 ELSE g END, 5) AS g FROM g""")
def ar1_coef(spark, sf):
    return traces.ar1_coefficient(event_traces(spark, sf), 5, 0.96).select("k", r6(F.col("g"), 5).alias("g"))


@query(f"WITH {TR} SELECT a.k, a.t, round(sum(power(0.7, a.t - b.t) * b.v) + 1e-9, 5) + 0.0 AS c FROM tr a JOIN tr b ON a.k = b.k AND b.t <= a.t GROUP BY 1, 2")
def ar1_filter(spark, sf):
    return traces.ar1_filter(event_traces(spark, sf), 0.7).select("k", "t", r6(F.col("c") + 1e-9, 5).alias("c"))


@query(f"""WITH {TR}, n AS (SELECT k, max(t) AS last FROM tr GROUP BY k), y AS (SELECT tr.k, t, v - 50 - 2 * CASE WHEN t = last THEN 1 ELSE 0.2 END AS y FROM tr JOIN n ON tr.k = n.k),
seg AS (SELECT a.k, a.t AS i, b.t AS j, sum(b.y * power(0.8, b.t - a.t)) OVER w / sum(power(0.64, b.t - a.t)) OVER w AS m FROM y a JOIN y b ON a.k = b.k AND b.t >= a.t WINDOW w AS (PARTITION BY a.k, a.t ORDER BY b.t)),
low AS (SELECT k, i, j, min(m) OVER (PARTITION BY k, i ORDER BY j DESC) AS m FROM seg)
SELECT k, j AS t, round(greatest(max(m * power(0.8, j - i)), 0), 4) + 0.0 AS c FROM low GROUP BY k, j""")
def oasis_ar1(spark, sf):
    """The pooled solution equals a max-min over segment averages."""
    t = event_traces(spark, sf).withColumn("v", F.col("v") - 50)
    return traces.deconvolve(t, 0.8, 2.0).select("k", F.posexplode("c").alias("t", "c")).select("k", F.col("t").cast("bigint").alias("t"), r6(F.col("c"), 4).alias("c"))


@query(f"""WITH {TR}, y AS (SELECT k, t, v - 50 AS y FROM tr),
seg AS (SELECT a.k, a.t AS i, b.t AS j, sum(b.y * power(0.8, b.t - a.t)) OVER w / sum(power(0.64, b.t - a.t)) OVER w AS m FROM y a JOIN y b ON a.k = b.k AND b.t >= a.t WINDOW w AS (PARTITION BY a.k, a.t ORDER BY b.t)),
low AS (SELECT k, i, j, min(m) OVER (PARTITION BY k, i ORDER BY j DESC) AS m FROM seg)
SELECT k, j AS t, round(greatest(max(m * power(0.8, j - i)), 0), 4) + 0.0 AS c FROM low GROUP BY k, j""")
def oasis_stream(spark, sf):
    """The online operator over a stream of trace files, the last word on each frame."""
    from somaflow.streaming.oasis_stream import run_to_end

    out = run_to_end(event_traces(spark, sf).withColumn("v", F.col("v") - 50), 0.8)
    return out.select("k", "t", r6(F.col("c"), 4).alias("c"))


@query(f"""WITH {TR}, m AS (SELECT k, t, CASE WHEN (t * 7 + k) % 5 = 0 THEN NULL ELSE v END AS v FROM tr),
q AS (SELECT k, t, v, max(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY k ORDER BY t) AS b, min(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM m)
SELECT q.k, q.t, round(CASE WHEN b IS NULL THEN fv.v WHEN f IS NULL OR f = b THEN bv.v ELSE bv.v + (q.t - b)::DOUBLE / (f - b) * (fv.v - bv.v) END, 6) AS v
FROM q LEFT JOIN m bv ON bv.k = q.k AND bv.t = b LEFT JOIN m fv ON fv.k = q.k AND fv.t = f""")
def nan_interp(spark, sf):
    t = event_traces(spark, sf)
    return traces.interpolated(t.withColumn("v", F.when((F.col("t") * 7 + F.col("k")) % 5 == 0, F.lit(float("nan"))).otherwise(F.col("v")))).select("k", "t", r6(F.col("v")).alias("v"))


@query(f"WITH {TR} SELECT a.k AS i, b.k AS j, round(corr(a.v, b.v), 6) + 0.0 AS r FROM tr a JOIN tr b ON a.t = b.t AND b.k = a.k + 1 GROUP BY 1, 2")
def trace_corr(spark, sf):
    t = event_traces(spark, sf)
    k = t.select("k").distinct()
    pairs = k.select(F.col("k").alias("i"), (F.col("k") + 1).alias("j")).join(k.select(F.col("k").alias("j")), "j", "left_semi")
    return traces.correlations(t, pairs).select("i", "j", r6(F.col("r")).alias("r"))


@query(f"WITH {TR} SELECT k, round(sqrt(sum(v * v)), 5) AS norm, round(least(greatest(min(v), 1), 90), 6) AS lo, round(least(max(v), 90), 6) AS hi FROM tr GROUP BY k")
def trace_norm(spark, sf):
    """Frobenius norm for convergence tests, and values clipped to a range."""
    held = traces.clipped(event_traces(spark, sf).withColumn("raw", F.col("v")), 1, 90)
    high = F.least(F.max("raw"), F.lit(90.0))
    return held.groupBy("k").agg(r6(traces.norm("raw"), 5).alias("norm"), r6(F.min("v")).alias("lo"), r6(high).alias("hi"))


# -- catalogues, bins


@query("SELECT o_custkey AS movie, o_orderkey AS num, floor(o_totalprice)::BIGINT AS duration, (sum(floor(o_totalprice)) OVER w - floor(o_totalprice))::BIGINT AS start, (sum(floor(o_totalprice)) OVER w)::BIGINT AS stop FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def video_offsets(spark, sf):
    """Where each video of a movie starts and ends: a customer is a movie, its orders the videos."""
    from somaflow.sources.videos import offsets

    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("movie"), F.col("o_orderkey").alias("num"), F.floor("o_totalprice").alias("duration"))
    return offsets(o)


@query(r"SELECT page_id, regexp_extract_all(url, '\d+')[-1]::BIGINT - 1 AS num FROM pages WHERE len(regexp_extract_all(url, '\d+')) > 0")
def video_ordinal(spark, sf):
    from somaflow.sources.videos import ordinal

    return table(spark, sf, "pages").select("page_id", ordinal(F.col("url")).alias("num")).where("num is not null")


@query("""WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT least(floor((p_retailprice - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n FROM part, b GROUP BY 1""")
def histogram(spark, sf):
    return stats.histogram(table(spark, sf, "part"), "p_retailprice", 20)


@query("SELECT event_type, round(quantile_cont(value, 0.15), 6) AS p15, round(quantile_cont(value, 0.2), 6) AS p20, round(quantile_cont(value, 0.75), 6) AS p75 FROM events GROUP BY event_type")
def percentiles(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(*(r6(F.percentile("value", F.lit(q / 100))).alias(f"p{q}") for q in (15, 20, 75)))


# -- integer registration


SHIFTS = "sh AS (SELECT dy::INT AS dy, dx::INT AS dx FROM range(-2, 3) a(dy), range(-2, 3) b(dx))"


@query(f"""WITH {PX}, {SHIFTS}, tm AS (SELECT y, x, round(median(v), 6) AS m FROM px WHERE t < 500 GROUP BY y, x),
c AS (SELECT px.t, dy, dx, round(corr(px.v, m), 6) AS r FROM tm, sh, px WHERE tm.y BETWEEN 2 AND 5 AND tm.x BETWEEN 2 AND 5 AND px.y = tm.y + dy AND px.x = tm.x + dx GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY r DESC, dy, dx) AS k FROM c) SELECT t, -dy AS shift_y, -dx AS shift_x, r + 0.0 AS r FROM k WHERE k = 1""")
def ncc_shift_int(spark, sf):
    from somaflow.operators.motion import rigid_shifts

    m = movie(spark, sf)
    tm = stats.template(layout.in_range(m, 0, 500)).orderBy("p")
    image = _np.round([r["template"] for r in geometry.checked(tm, "pixels of one image", 1 << 21)], 6).reshape(H, W)
    return rigid_shifts(m, image, 2).select("t", "shift_y", "shift_x", r6(F.col("r")).alias("r"))


@query(f"""WITH {PX}, {SHIFTS}, tm AS (SELECT y, x, round(median(v), 6) AS m FROM px WHERE t < 500 GROUP BY y, x),
c AS (SELECT px.t, dy, dx, round(abs(sum(px.v * m)), 6) AS r FROM tm, sh, px WHERE dy < 2 AND dx < 2 AND px.y = (tm.y + dy + 8) % 8 AND px.x = (tm.x + dx + 8) % 8 GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY r DESC, (dy + 8) % 8, (dx + 8) % 8) AS k FROM c) SELECT t, dy AS shift_y, dx AS shift_x, r + 0.0 AS r FROM k WHERE k = 1""")
def xcorr_shift_int(spark, sf):
    from somaflow.operators.motion import circular_shifts

    m = movie(spark, sf)
    tm = stats.template(layout.in_range(m, 0, 500)).orderBy("p")
    image = _np.round([r["template"] for r in geometry.checked(tm, "pixels of one image", 1 << 21)], 6).reshape(H, W)
    return circular_shifts(m, image, (2, 2)).select("t", "shift_y", "shift_x", r6(F.col("r")).alias("r"))


@query("""SELECT event_id, least(3.0 * (event_id % 3) + 2.5, 8)::DOUBLE AS x, least(3.0 * ((event_id // 3) % 3) + 2.5, 8)::DOUBLE AS y,
CASE WHEN event_id % 5 = 0 AND event_id % 7 < 4 THEN NULL ELSE event_id % 5 END AS u, CASE WHEN event_id % 5 = 0 AND event_id % 7 < 4 THEN NULL ELSE CASE WHEN event_id % 7 < 4 THEN 0 ELSE 1 END END AS v FROM events""")
def vector_field(spark, sf):
    """Patch midpoints with their shifts; a patch that didn't move has none.  Shifts are made from the event ids."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    shifts = e.select("event_id", (F.floor(i / 3) % 3).alias("i"), (i % 3).alias("j"), F.when(i % 7 < 4, 0).otherwise(1).alias("dy"), (i % 5).alias("dx"))
    return geometry.vector_field(shifts, H, W, (3, 3), (5, 5)).select("event_id", "x", "y", "u", "v")

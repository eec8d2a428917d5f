"""Queries that run the engine's own kernels.

Where SQL can't find a result, it can often state what has to hold for it: such a
query gives by how much the result misses its optimality conditions, and the SQL
says nought; a parameter that was chosen is graded beside it.  Five queries have no SQL; their tests compare with closed forms.
Iterative ones write their rounds below the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaflow.folders import new_folder
from somaflow.functions import extraction as fx
from somaflow.operators import background, extraction, geometry, layout, motion, ring, traces
from somaflow.params import ExtractionParams, InitParams, MergeParams, PatchParams, SpatialParams, TemporalParams
from somaflow.plans import catalogue as base

H, W = base.H, base.W


def _save(spark: SparkSession):
    return motion.session_save(spark, new_folder(spark, "run"))


def _missed(y: np.ndarray, c: np.ndarray, s: np.ndarray, bl: float, g: float, lam: float) -> dict:
    """By how much a deconvolved trace misses the conditions of its optimum, each at its worst frame.

    primal: c decays by g but for activity s, and neither is negative.  dual: no
    activity would pay, by what the residual gains from it later less its price;
    slack: where there is activity, it pays exactly.
    """
    n = len(y)
    rise = np.append(c[:1], c[1:] - g * c[:-1])
    price = lam * np.append(np.full(n - 1, 1 - g), 1.0)
    gain = np.zeros(n)  # d objective / d rise at t, with the sign turned
    ahead = 0.0
    for t in range(n - 1, -1, -1):
        ahead = (y[t] - bl - c[t] - price[t]) + g * ahead
        gain[t] = ahead
    scale = max(1.0, float(np.abs(y).max()))
    primal = max(0.0, -rise.min(), -c.min(), np.abs(rise[1:] - s[1:]).max(initial=0))
    return {"n": n, "primal": primal / scale, "dual": max(0.0, float(gain.max())) / scale, "slack": float(np.abs(gain * (rise > 1e-9 * scale)).max()) / scale}


def oasis_constrained(spark: SparkSession, sf: str) -> DataFrame:
    """(k, n, residual, primal, dual, slack): the noise-constrained deconvolution of each trace.

    residual: its squared residual over the noise's; that is 1, or what the
    trace's mean alone leaves if that is less.  Then by how much it misses its
    optimum for the penalty that it chose.
    """

    @F.pandas_udf("n long, residual double, primal double, dual double, slack double")
    def missed(*columns: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(*columns):
            y, c, s, bl, g, lam, sn = (np.asarray(v, float) if i < 3 else v for i, v in enumerate(row))
            left = y - bl - c
            out.append({"residual": float(left @ left / (len(y) * sn**2))} | _missed(y, c, s, bl, g, lam))
        return pd.DataFrame(out)[["n", "residual", "primal", "dual", "slack"]]

    events = base.event_traces(spark, sf)
    r = traces.foopsi(events).join(layout.series(events, "k"), "k").select("k", missed("y", "c", "s", "bl", "g", "lam", "sn").alias("m")).select("k", "m.*")
    return r.select("k", "n", base.r6(F.col("residual"), 4).alias("residual"), *(base.r6(F.col(c), 5).alias(c) for c in ("primal", "dual", "slack")))


#: Decay and price of the second-order row: fixed, so that its optimum is one.
SECOND_ORDER, PRICE = (1.2, -0.3), 2.0


def oasis_stream_second_order(spark: SparkSession, sf: str) -> DataFrame:
    """(k, t, below, gain, slack): by how much each frame of the streamed second-order deconvolution misses its optimum.

    With decay and price fixed there is one trace that misses nothing: activity
    isn't negative (below), would not pay anywhere (gain), and pays exactly
    where there is some (slack).
    """
    from somaflow.streaming.oasis_stream import SHARE, run_to_end

    events = base.event_traces(spark, sf)
    out = run_to_end(events.withColumn("v", F.col("v") - 50), SECOND_ORDER, PRICE)
    both = out.join(events.select("k", "t", F.col("v").alias("y")), ["k", "t"])

    def conditions(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of the neurons of a group, each from its own first and last frame on."""
        pdf, (g1, g2) = pdf.sort_values(["k", "t"]), SECOND_ORDER
        k, c = pdf["k"].to_numpy(), pdf["c"].to_numpy()
        ends = np.append(k[1:] != k[:-1], True)
        starts = np.append(0, np.flatnonzero(ends)[:-1] + 1)
        age = np.arange(len(k)) - np.repeat(starts, np.diff(np.append(starts, len(k))))
        s = c - g1 * np.where(age > 0, np.roll(c, 1), 0) - g2 * np.where(age > 1, np.roll(c, 2), 0)
        gain, one, two = [], 0.0, 0.0
        left = pdf["y"].to_numpy() - 50 - c - PRICE * (1 - g1 - g2)
        for r, end in zip(left[::-1].tolist(), ends[::-1].tolist()):
            if end:
                one = two = 0.0
            one, two = r + g1 * one + g2 * two, one
            gain.append(one)
        up = np.array(gain[::-1])
        return pd.DataFrame({"k": k, "t": pdf["t"], "below": np.maximum(-s, 0), "gain": np.maximum(up, 0), "slack": np.abs(up) * (s > 1e-6)})

    made = both.groupBy(F.floor(F.col("k") / SHARE)).applyInPandas(conditions, "k long, t long, below double, gain double, slack double")
    return made.select("k", "t", *(base.r6(F.col(c), 5).alias(c) for c in ("below", "gain", "slack")))


def trace_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """(k, g, sn): decay and noise as the deconvolution of each trace estimates them."""
    return traces.foopsi(base.event_traces(spark, sf)).select("k", base.r6(F.col("g"), 5).alias("g"), base.r6(F.col("sn")).alias("sn"))


def spatial_lasso(spark: SparkSession, sf: str) -> DataFrame:
    """(p, k, alpha, missed): every pixel's series regressed on ten traces, its penalty, and by how much each weight misses its condition.

    A weight's gradient equals the penalty where it is positive and doesn't exceed it elsewhere.
    """
    px = layout.pixels(base.movie(spark, sf))
    c = base.linear.product(px, base.mean_footprints(spark, sf), "p", "t", "k", "v", "a")
    rows = geometry.checked(layout.series(c, "k"), "traces of one patch")
    rows = sorted(rows, key=lambda r: r["k"])
    names, c = [r["k"] for r in rows], np.array([r["y"] for r in rows]).T
    centred, n = c - c.mean(axis=0), len(c)
    gram, energy = centred.T @ centred / n, (c**2).sum(axis=0)

    def task(batches):
        from somaflow.operators.stats import spectrum_noise

        for batch in batches:
            out = []
            for p, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                y = np.asarray(y)
                alpha = 0.5 * spectrum_noise(y, "mean") * np.sqrt(energy.max()) / n
                a = fx.nonneg_lasso(gram, centred.T @ (y - y.mean()) / n, float(alpha))
                gradient = centred.T @ (y - y.mean() - centred @ a) / n - alpha  # from the residual, not the products that were solved with
                missed = np.where(a > 0, np.abs(gradient), np.maximum(gradient, 0)) + np.maximum(-a, 0)
                out += [{"p": p, "k": k, "alpha": float(alpha), "missed": v} for k, v in zip(names, missed.tolist())]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("p", pa.int32()), ("k", pa.int64()), ("alpha", pa.float64()), ("missed", pa.float64())]))

    return layout.series(px, "p").mapInArrow(task, "p int, k long, alpha double, missed double").select("p", "k", base.r6(F.col("alpha")).alias("alpha"), base.r6(F.col("missed")).alias("missed"))


def _patch_map(spark: SparkSession, sf: str, schema: str, kernel) -> DataFrame:
    """``kernel(movie, where)`` rows for each of two patches, each fitted in one task."""
    patches = geometry.analysis_patches(H, W, (1, 2), 4)
    bounds = {p[0]: p[1:] for p in patches}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y0, y1, x0, x1 = bounds[int(key[0])]
        movie = np.stack([np.frombuffer(b, "<f4") for b in pdf.sort_values("t")["px"]]).astype(float).reshape(len(pdf), y1 - y0, x1 - x0)
        return pd.DataFrame([(int(key[0]), *r) for r in kernel(movie)], columns=[c.split()[0] for c in schema.split(", ")])

    return extraction.patch_movies(base.movie(spark, sf), W, patches).groupBy("patch").applyInPandas(run, schema)


def ring_weights(spark: SparkSession, sf: str) -> DataFrame:
    """(patch, i, j, missed): pixel i of a patch explained by the ring pixels j around it.

    What the ring leaves of the pixel is uncorrelated with each of the ring's pixels.
    """

    def kernel(movie):
        y = movie.reshape(len(movie), -1)
        x = y - y.mean(axis=0)
        near, weights = fx.ring_weights(x, movie.shape[1:], 2)
        rows = []
        for i in range(len(near)):
            ring = near[i][near[i] >= 0]
            left = x[:, i] - x[:, ring] @ weights[i][near[i] >= 0]
            rows += [(i, int(j), float(abs(left @ x[:, j]) / max(1e-12, np.sqrt((x[:, i] ** 2).sum() * (x[:, j] ** 2).sum())))) for j in ring]
        return rows

    return _patch_map(spark, sf, "patch int, i int, j int, missed double", kernel).select("patch", "i", "j", base.r6(F.col("missed")).alias("missed"))


def ring_image(spark: SparkSession, sf: str) -> DataFrame:
    """(p, q, missed): pixel p of the whole image explained by the ring pixels q around it.

    What the ring leaves of p is uncorrelated with each q, which has one solution.
    """
    movie = base.movie(spark, sf)
    weights = ring.ring_weights(movie, H, W, 2).select("p", F.explode(F.arrays_zip("near", "weights")).alias("z")).select("p", F.col("z.near").alias("j"), F.col("z.weights").alias("w"))
    px = layout.pixels(movie).select("t", "p", F.col("v").cast("double").alias("v"))
    centred = px.join(px.groupBy("p").agg(F.avg("v").alias("m")), "p").select("t", "p", (F.col("v") - F.col("m")).alias("v"))
    half = base.linear.gram(centred, "t", "p", "v")
    cov = half.unionByName(half.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    size = cov.where("i = j").select("i", "v")
    told = weights.join(weights.select("p", F.col("j").alias("q")), "p").join(cov.select(F.col("i").alias("j"), F.col("j").alias("q"), "v"), ["j", "q"]).groupBy("p", "q").agg(F.sum(F.col("w") * F.col("v")).alias("told"))
    both = told.join(cov.select(F.col("i").alias("p"), F.col("j").alias("q"), "v"), ["p", "q"]).join(size.select(F.col("i").alias("p"), F.col("v").alias("vp")), "p").join(size.select(F.col("i").alias("q"), F.col("v").alias("vq")), "q")
    return both.select(F.col("p").cast("int").alias("p"), F.col("q").cast("int").alias("q"), base.r6(F.abs(F.col("v") - F.col("told")) / F.sqrt(F.col("vp") * F.col("vq"))).alias("missed"))


def _labelled_components(spark: SparkSession, sf: str) -> DataFrame:
    """Footprints of each label with the movie's product as traces."""
    f = base.mean_footprints(spark, sf)
    c = layout.series(base.linear.product(layout.pixels(base.movie(spark, sf)), f, "p", "t", "k", "v", "a"), "k")
    sparse = f.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("p", "a"))).alias("z"))
    return sparse.join(c, "k").select("k", F.lit(0).alias("patch"), F.col("z.p").alias("px"), F.col("z.a").alias("a"), F.col("y").alias("c"), F.col("y").alias("s"), F.col("y").alias("yra"))


#: Correlation from which the row's components are merged.
MERGED = 0.1


def merge_order(spark: SparkSession, sf: str) -> DataFrame:
    """(k, root, place, total): the groups that a round of merging makes, in the order of their summed correlation."""
    params = replace(_SMALL, merge_params=MergeParams(thr=MERGED, compat=False))
    groups, order = extraction.merge_plan(_labelled_components(spark, sf), params, _save(spark))
    return groups.join(order, "root").select("k", "root", "place", base.r6(F.col("total"), 5).alias("total"))


def evaluated_ids(spark: SparkSession, sf: str) -> DataFrame:
    """(k, unit): the components that the final update keeps, all of them, and the length of their footprints.

    A frame of the movie is its label's mean footprint, and frames go by label, so that each component is active once.
    """
    e = base.table(spark, sf, "embeddings").select((F.col("label").cast("bigint") * (1 << 40) + F.col("vec_id")).alias("t"), F.col("label").cast("bigint").alias("k"), F.lit(5.0).alias("v"))
    parts = _labelled_components(spark, sf).select("k", "patch", "px", "a")
    image = F.transform(F.sequence(F.lit(0), F.lit(H * W - 1)), lambda p: F.coalesce(F.try_element_at(F.map_from_arrays("px", "a"), p), F.lit(0.0)))
    frames = e.join(parts.select("k", image.alias("image")), "k").select("t", F.transform("image", lambda x: x * F.col("v")).alias("px"))
    traces_ = parts.select("k").crossJoin(e.select("t", F.col("k").alias("own"), "v")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("t", F.when(F.col("k") == F.col("own"), F.col("v")).otherwise(0.0).alias("c")))).alias("z"))
    both = parts.join(traces_.select("k", F.col("z.c").alias("c")), "k").select("*", F.col("c").alias("s"), F.col("c").alias("yra"))
    none = spark.createDataFrame([], "component int, b array<double>, f array<double>")
    params = replace(_SMALL, spatial_params=SpatialParams(thr_method="max", maxthr=0.0, extract_cc=False))
    found = extraction.evaluate(frames, both, none, H, W, params, _save(spark))
    return found.select("k", base.r6(F.sqrt(F.aggregate("a", F.lit(0.0), lambda s, x: s + x * x))).alias("unit"))


def nmf_background(spark: SparkSession, sf: str) -> DataFrame:
    """(patch, component, px, b): low-rank background of each patch."""

    def kernel(movie):
        b, _ = fx.low_rank_background(movie.reshape(len(movie), -1), 2)
        return [(k, p, float(v)) for k, row in enumerate(b) for p, v in enumerate(row)]

    return _patch_map(spark, sf, "patch int, component int, px int, b double", kernel)


def compressed_background(spark: SparkSession, sf: str) -> DataFrame:
    """(part, i, v): one image (part b, by pixel) and its trace (part f, by frame) for the backgrounds of four patches that overlap.

    A patch has two parts, one for frames of odd and one of even label: the mean
    of its clipped frames, and the patch's mean in those frames.
    """
    e = base.table(spark, sf, "embeddings").select(F.col("vec_id").alias("t"), (F.col("label") % 2).alias("own"), F.posexplode("embedding").alias("p", "v"))
    px = geometry.in_patches(e.withColumns({"y": (F.col("p") / W).cast("int"), "x": F.col("p") % W, "v": F.col("v").cast("double")}), geometry.analysis_patches(H, W, (2, 2), 2))
    images = px.groupBy("patch", F.col("own").alias("g"), "p").agg(F.avg(F.greatest("v", F.lit(0.0))).alias("b"))
    images = images.groupBy("patch", "g").agg(F.array_sort(F.collect_list(F.struct("p", "b"))).alias("z")).select("patch", "g", F.col("z.p").alias("px"), F.col("z.b").alias("b"))
    levels = px.groupBy("patch", "own", "t").agg(F.avg("v").alias("m")).withColumn("g", F.explode(F.array(F.lit(0), F.lit(1))))
    levels = levels.groupBy("patch", "g").agg(F.array_sort(F.collect_list(F.struct("t", F.when(F.col("g") == F.col("own"), F.col("m")).otherwise(0.0).alias("f")))).alias("z"))
    parts, _ = background.compressed(images.join(levels.select("patch", "g", F.col("z.f").alias("f")), ["patch", "g"]), H * W, 1, rounds=2, save=_save(spark))
    one = lambda c: parts.select(F.lit(c).alias("part"), F.posexplode(c).alias("i", "v"))
    return one("b").unionByName(one("f")).select("part", "i", base.r6(F.col("v")).alias("v"))


def threshold_components(spark: SparkSession, sf: str) -> DataFrame:
    """(k, p, a): footprints after median, energy threshold, closing and choice of the largest region."""
    from somaflow.operators.frames import map_frames

    clean = lambda b: np.stack([fx.threshold_component(np.maximum(f, 0).ravel(), (H, W), nrgthr=0.95).reshape(H, W) for f in b])
    long = layout.pixels(map_frames(base.movie(spark, sf), H, W, clean))
    return long.where("v > 0").select(F.col("t").alias("k"), "p", base.r6(F.col("v")).alias("a"))


def motion_correct(spark: SparkSession, sf: str) -> DataFrame:
    """(t, px): the movie corrected in blocks against a template that follows it."""
    params = motion.MotionParams(strides=(4, 4), overlaps=(2, 2), max_deviation_rigid=1, max_shifts=(1, 1), nb_round=1, filter_size=2, filter_size_patch=1, block_size=500)
    return motion.motion_correct(base.movie(spark, sf), H, W, params, _save(spark), motion.RUN_VALUES)


_SMALL = ExtractionParams(
    patch_params=PatchParams((1, 2), 4),
    init_params=InitParams(gSig=(1, 1), gSiz=(2, 2), ssub=1, tsub=1, min_corr=-1, min_pnr=0.01, thresh_init=-100, bd=0, min_pixel=1),
    temporal_params=TemporalParams(nb=2),
)


def patch_fit(spark: SparkSession, sf: str) -> DataFrame:
    """(patch, kind, px, a): what each patch's fit finds, components (kind 0) and background (kind 1)."""
    return extraction.fit_patches(base.movie(spark, sf), H, W, _SMALL).select("patch", "kind", "px", "a")


def extract(spark: SparkSession, sf: str) -> DataFrame:
    """(kind, k, p, a) of the whole extraction: footprints (kind 0) and background parts (kind 1)."""
    r = extraction.extract(base.movie(spark, sf), H, W, _SMALL, _save(spark))
    back = r.background.select(F.lit(1).alias("kind"), F.col("component").cast("bigint").alias("k"), F.posexplode("b").alias("p", "a"))
    return r.footprints().select(F.lit(0).alias("kind"), "k", "p", "a").unionByName(back)


def merge_components(spark: SparkSession, sf: str) -> DataFrame:
    """(k, px, a): footprints with mean traces, merged within each label's patch."""
    return extraction.merge_components(_labelled_components(spark, sf), _SMALL, _save(spark)).select("k", "px", "a")


def queries() -> dict:
    every = (oasis_constrained, oasis_stream_second_order, trace_parameters, spatial_lasso, ring_weights, ring_image, merge_order, evaluated_ids, nmf_background, compressed_background, threshold_components, motion_correct, patch_fit, extract, merge_components)
    return {f.__name__: f for f in every}


#: Median of 3 x 3, energy threshold, closing, 8-connected regions, the one of most energy.
_THRESHOLD = f"""{base.PX}, s AS (SELECT dy::INT AS dy, dx::INT AS dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx)),
sp AS (SELECT y, x, greatest(0, least(7, y + dy)) AS sy, greatest(0, least(7, x + dx)) AS sx FROM range(8) a(y), range(8) b(x), s),
md AS (SELECT t, sp.y::INT AS y, sp.x::INT AS x, median(greatest(px.v, 0)) AS v FROM sp JOIN px ON px.y = sy AND px.x = sx GROUP BY 1, 2, 3),
en AS (SELECT *, sum(v * v) OVER (PARTITION BY t ORDER BY v DESC, y, x) AS e, sum(v * v) OVER (PARTITION BY t) AS total FROM md),
cut AS (SELECT t, min(v) AS cut FROM en WHERE e < 0.95 * total GROUP BY t),
im AS (SELECT md.t, y, x, CASE WHEN v >= cut THEN v ELSE 0 END AS v, v >= cut AS b FROM md JOIN cut ON md.t = cut.t),
di AS (SELECT m.t, m.y, m.x, bool_or(n.b) AS b FROM im m, s, im n WHERE n.t = m.t AND n.y = m.y + dy AND n.x = m.x + dx GROUP BY 1, 2, 3),
er AS (SELECT m.t, m.y, m.x FROM di m, s, di n WHERE n.t = m.t AND n.y = m.y + dy AND n.x = m.x + dx GROUP BY 1, 2, 3 HAVING bool_and(n.b) AND count(*) = 9),
reach AS (SELECT t, y, x, y * 8 + x AS r FROM er UNION SELECT er.t, er.y, er.x, reach.r FROM reach, s, er WHERE er.t = reach.t AND er.y = reach.y + dy AND er.x = reach.x + dx),
rg AS (SELECT t, y, x, min(r) AS r FROM reach GROUP BY 1, 2, 3),
re AS (SELECT rg.t, r, sum(v * v) AS e FROM rg JOIN im ON im.t = rg.t AND im.y = rg.y AND im.x = rg.x GROUP BY 1, 2),
best AS (SELECT t, r FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY e DESC, r) AS n FROM re) WHERE n = 1)"""

_ZERO = "0.0::DOUBLE"


def _background_sql(rounds: int = 2) -> str:
    """One image and one trace, each in turn the least-squares fit to the other."""
    text = f"""WITH {base.PX}, pt AS (SELECT * FROM (VALUES (0, 0, 4, 0, 4), (1, 0, 4, 3, 7), (2, 3, 7, 0, 4), (3, 3, 7, 3, 7)) v(patch, y0, y1, x0, x1)),
inside AS (SELECT patch, px.t, p, v, label % 2 AS own FROM px JOIN embeddings ON vec_id = px.t JOIN pt ON y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1),
cover AS (SELECT p, count(DISTINCT patch) AS n FROM inside GROUP BY p),
b AS (SELECT patch * 2 + own AS i, inside.p, avg(greatest(v, 0)) / max(n) AS b FROM inside JOIN cover ON cover.p = inside.p GROUP BY 1, 2),
f AS (SELECT patch * 2 + g AS i, t, CASE WHEN g = own THEN m ELSE 0 END AS f FROM (SELECT patch, own, t, avg(v) AS m FROM inside GROUP BY 1, 2, 3), range(2) r(g)),
g0 AS (SELECT t, avg(f) AS g FROM f GROUP BY t)"""
    for k in range(rounds):
        text += f""",
u{k} AS (SELECT t, g / greatest((SELECT sqrt(sum(g * g)) FROM g{k}), 1e-12) AS g FROM g{k}),
m{k} AS (SELECT i, sum(g * f) AS m FROM u{k} JOIN f ON f.t = u{k}.t GROUP BY i),
s{k} AS (SELECT p, greatest(sum(m * b) / ((SELECT sum(g * g) FROM u{k}) + 1e-9), 0) AS s FROM b JOIN m{k} ON m{k}.i = b.i GROUP BY p),
p{k} AS (SELECT i, sum(b * s) AS v FROM b JOIN s{k} ON s{k}.p = b.p GROUP BY i),
g{k + 1} AS (SELECT t, sum(f * v) / ((SELECT sum(s * s) FROM s{k}) + 1e-9) AS g FROM f JOIN p{k} ON p{k}.i = f.i GROUP BY t)"""
    norm = f"(SELECT greatest(sqrt(sum(s * s)), 1e-12) FROM s{rounds - 1})"
    return f"{text} SELECT 'b' AS part, p::INT AS i, round(s / {norm}, 6) + 0.0 AS v FROM s{rounds - 1} UNION ALL SELECT 'f', t::INT, round(g * {norm}, 6) + 0.0 FROM g{rounds}"


def oracle_sql() -> dict[str, str]:
    welch = base.WELCH.replace("sqrt(exp(avg(ln((re * re + im * im) / s))))", "sqrt(avg((re * re + im * im) / s))").removeprefix(base.TR + ", ")
    return {
        "oasis_constrained": f"""WITH {base.TR}, {welch}, al AS (SELECT k, count(*) AS n, sum(v * v) - count(*) * avg(v) * avg(v) AS e FROM tr GROUP BY k)
SELECT al.k, n, round(least(1, e / (n * sn * sn)), 4) AS residual, {_ZERO} AS primal, {_ZERO} AS dual, {_ZERO} AS slack FROM al JOIN tn ON al.k = tn.k""",
        "oasis_stream_second_order": f"SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, {_ZERO} AS below, {_ZERO} AS gain, {_ZERO} AS slack FROM events",
        "trace_parameters": f"""WITH {base.ACOV}, {welch}, a AS (SELECT ac.k, lag, v - CASE WHEN lag = 0 THEN sn * sn ELSE 0 END AS a FROM ac JOIN tn ON ac.k = tn.k WHERE lag <= 5),
g AS (SELECT a.k, sum(a * b.v) / sum(a * a) AS g FROM a JOIN ac b ON a.k = b.k AND b.lag = a.lag + 1 GROUP BY a.k)
SELECT g.k, round(least(greatest(0.96 * CASE WHEN g > 1 THEN 0.95 WHEN g < 0 THEN 0.15 ELSE g END, 0.001), 0.999), 5) AS g, round(sn, 6) AS sn FROM g JOIN tn ON g.k = tn.k""",
        "spatial_lasso": f"""WITH {base.PX}, {base.MF}, {base.DFT}, sn AS (SELECT y, x, {base.NOISE["mean"]} AS sn FROM psd GROUP BY y, x),
ct AS (SELECT t, k, sum(v * a) AS c FROM px JOIN mf ON mf.p = px.p GROUP BY t, k), en AS (SELECT max(e) AS e FROM (SELECT sum(c * c) AS e FROM ct GROUP BY k))
SELECT (y * 8 + x)::INT AS p, k, round(0.5 * sn * sqrt(e) / n.n, 6) + 0.0 AS alpha, {_ZERO} AS missed FROM sn, en, n, (SELECT DISTINCT label::BIGINT AS k FROM embeddings)""",
        "ring_weights": f"""WITH o AS (SELECT y, x FROM range(-3, 4) a(y), range(-3, 4) b(x) WHERE y * y + x * x > 4 AND y * y + x * x <= 9), g AS (SELECT * FROM (VALUES (0, 6), (1, 6)) v(patch, w))
SELECT patch::INT AS patch, (p.y * w + q.x)::INT AS i, ((p.y + o.y) * w + q.x + o.x)::INT AS j, {_ZERO} AS missed
FROM g, range(8) p(y), range(6) q(x), o WHERE p.y + o.y BETWEEN 0 AND 7 AND q.x + o.x BETWEEN 0 AND w - 1""",
        "compressed_background": _background_sql(),
        "ring_image": f"""WITH o AS (SELECT y, x FROM range(-3, 4) a(y), range(-3, 4) b(x) WHERE y * y + x * x > 4 AND y * y + x * x <= 9)
SELECT (p.y * 8 + q.x)::INT AS p, ((p.y + o.y) * 8 + q.x + o.x)::INT AS q, {_ZERO} AS missed FROM range(8) p(y), range(8) q(x), o WHERE p.y + o.y BETWEEN 0 AND 7 AND q.x + o.x BETWEEN 0 AND 7""",
        "merge_order": f"""WITH RECURSIVE {base.PX}, {base.MF}, ct AS (SELECT t, k, sum(v * a) AS c FROM px JOIN mf ON mf.p = px.p GROUP BY t, k),
ov AS (SELECT DISTINCT a.k AS i, b.k AS j FROM mf a JOIN mf b ON a.p = b.p AND a.k < b.k), r AS (SELECT i, j, corr(a.c, b.c) AS r FROM ov JOIN ct a ON a.k = i JOIN ct b ON b.k = j AND b.t = a.t GROUP BY i, j),
l AS (SELECT i, j FROM r WHERE r > {MERGED} UNION ALL SELECT j, i FROM r WHERE r > {MERGED}), reach AS (SELECT i AS k, i AS root FROM l UNION SELECT l.j, reach.root FROM reach JOIN l ON l.i = reach.k),
g AS (SELECT k, min(root) AS root FROM reach GROUP BY k), tot AS (SELECT a.root, sum(r) AS total FROM r JOIN g a ON a.k = i JOIN g b ON b.k = j AND a.root = b.root GROUP BY a.root)
SELECT k, g.root, place::INT AS place, round(total, 5) + 0.0 AS total FROM g JOIN (SELECT *, row_number() OVER (ORDER BY total DESC, root) AS place FROM tot) tot ON tot.root = g.root""",
        "evaluated_ids": f"WITH {base.MF} SELECT DISTINCT k, 1.0::DOUBLE AS unit FROM mf",
        "threshold_components": f"WITH RECURSIVE {_THRESHOLD} SELECT rg.t AS k, (rg.y * 8 + rg.x)::INT AS p, round(v, 6) AS a FROM rg JOIN best ON best.t = rg.t AND best.r = rg.r JOIN im ON im.t = rg.t AND im.y = rg.y AND im.x = rg.x WHERE v > 0",
    }

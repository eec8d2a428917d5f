"""Per-pixel statistics: template, noise from the power spectrum, peak-to-noise and correlation images."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somaflow.operators.layout import by_strips, pixels, place, sampled, with_place

#: Neighbours after a pixel in reading order; each pair of neighbours is met once.
FORWARD = ((0, 1), (1, -1), (1, 0), (1, 1))
AROUND = tuple((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)


def template(frames: DataFrame, strip: int | None = None) -> DataFrame:
    """Median of each pixel over the frames, NaN left out: (p, template); pixels without a value have no row.

    Exact for a movie of any length: strips get narrower as it gets longer, unless their width is given.
    """

    def median(movie: np.ndarray) -> np.ndarray:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # pixels that are NaN throughout
            return np.nanmedian(movie, axis=0)

    return by_strips(frames, median, "p int, template double", strip).where(~F.isnan("template"))


def finite(frames: DataFrame) -> DataFrame:
    """(t, px): NaN, null and infinite values replaced by the mean of their frame's finite ones; 0 in a frame without any."""
    good = F.filter("px", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    mean = F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(good)).otherwise(0.0)
    ok = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return frames.withColumn("m", mean).select("t", F.transform("px", lambda v: F.when(ok(v), v.cast("double")).otherwise(F.col("m"))).alias("px"))


def pixel_stats(frames: DataFrame) -> DataFrame:
    """(p, vmax, vmean, vstd): population standard deviation, as partial aggregates of the scan."""
    return pixels(frames).groupBy("p").agg(F.max("v").alias("vmax"), F.avg("v").alias("vmean"), F.stddev_pop("v").alias("vstd"))


def spectrum_noise(y: np.ndarray, method: str = "logmexp", low: float = 0.25, high: float = 0.5, exact: bool = False) -> np.ndarray:
    """Noise of series (rows) from the upper band of their spectrum.

    The power is re^2 / T + im^2, as the results to be matched have it; with
    ``exact`` (re^2 + im^2) / T.
    """
    n = y.shape[-1]
    k = np.arange(n // 2 + 1)
    band = (k / n > low) & (k / n <= high)
    f = np.fft.rfft(y, axis=-1)[..., band]
    power = (f.real**2 + f.imag**2) / n if exact else f.real**2 / n + f.imag**2
    if method == "mean":
        return np.sqrt(power.mean(axis=-1))
    if method == "median":
        return np.sqrt(np.median(power, axis=-1))
    if method == "logmexp":
        return np.sqrt(np.exp(np.log(power + 1e-10).mean(axis=-1)))
    raise ValueError(f"unknown noise method {method!r}")


def noise_image(frames: DataFrame, method: str = "logmexp", most: int | None = 3072) -> DataFrame:
    """(p, sn): noise of each pixel, from at most ``most`` frames of the start, middle and end; None: from all."""
    return by_strips(frames if most is None else sampled(frames, most), lambda movie: spectrum_noise(movie.T, method), "p int, sn double")


def pnr_image(frames: DataFrame, method: str = "logmexp", most: int | None = 3072) -> DataFrame:
    """(p, sn, pnr): peak of the mean-centred pixel over its noise.

    The noise band leaves out frequency 0, so centring changes the peak alone.
    """
    peak = pixels(frames).groupBy("p").agg((F.max("v") - F.avg("v")).alias("peak"))
    return peak.join(noise_image(frames, method, most), "p").select("p", "sn", (F.col("peak") / F.col("sn")).alias("pnr"))


def correlation_image(frames: DataFrame, h: int, w: int) -> DataFrame:
    """(p, cn): mean Pearson correlation of a pixel with its up to 8 neighbours; 0 for a constant one.

    One scan: each frame gives every pixel's value and its products with the
    neighbours that follow it, summed before the only shuffle, whose rows are
    pixels and not frames.
    """
    d = h * w

    def times_ahead(step: int):
        return F.transform("px", lambda v, i: v.cast("double") * F.get("px", i + step).cast("double"))

    later = [times_ahead(dy * w + dx) for dy, dx in FORWARD]
    zipped = frames.select(F.posexplode(F.arrays_zip(F.transform("px", lambda v: v.cast("double")).alias("v"), *(c.alias(f"n{i}") for i, c in enumerate(later)))).alias("p", "z"))
    sums = zipped.groupBy("p").agg(
        F.count("*").alias("n"), F.sum("z.v").alias("s"), F.sum(F.col("z.v") * F.col("z.v")).alias("ss"), *(F.sum(f"z.n{i}").alias(f"x{i}") for i in range(4))
    )
    y, x = (F.col("p") / w).cast("int"), F.col("p") % w
    pairs = sums.select(
        "p", F.inline(F.array(*(F.struct((F.col("p") + dy * w + dx).alias("q"), F.col(f"x{i}").alias("xy"), ((y + dy < h) & (x + dx >= 0) & (x + dx < w)).alias("inside")) for i, (dy, dx) in enumerate(FORWARD))))
    ).where(F.col("inside") & (F.col("q") < d))
    one = sums.select("p", "n", "s", "ss")
    other = sums.select(F.col("p").alias("q"), F.col("s").alias("s2"), F.col("ss").alias("ss2"))
    met = pairs.join(one, "p").join(other, "q")
    var = lambda ss, s: F.col(ss) - F.col(s) * F.col(s) / F.col("n")
    cov = F.col("xy") - F.col("s") * F.col("s2") / F.col("n")
    flat = (var("ss", "s") <= 0) | (var("ss2", "s2") <= 0)
    r = F.when(flat, 0.0).otherwise(cov / F.sqrt(var("ss", "s") * var("ss2", "s2")))
    both = met.select("p", "q", r.alias("r"))
    return both.unionByName(both.select(F.col("q").alias("p"), F.col("p").alias("q"), "r")).groupBy("p").agg(F.avg("r").alias("cn"))


def correlation_info(frames: DataFrame, h: int, w: int, method: str = "logmexp", most: int | None = 3072) -> DataFrame:
    """(y, x, cn, pnr): the two images by which seeds are chosen."""
    return with_place(correlation_image(frames, h, w).join(pnr_image(frames, method, most), "p"), w).select("y", "x", "cn", "pnr")


def seed_mask(info: DataFrame, h: int, w: int, min_corr: float, min_pnr: float, border: int) -> DataFrame:
    """(y, x, score): cn * pnr where both reach their bounds off the border, else 0."""
    y, x = F.col("y"), F.col("x")
    edge = (y < border) | (y >= h - border) | (x < border) | (x >= w - border)
    return info.select("y", "x", F.when((F.col("cn") < min_corr) | (F.col("pnr") < min_pnr) | edge, 0.0).otherwise(F.col("cn") * F.col("pnr")).alias("score"))


def neighbours(df: DataFrame, h: int, w: int, offsets=AROUND, value: str = "v") -> DataFrame:
    """Each (key..., y, x, value) sent to the places that have it as a neighbour: inside the image alone."""
    steps = F.array(*(F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx")) for dy, dx in offsets))
    out = df.withColumn("o", F.explode(steps)).withColumn("y", F.col("y") + F.col("o.dy")).withColumn("x", F.col("x") + F.col("o.dx")).drop("o")
    return out.where((F.col("y") >= 0) & (F.col("y") < h) & (F.col("x") >= 0) & (F.col("x") < w))


def local_maxima(image: DataFrame, h: int, w: int, size: int = 3) -> DataFrame:
    """(y, x, v) of the pixels that are the largest of the ``size`` rows and columns around them, from ``size // 2`` before on."""
    steps = range(-(size // 2), size - size // 2)
    window = tuple((dy, dx) for dy in steps for dx in steps)
    top = neighbours(image, h, w, window).groupBy("y", "x").agg(F.max("v").alias("m"))
    return image.join(top, ["y", "x"]).where("v = m").select("y", "x", "v")


def ranked_seeds(mask: DataFrame) -> DataFrame:
    """Pixels of a seed mask with a score, best first by ``rank``, ties in reading order.

    One task ranks them: an image has at most one row per pixel.
    """
    return mask.where("score > 0").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "y", "x")).cast("bigint"))


def thresholded(frames: DataFrame, noise: DataFrame, factor: float) -> DataFrame:
    """(t, p, v, kept): values under ``factor`` times their pixel's noise (p, sn) are zero and not kept."""
    kept = F.col("v") >= factor * F.col("sn")
    return pixels(frames).join(noise, "p").select("t", "p", F.when(kept, F.col("v")).otherwise(0.0).alias("v"), F.coalesce(kept, F.lit(False)).alias("kept"))


def seed_correlations(frames: DataFrame, seed: int, inside: float = 0.7, outside: float = 0.3) -> DataFrame:
    """(p, part, r): each pixel's correlation with pixel ``seed``, and whether it is of the neuron, the background or between.

    A constant pixel has no correlation (null), and is between.
    """
    long = frames.select(F.get("px", F.lit(seed)).cast("double").alias("s"), F.posexplode("px").alias("p", "v"))
    v = F.col("v").cast("double")
    r = long.groupBy("p").agg(F.try_divide(F.covar_pop(v, "s"), F.stddev_pop(v) * F.stddev_pop("s")).alias("r"))
    part = F.when(F.col("r") > inside, "neuron").when(F.col("r") < outside, "background").otherwise("between")
    return r.select("p", part.alias("part"), "r")


def projection_image(footprints: DataFrame) -> DataFrame:
    """(p, total): sum of the footprints (t, px), each scaled to [0, 1]; a constant one adds nothing."""
    m = footprints.select(F.transform("px", lambda v: v.cast("double")).alias("px")).select("px", F.array_min("px").alias("lo"), F.array_max("px").alias("hi"))
    scaled = F.transform("px", lambda v: F.when(F.col("hi") > F.col("lo"), (v - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0))
    return m.select(F.posexplode(scaled).alias("p", "v")).groupBy("p").agg(F.sum("v").alias("total"))


def brightest(frames: DataFrame, w: int) -> DataFrame:
    """(t, y, x, v): the largest value of each frame and its first place in reading order."""
    top = frames.select("t", "px", F.array_max("px").alias("v"))
    y, x = place((F.array_position("px", F.col("v")) - 1).cast("int"), w)
    return top.select("t", y.alias("y"), x.alias("x"), "v")


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, n) of the bins that hold values: equal parts of [low, high], else of the values' own range; the last one is closed.

    The range is a row of the same query, sent to the tasks.  Values outside of
    a given range, null and NaN are left out; where all are equal the range is
    one wide, with the value in its middle.
    """
    v = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = [F.min("v") if low is None else F.first(F.lit(float(low))), F.max("v") if high is None else F.first(F.lit(float(high)))]
    span = v.groupBy().agg(*(e.alias(c) for e, c in zip(ends, ("a", "b"))))
    flat = F.when(F.col("a") == F.col("b"), 0.5).otherwise(0.0)
    span = span.select((F.col("a") - flat).alias("lo"), (F.col("b") + flat).alias("hi"))
    held = v.join(F.broadcast(span), (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    return held.groupBy(F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))

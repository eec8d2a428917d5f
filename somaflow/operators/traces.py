"""Traces (k, t, v): baselines, autocovariance, autoregression and deconvolution.

Windows are partitioned by trace; a trace is one neuron's frames, which one
task holds anyway when it deconvolves it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somaflow.functions import oasis
from somaflow.operators.layout import series


def _by_time(*keys: str):
    return Window.partitionBy(*keys).orderBy("t")


def dff(traces: DataFrame, window: int, quantile: float = 0.2) -> DataFrame:
    """(k, t, dff): relative change over a rolling percentile.

    Frame t's baseline is the percentile of the next ``window`` frames; the last
    window + 1 frames share that of the last ``window``.  Traces that aren't
    positive throughout, or not longer than the window, are left out.
    """
    span = _by_time("k")
    whole = Window.partitionBy("k")
    t = traces.withColumn("n", F.count("*").over(whole)).withColumn("low", F.min("v").over(whole)).where((F.col("low") > 0) & (F.col("n") > window))
    rolled = F.percentile("v", F.lit(quantile)).over(span.rowsBetween(1, window))
    last = F.percentile(F.when(F.col("t") >= F.col("n") - window, F.col("v")), F.lit(quantile)).over(whole)
    base = F.when(F.col("t") <= F.col("n") - window - 2, rolled).otherwise(last)
    return t.withColumn("base", base).select("k", "t", ((F.col("v") - F.col("base")) / F.col("base")).alias("dff"))


def rolling_mean(traces: DataFrame, size: int = 10) -> DataFrame:
    """(k, t, v): centred mean of full windows of ``size`` rows, 0 elsewhere, modulo 2 pi."""
    span = _by_time("k").rowsBetween(-(size // 2), size - size // 2 - 1)
    mean = F.when(F.count("v").over(span) == size, F.avg("v").over(span)).otherwise(0.0)
    return traces.select("k", "t", F.pmod(mean, F.lit(2 * np.pi)).alias("v"))


def jumps(traces: DataFrame, times: float = 3) -> DataFrame:
    """(k, top, spread, keep): whether a trace's largest step reaches ``times`` the steps' deviation."""
    steps = traces.withColumn("d", F.col("v") - F.lag("v").over(_by_time("k"))).where("d is not null")
    out = steps.groupBy("k").agg(F.max("d").alias("top"), F.stddev_pop("d").alias("spread"))
    return out.withColumn("keep", F.col("top") >= times * F.col("spread"))


def _numbers(traces: DataFrame, kind: str, kernel) -> DataFrame:
    """(k, r): what ``kernel`` makes of each trace's array."""

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for y in parts:
            yield pd.Series([kernel(np.asarray(r, float)) for r in y])

    return series(traces, "k").select("k", run("y").alias("r"))


def autocovariance(traces: DataFrame, lags: int) -> DataFrame:
    """(k, lag, v) for lags 0 .. lags: mean removed, divided by the full length."""
    return _numbers(traces, "array<double>", lambda y: oasis.autocovariance(y, lags).tolist()).select("k", F.posexplode("r").alias("lag", "v"))


def ar1_coefficient(traces: DataFrame, lags: int = 5, fudge: float = 1.0) -> DataFrame:
    """(k, g): decay of first order from the autocovariance, as the deconvolution estimates it."""
    return _numbers(traces, "double", lambda y: float(oasis.time_constant(y, None, 1, lags, fudge)[0])).select("k", F.col("r").alias("g"))


def trace_noise(traces: DataFrame, method: str = "logmexp") -> DataFrame:
    """(k, sn) by Welch's averaged periodogram over the open band (1/4, 1/2)."""
    return _numbers(traces, "double", lambda y: oasis.welch_noise(y, method)).select("k", F.col("r").alias("sn"))


def ar1_filter(traces: DataFrame, gamma: float) -> DataFrame:
    """(k, t, c): c_t = v_t + gamma c_{t-1}, one pass over each trace; a null sample makes it and all after it null."""

    each = _numbers(traces, "array<double>", lambda y: list(itertools.accumulate(y.tolist(), lambda c, v: v + gamma * c)))
    rows = each.select("k", F.posexplode("r").alias("t", "c"))
    return rows.select("k", F.col("t").cast("bigint").alias("t"), F.nanvl("c", F.lit(None).cast("double")).alias("c"))


def _per_trace(traces: DataFrame, fields: str, solve) -> DataFrame:
    @F.pandas_udf(fields)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for y in parts:
            yield pd.DataFrame([solve(np.asarray(r, float)) for r in y])

    return series(traces, "k").select("k", run("y").alias("r")).select("k", "r.*")


def deconvolve(traces: DataFrame, g: float, lam: float = 0.0, s_min: float = 0.0) -> DataFrame:
    """(k, c, s): non-negative AR(1) deconvolution with given decay, by pooling."""
    return _per_trace(traces, "c array<double>, s array<double>", lambda y: dict(zip(("c", "s"), oasis.oasis_ar1(y, g, lam, s_min))))


def foopsi(traces: DataFrame, **options) -> DataFrame:
    """(k, c, s, bl, g, g2, sn, lam, c1, decay): noise-constrained deconvolution with all parameters estimated."""
    return _per_trace(traces, "c array<double>, s array<double>, bl double, g double, g2 double, sn double, lam double, c1 double, decay double", lambda y: oasis.constrained_foopsi(y, **options))


def interpolated(traces: DataFrame) -> DataFrame:
    """(k, t, v): NaN or null values replaced linearly in t, flat beyond the ends."""
    good = F.when(F.col("v").isNotNull() & ~F.isnan("v"), F.struct("t", "v"))
    back = F.last(good, ignorenulls=True).over(_by_time("k").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(good, ignorenulls=True).over(_by_time("k").rowsBetween(0, Window.unboundedFollowing))
    t = traces.withColumn("b", back).withColumn("f", ahead)
    part = (F.col("t") - F.col("b.t")) / (F.col("f.t") - F.col("b.t"))
    v = F.when(F.col("b").isNull(), F.col("f.v")).when(F.col("f").isNull() | (F.col("f.t") == F.col("b.t")), F.col("b.v")).otherwise(F.col("b.v") + part * (F.col("f.v") - F.col("b.v")))
    return t.select("k", "t", v.alias("v"))


def as_of(points: DataFrame, steps: DataFrame) -> DataFrame:
    """``points`` (k, at, ...) with ``row`` of the last of the ``steps`` (k, at, row) at or before them; null where there is none.

    Bins of any widths are steps that begin at their edges.  Both sides are
    sorted once by key and place; of steps at one place the largest row counts.
    """
    names = [c for c in points.columns if c not in ("k", "at")]
    left = points.select("k", "at", F.lit(1).alias("_side"), F.struct(*names).alias("_point") if names else F.struct(F.lit(0)).alias("_point"), F.lit(None).cast(steps.schema["row"].dataType).alias("row"))
    right = steps.groupBy("k", "at").agg(F.max("row").alias("row")).select("k", "at", F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_point"].dataType).alias("_point"), "row")
    order = Window.partitionBy("k").orderBy("at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("row", F.last("row", ignorenulls=True).over(order)).where("_side = 1")
    return both.select("k", "at", *(F.col(f"_point.`{c}`") for c in names), "row")


def correlations(traces: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, r): Pearson correlation of the traces of each pair."""
    a = traces.select(F.col("k").alias("i"), "t", F.col("v").alias("vi"))
    b = traces.select(F.col("k").alias("j"), "t", F.col("v").alias("vj"))
    return pairs.join(a, "i").join(b, ["j", "t"]).groupBy("i", "j").agg(F.corr("vi", "vj").alias("r"))


def norm(value: str = "v"):
    """Aggregate: root of the sum of squares, by which sweeps are said to have converged."""
    return F.sqrt(F.sum(F.col(value) * F.col(value)))


def clipped(traces: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """``traces`` with values held within [low, high]; null stays null."""
    v = F.col("v")
    if low is not None:
        v = F.when(v < low, F.lit(float(low))).otherwise(v)
    if high is not None:
        v = F.when(v > high, F.lit(float(high))).otherwise(v)
    return traces.withColumn("v", v)

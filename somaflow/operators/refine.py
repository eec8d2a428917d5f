"""The final update of all components at once: block coordinate descent over the whole image.

The movie is cut into square cells, each pixel in one; a footprint becomes a
piece for each cell that it reaches into.  Cells project their part of the movie
on their pieces, and parts add up; overlaps add up the same way.  Traces are then
updated colour by colour, since components of one colour share no pixel, and
what a trace moves by is taken out of its neighbours' residuals along the edges.
Footprints are updated cell by cell and put together.  A component is updated
once wherever it lies, and keeps its id all the way; only one that an update
empties goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somaflow.functions import extraction as fx
from somaflow.functions import images, oasis
from somaflow.operators import geometry, graph
from somaflow.params import ExtractionParams

#: Rows and columns of a cell.  A task holds a cell's frames: so many pixels' squares, 8 bytes each.
CELL = 32


def cell_of(px, w: int):
    """Column: the cell of a pixel's number."""
    across = -(-w // CELL)
    return (F.floor(F.floor(px / w) / CELL) * across + F.floor(px % w / CELL)).cast("int")


def _places(cell: int, h: int, w: int) -> np.ndarray:
    y, x = (v * CELL for v in divmod(cell, -(-w // CELL)))
    return (np.arange(y, min(y + CELL, h))[:, None] * w + np.arange(x, min(x + CELL, w))).ravel()


def cell_movies(frames: DataFrame, h: int, w: int) -> DataFrame:
    """(cell, t, px): each frame cut into cells where it lies; one shuffle by cell follows."""
    down, across = -(-h // CELL), -(-w // CELL)
    inside = [_places(n, h, w) for n in range(down * across)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.asarray(batch.column(1).flatten()).reshape(len(batch), h * w).astype("<f4")
            for n, px in enumerate(inside):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), n, np.int32)), batch.column(0), pa.array([r.tobytes() for r in block[:, px]], pa.binary())], ["cell", "t", "px"])

    return frames.select("t", "px").mapInArrow(cut, "cell int, t long, px binary")


def pieces(components: DataFrame, w: int) -> DataFrame:
    """(cell, k, px, a): the footprints' parts in each cell."""
    one = components.select("k", F.explode(F.arrays_zip("px", "a")).alias("z")).select("k", F.col("z.px").alias("px"), F.col("z.a").alias("a"))
    return one.groupBy(cell_of(F.col("px"), w).alias("cell"), "k").agg(F.collect_list("px").alias("px"), F.collect_list("a").alias("a"))


def _movie(rows: pd.DataFrame, background: tuple[np.ndarray, np.ndarray], where: np.ndarray) -> np.ndarray:
    y = np.stack([np.frombuffer(r, "<f4") for r in rows.sort_values("t")["px"]]).astype(float)
    b, f = background
    return y - f.T @ b[:, where] if len(b) else y


def _dense(parts: pd.DataFrame, where: np.ndarray, column: str = "a") -> np.ndarray:
    out = np.zeros((len(parts), len(where)))
    for row, px, v in zip(out, parts["px"], parts[column]):
        row[np.searchsorted(where, px)] = v
    return out


def added(rows: DataFrame, key: str, value: str, *only: str) -> DataFrame:
    """(key, value, only): the sum of the arrays of each key, place by place; a key has few.  ``only`` are columns of which a key has one value at most."""
    every = F.collect_list(value)
    total = F.aggregate(F.slice(every, 2, F.greatest(F.size(every) - 1, F.lit(0))), F.element_at(every, 1), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return rows.groupBy(key).agg(total.alias(value), *(F.first(c, ignorenulls=True).alias(c) for c in only))


def bound_once(value, use):
    """Column ``use(v)`` of a ``value`` that is computed once for a row; as a column of its own it would move into the lambdas, to be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _norm(column: str):
    return F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x * x))


def projections(movies: DataFrame, parts: DataFrame, background, h: int, w: int) -> DataFrame:
    """(i, j, v, y): rows with j null are component i's share of the movie's product with it; others a share v of the footprints' product of i and j."""

    def run(key: tuple, movie: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(movie) or not len(own):
            return pd.DataFrame([], columns=["i", "j", "v", "y"])
        where = _places(int(key[0]), h, w)
        a, ids = _dense(own, where), own["k"].tolist()
        made, overlap = _movie(movie, background, where) @ a.T, a @ a.T
        n, m = np.nonzero(overlap)
        names = np.array(ids)
        # ids go as whole numbers: among nulls pandas would make doubles of them
        j = pd.array([None] * len(ids) + names[m].tolist(), dtype="Int64")
        y = [*made.T, *[None] * len(n)]
        return pd.DataFrame({"i": np.concatenate((names, names[n])), "j": j, "v": np.concatenate((np.full(len(ids), np.nan), overlap[n, m])), "y": y})

    return movies.groupBy("cell").cogroup(parts.groupBy("cell")).applyInPandas(run, "i long, j long, v double, y array<double>")


def update_traces(movies: DataFrame, components: DataFrame, background, h: int, w: int, params: ExtractionParams, save: graph.Save, name: str) -> DataFrame:
    """``components`` with their traces c and activity s updated, and the residual yra; those whose footprint or trace is nought go."""
    p = params.temporal_params
    shares = save(projections(movies, pieces(components, w), background, h, w), f"{name}-shares")
    edges = save(shares.where("j is not null").groupBy("i", "j").agg(F.sum("v").alias("v")), f"{name}-edges")
    size = edges.where("i = j and v > 0").select(F.col("i").alias("k"), F.col("v").alias("size"))
    nodes = components.join(size, "k")
    # weight of i's trace in j's residual
    weight = edges.join(size.select(F.col("k").alias("j"), "size"), "j").select("i", "j", (F.col("v") / F.col("size")).alias("weight"))
    weight = save(weight.where("weight > 0"), f"{name}-weights")
    colours = save(graph.coloured(nodes, weight.select("i", "j"), save, f"{name}-colours"), f"{name}-coloured")
    number = [r["colour"] for r in colours.select("colour").distinct().orderBy("colour").collect()]  # as many as overlap in one place

    def moved(by: DataFrame, column: str) -> DataFrame:
        """(k, d): the sum of the neighbours' arrays, each times its weight."""
        along = weight.join(by.select(F.col("k").alias("i"), F.col(column).alias("d")), "i").select(F.col("j").alias("k"), F.transform("d", lambda x: x * F.col("weight")).alias("d"))
        return added(along, "k", "d")

    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    data = added(shares.where("j is null").select(F.col("i").alias("k"), "y"), "k", "y")
    state = nodes.join(data, "k").join(moved(nodes, "c"), "k").join(colours, "k")
    state = state.select("k", "colour", "c", F.transform("c", lambda x: F.lit(0.0)).alias("s"), minus(F.transform("y", lambda x: x / F.col("size")), F.col("d")).alias("rest"))
    state = save(state, f"{name}-state")

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, c, rest in zip(frame["k"], frame["c"], frame["rest"]):
                r = oasis.constrained_foopsi(rest + c, p=p.p, bas_nonneg=p.bas_nonneg, noise_method=p.noise_method, lags=p.lags, fudge=p.fudge_factor)
                new = r["c"] + r["bl"]
                rows.append((k, new, r["s"], new - c))
            yield pd.DataFrame(rows, columns=["k", "new", "act", "step"])

    for turn in range(p.ITER):
        start = state.select("k", F.col("c").alias("old"))
        for colour in number:
            step = state.where(F.col("colour") == colour).select("k", "c", "rest").mapInPandas(fit, "k long, new array<double>, act array<double>, step array<double>")
            # a step goes along all edges of its component, its own loop among them, which also brings the new trace
            along = weight.join(step.withColumnRenamed("k", "i"), "i").withColumn("own", F.col("i") == F.col("j"))
            along = along.select(F.col("j").alias("k"), F.transform("step", lambda x: x * F.col("weight")).alias("d"), *(F.when(F.col("own"), F.col(c)).alias(c) for c in ("new", "act")))
            met = state.join(added(along, "k", "d", "new", "act"), "k", "left")
            rest = F.coalesce(minus(F.col("rest"), F.col("d")), F.col("rest"))
            state = save(met.select("k", "colour", F.coalesce("new", "c").alias("c"), F.coalesce("act", "s").alias("s"), rest.alias("rest")), f"{name}-state-{turn}-{colour}")
        square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
        change, whole = state.join(start, "k").agg(F.sum(square(minus(F.col("c"), F.col("old")))), F.sum(square("c"))).first()
        if (change or 0.0) <= 1e-6 * (whole or 0.0):  # a thousandth of the norm
            break
    alive = state.where(F.exists("c", lambda x: x != 0)).select("k", "c", "s", F.col("rest").alias("yra"))
    return save(components.drop("c", "s", "yra").join(alive, "k"), f"{name}-traces")


def _box(px: np.ndarray, h: int, w: int, by: int) -> tuple[int, int, int, int]:
    y, x = np.divmod(px, w)
    return max(0, y.min() - by), min(h, y.max() + by + 1), max(0, x.min() - by), min(w, x.max() + by + 1)


def update_footprints(movies: DataFrame, components: DataFrame, background, h: int, w: int, params: ExtractionParams, save: graph.Save, name: str) -> DataFrame:
    """``components`` with their footprints regressed on their traces, pixel by pixel, and freed of stray pixels; those left empty go."""
    p = params.spatial_params
    if p.method_least_square != "lasso_lars":
        raise NotImplementedError(p.method_least_square)

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The pixels that a footprint may have."""
        for frame in frames:
            rows = []
            for k, px, a in zip(frame["k"], frame["px"], frame["a"]):
                px = np.asarray(px)[np.asarray(a) > 0]
                if p.method != "dilate":
                    rows.append((k, np.arange(h * w), np.ones(h * w)))
                elif len(px):
                    y0, y1, x0, x1 = _box(px, h, w, 2)
                    mask = np.zeros((y1 - y0, x1 - x0), bool)
                    mask[px // w - y0, px % w - x0] = True
                    y, x = np.nonzero(images.dilate(mask))
                    rows.append((k, (y + y0) * w + x + x0, np.ones(len(y))))
            yield pd.DataFrame(rows, columns=["k", "px", "a"])

    scaled = components.where(_norm("c") > 0)
    scale = _norm("c") if p.normalize else F.lit(1.0)
    traces = scaled.select("k", bound_once(scale, lambda n: F.transform("c", lambda x: x / n)).alias("c"))
    parts = pieces(scaled.select("k", "px", "a").mapInPandas(reach, "k long, px array<int>, a array<double>"), w).join(traces, "k")

    def run(key: tuple, movie: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(movie) or not len(own):
            return pd.DataFrame([], columns=["k", "px", "a"])
        where, own = _places(int(key[0]), h, w), own.sort_values("k")
        y = _movie(movie, background, where)
        sn = fx.spectrum_noise(y.T, params.preprocess_params.noise_method)
        a = fx.regress_pixels(y, np.stack(list(own["c"]), axis=1), _dense(own, where) > 0, sn)
        return pd.DataFrame([(k, where[row > 0].astype(np.int32), row[row > 0]) for k, row in zip(own["k"], a)], columns=["k", "px", "a"])

    cells = save(movies.groupBy("cell").cogroup(parts.groupBy("cell")).applyInPandas(run, "k long, px array<int>, a array<double>"), f"{name}-cells")
    whole = cells.groupBy("k").agg(F.flatten(F.collect_list("px")).alias("px"), F.flatten(F.collect_list("a")).alias("a")).where(F.size("px") > 0)

    def clean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, px, a in zip(frame["k"], frame["px"], frame["a"]):
                y0, y1, x0, x1 = _box(px, h, w, 2)
                image = np.zeros((y1 - y0, x1 - x0))
                image[px // w - y0, px % w - x0] = a
                image = fx.threshold_component(image.ravel(), image.shape, p.thr_method, p.maxthr, p.nrgthr, p.extract_cc).reshape(image.shape)
                y, x = np.nonzero(image > 0)
                if image.sum() > 0:
                    rows.append((k, ((y + y0) * w + x + x0).astype(np.int32), image[y, x]))
            yield pd.DataFrame(rows, columns=["k", "px", "a"])

    shapes = whole.mapInPandas(clean, "k long, px array<int>, a array<double>")
    return save(components.drop("px", "a").join(shapes, "k"), f"{name}-footprints")


def evaluate(frames: DataFrame, components: DataFrame, background: DataFrame, h: int, w: int, params: ExtractionParams, save: graph.Save) -> DataFrame:
    """Components (k, patch, px, a, c, s, yra) updated once more: traces, footprints, traces, unit length.

    The background is nb rows of image and trace, which go to every cell's task.
    """
    rows = geometry.checked(background.select("b", "f"), "background components", 1000)
    back = tuple(np.array([r[c] for r in rows]) for c in ("b", "f"))
    movies = save(cell_movies(frames, h, w), "cells")
    found = update_traces(movies, components, back, h, w, params, save, "update-1")
    found = update_footprints(movies, found, back, h, w, params, save, "update-2")
    found = update_traces(movies, found, back, h, w, params, save, "update-3")
    norm = _norm("a")
    by = lambda c: bound_once(norm, lambda n: F.transform(c, lambda x: x * n)).alias(c)
    return found.where(norm > 0).select("k", "patch", "px", bound_once(norm, lambda n: F.transform("a", lambda x: x / n)).alias("a"), by("c"), by("s"), by("yra"))

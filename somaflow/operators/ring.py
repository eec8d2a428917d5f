"""The ring background of a whole image: every pixel explained by the pixels on a ring around it.

The movie is cut into cells with a halo as wide as the ring, so that no pixel
lacks neighbours but at the image's own border.  In a cell the normal equations
of many pixels are made by one batched product and solved together; a neighbour
outside the image is a row of the identity, so that all systems have one size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somaflow.operators.geometry import ring_offsets

#: Rows and columns of a cell, and values that are held at once beside the cell's movie.
CELL = 32
VALUES = 1 << 23


@dataclass(frozen=True)
class Grid:
    """An image of h rows and w columns in square cells, numbered by rows."""

    h: int
    w: int
    size: int

    @property
    def across(self) -> int:
        return -(-self.w // self.size)

    @property
    def down(self) -> int:
        return -(-self.h // self.size)

    def extent(self, cell: int, halo: int = 0) -> tuple[int, int, int, int]:
        """(first row, end, first column, end) of a cell and what lies up to ``halo`` pixels around it."""
        y, x = (v * self.size for v in divmod(cell, self.across))
        return max(0, y - halo), min(self.h, y + self.size + halo), max(0, x - halo), min(self.w, x + self.size + halo)


def halo_movies(frames: DataFrame, grid: Grid, halo: int) -> DataFrame:
    """(cell, t, px): each frame cut into cells and what lies up to ``halo`` pixels around them."""
    extents = [grid.extent(n, halo) for n in range(grid.down * grid.across)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.asarray(batch.column(1).flatten()).reshape(len(batch), grid.h, grid.w).astype("<f8")
            for n, (y0, y1, x0, x1) in enumerate(extents):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), n, np.int32)), batch.column(0), pa.array([np.ascontiguousarray(f).tobytes() for f in block[:, y0:y1, x0:x1]], pa.binary())], ["cell", "t", "px"])

    return frames.select("t", "px").mapInArrow(cut, "cell int, t long, px binary")


def halo_pieces(components: DataFrame, grid: Grid, halo: int) -> DataFrame:
    """(at, k, px, a, c): the parts of the footprints (k, px, a) in each cell with its halo, with their traces c."""
    one = components.select("k", "c", F.explode(F.arrays_zip("px", "a")).alias("z")).select("k", "c", F.col("z.px").alias("px"), F.col("z.a").alias("a"))
    reach = lambda v, n: F.sequence(F.greatest(F.floor((v - halo) / grid.size), F.lit(0)), F.least(F.floor((v + halo) / grid.size), F.lit(n - 1)))
    ys, xs = reach(F.floor(F.col("px") / grid.w), grid.down), reach(F.col("px") % grid.w, grid.across)
    cells = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: (y * grid.across + x).cast("int"))))
    near = one.withColumn("at", F.explode(cells))
    return near.groupBy("at", "k").agg(F.collect_list("px").alias("px"), F.collect_list("a").alias("a"), F.first("c").alias("c"))


def solved(x: np.ndarray, cell: int, grid: Grid, radius: int, most: int, ridge: float = 1e-9) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(pixels, neighbours, weights, what the ring tells) of a cell's pixels, some at a time; x is (frames, rows, columns) of the cell with its halo."""
    offsets, h, w = np.array(ring_offsets(radius)), grid.h, grid.w
    top, _, left, right = grid.extent(cell, int(np.abs(offsets).max()))
    y0, y1, x0, x1 = grid.extent(cell)
    flat, k = x.reshape(len(x), -1), len(offsets)
    at = np.array([(y, c) for y in range(y0, y1) for c in range(x0, x1)])
    some = max(1, most // (k * max(1, len(x))))
    for a in range(0, len(at), some):
        own = at[a : a + some]
        ny, nx = own[:, :1] + offsets[:, 0], own[:, 1:] + offsets[:, 1]
        inside = (ny >= 0) & (ny < h) & (nx >= 0) & (nx < w)
        place = np.where(inside, (ny - top) * (right - left) + nx - left, 0)
        ring = np.where(inside[:, :, None], flat[:, place].transpose(1, 2, 0), 0)  # (pixels, neighbours, frames)
        mine = flat[:, (own[:, 0] - top) * (right - left) + own[:, 1] - left].T
        gram = ring @ ring.transpose(0, 2, 1)
        count = np.maximum(inside.sum(axis=1), 1)
        diagonal = ridge * np.maximum(1.0, np.trace(gram, axis1=1, axis2=2) / count)
        gram += np.where(inside, diagonal[:, None], 1.0)[:, :, None] * np.eye(k)
        weights = np.linalg.solve(gram, ring @ mine[:, :, None])[:, :, 0]
        yield own[:, 0] * w + own[:, 1], np.where(inside, ny * w + nx, -1), np.where(inside, weights, 0), np.einsum("pk,pkt->tp", weights, ring)


def _cells(frames: DataFrame, grid: Grid, radius: int, components: DataFrame | None, schema: str, make) -> DataFrame:
    """``make(cell, t, mean of what isn't neurons, movie without it and neurons)`` for each cell."""
    halo = max(abs(v) for o in ring_offsets(radius) for v in o)
    movies = halo_movies(frames, grid, halo)
    if components is None:
        components = frames.sparkSession.createDataFrame([], "k long, px array<int>, a array<double>, c array<double>")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, movie: pd.DataFrame, neurons: pd.DataFrame) -> pd.DataFrame:
        if not len(movie):
            return pd.DataFrame([], columns=names)
        cell, movie = int(key[0]), movie.sort_values("t")
        y0, y1, x0, x1 = grid.extent(cell, halo)
        y = np.stack([np.frombuffer(r) for r in movie["px"]])
        for px, a, c in zip(neurons["px"], neurons["a"], neurons["c"]):
            px = np.asarray(px)
            y[:, (px // grid.w - y0) * (x1 - x0) + px % grid.w - x0] -= np.outer(c, a)
        mean = y.mean(axis=0)
        return pd.DataFrame(make(cell, movie["t"].to_numpy(), mean.reshape(y1 - y0, x1 - x0), (y - mean).reshape(len(y), y1 - y0, x1 - x0)), columns=names)

    return movies.groupBy("cell").cogroup(halo_pieces(components, grid, halo).groupBy("at")).applyInPandas(run, schema)


def ring_weights(frames: DataFrame, h: int, w: int, radius: int, components: DataFrame | None = None) -> DataFrame:
    """(p, near, weights): the pixels on each pixel's ring and their weights; what isn't in the image is left out.

    ``components`` (k, px, a, c), if given, are taken out of the movie (t, px) first.
    """
    grid, most = Grid(h, w, CELL), VALUES

    def make(cell, _, mean, x):
        return [(int(p), near[near >= 0], weight[near >= 0]) for pixels, n, v, _ in solved(x, cell, grid, radius, most) for p, near, weight in zip(pixels.tolist(), n, v)]

    return _cells(frames, grid, radius, components, "p int, near array<int>, weights array<double>", make)


def ring_background(frames: DataFrame, h: int, w: int, radius: int, components: DataFrame | None = None) -> DataFrame:
    """(t, px): the constant part of every pixel, and what the ring around it tells of the rest."""
    halo = max(abs(v) for o in ring_offsets(radius) for v in o)
    grid, most = Grid(h, w, CELL), VALUES

    def make(cell, t, mean, x):
        top, _, left, _ = grid.extent(cell, halo)
        y0, y1, x0, x1 = grid.extent(cell)
        told = np.concatenate([v for *_, v in solved(x, cell, grid, radius, most)], axis=1) + mean[y0 - top : y1 - top, x0 - left : x1 - left].ravel()
        return [(int(i), cell, row.tobytes()) for i, row in zip(t, told)]

    extents = [grid.extent(n) for n in range(grid.down * grid.across)]

    def join(table: pa.Table) -> pa.Table:
        image = np.zeros((h, w))
        for cell, part in zip(table.column("cell").to_pylist(), table.column("part").to_pylist()):
            y0, y1, x0, x1 = extents[cell]
            image[y0:y1, x0:x1] = np.frombuffer(part).reshape(y1 - y0, x1 - x0)
        return pa.Table.from_arrays([table.column("t").slice(0, 1), pa.array([image.ravel()], pa.list_(pa.float64()))], ["t", "px"])

    return _cells(frames, grid, radius, components, "t long, cell int, part binary", make).groupBy("t").applyInArrow(join, "t long, px array<double>")

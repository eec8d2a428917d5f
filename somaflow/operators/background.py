"""Backgrounds of many patches as few parts, by alternating least squares over strips of pixels and chunks of frames.

The patches' backgrounds are a product F B of traces and images, one column and
row for each part of each patch; wanted are ``rank`` traces g and images s, none
of the images negative, with g s near F B.  B is cut into strips of pixels and F
into chunks of frames, once.  In a round the strips get g'F and g'g, solve their
own part of s, and give their share of B s' and s s'; the chunks get those, solve
their own frames of g, and give their share of g'F and g'g.  So no task holds all
patches or the image, and what a round sends has rank columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somaflow.folders import new_folder
from somaflow.operators import geometry

#: Pixels of a strip, and values of a chunk of frames.
STRIP = 8192
CHUNK_VALUES = 1 << 20
RIDGE = 1e-9


def _saved(spark) -> Callable[[DataFrame, str], DataFrame]:
    def save(df: DataFrame, name: str) -> DataFrame:
        path = new_folder(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


def _strips(parts: DataFrame, n_pixels: int, place: dict[int, int]) -> DataFrame:
    """(strip, rows, ends, px, b): a strip's pieces one after the other, each the pixels of one row; shared pixels count by their share."""
    pieces = "strip int, row int, patch long, px binary, b binary"

    def cut(batches):
        for batch in batches:
            out = []
            for row, patch, px, b in zip(*(batch.column(c).to_pylist() for c in range(4))):
                px, b = np.array(px, np.int64), np.array(b, float)
                order = np.argsort(px, kind="stable")
                px, b = px[order], b[order]
                edges = np.searchsorted(px, np.arange(0, n_pixels + STRIP, STRIP))
                out += [(s, place[row], patch, px[lo:hi].astype("<i4").tobytes(), b[lo:hi].tobytes()) for s, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))] if out else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())], ["strip", "row", "patch", "px", "b"])

    def assemble(table: pa.Table) -> pa.Table:
        held = sorted(table.to_pylist(), key=lambda r: r["row"])
        px = [np.frombuffer(r["px"], "<i4") for r in held]
        cover, seen = np.zeros(STRIP), set()
        for r, at in zip(held, px):
            if r["patch"] not in seen:
                seen.add(r["patch"])
                cover[at % STRIP] += 1
        b = [np.frombuffer(r["b"]) / cover[at % STRIP] for r, at in zip(held, px)]
        return pa.Table.from_pylist([{"strip": held[0]["strip"], "rows": [r["row"] for r in held], "ends": np.cumsum([len(x) for x in px]).tolist(), "px": np.concatenate(px).tobytes(), "b": np.concatenate(b).tobytes()}], pa.schema([("strip", pa.int32()), ("rows", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64())), ("px", pa.binary()), ("b", pa.binary())]))

    made = parts.select("row", F.col("patch").cast("long"), "px", "b").mapInArrow(cut, pieces)
    return made.groupBy("strip").applyInArrow(assemble, "strip int, rows array<int>, ends array<long>, px binary, b binary")


def _chunks(parts: DataFrame, frames: int, place: dict[int, int]) -> DataFrame:
    """(chunk, f): all rows' frames of a chunk, (rows, frames) in the order of ``place``."""
    size = max(1, CHUNK_VALUES // len(place))

    def cut(batches):
        for batch in batches:
            for row, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f, starts = np.array(f, float), range(0, frames, size)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(starts)), pa.int32()), pa.array([place[row]] * len(starts), pa.int32()), pa.array([f[s : s + size].tobytes() for s in starts], pa.binary())], ["chunk", "row", "f"])

    def assemble(table: pa.Table) -> pa.Table:
        held = sorted(table.to_pylist(), key=lambda r: r["row"])
        return pa.Table.from_pylist([{"chunk": held[0]["chunk"], "f": b"".join(r["f"] for r in held)}], pa.schema([("chunk", pa.int32()), ("f", pa.binary())]))

    return parts.select("row", "f").mapInArrow(cut, "chunk int, row int, f binary").groupBy("chunk").applyInArrow(assemble, "chunk int, f binary")


def _strip_images(g_f: np.ndarray, g_g: np.ndarray, rows: list[int], ends: list[int], px: bytes, b: bytes):
    """(pixels of the strip, s there, [(row, places, weights)])."""
    at, weights = np.frombuffer(px, "<i4"), np.frombuffer(b)
    pixels, place = np.unique(at, return_inverse=True)
    pieces = [(r, place[lo:hi], weights[lo:hi]) for r, lo, hi in zip(rows, [0, *ends], ends)]
    target = np.zeros((len(g_g), len(pixels)))
    for r, where, w in pieces:
        target[:, where] += g_f[:, r, None] * w
    return pixels, np.maximum(np.linalg.solve(g_g + RIDGE * np.eye(len(g_g)), target), 0), pieces


def _shares(made: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([v.tolist() for v in made.values()], pa.list_(pa.float64()))], ["at", "v"])


def _summed(shares: DataFrame, n: int, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """((n, rank), (rank, rank)) from the shares (at, v): rows of the first from 0 on, those of the second from -1 down."""
    total = shares.groupBy("at").agg(F.array(*(F.sum(F.col("v")[k]) for k in range(rank))).alias("v")).collect()  # n + rank rows
    products, square = np.zeros((n, rank)), np.zeros((rank, rank))
    for r in total:
        (products if r["at"] >= 0 else square)[r["at"] if r["at"] >= 0 else -1 - r["at"]] = r["v"]
    return products, square


def compressed(background: DataFrame, n_pixels: int, rank: int, seed: int = 0, rounds: int = 10, save: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, list[float]]:
    """((component, b, f), losses): ``rank`` images of unit length and their traces, and the squared residual after each round, less a constant.

    ``background`` (patch, px, b, f) has a row for each part of each patch:
    pixels, their weights, and a trace.  Where patches overlap, each says its
    share.  Its rows are nb for each patch of the grid, at most SMALL_SIDE; rows
    with no trace or pixels are an error of the caller; no rows give no parts.
    """
    spark = background.sparkSession
    save = save or _saved(spark)
    parts = save(background.select(F.monotonically_increasing_id().alias("row"), "patch", "px", "b", "f"), "background-parts")
    rows = geometry.checked(parts.select("row", F.size("f").alias("n")), "background parts")
    if not rows:
        return spark.createDataFrame([], "component int, b array<double>, f array<double>"), []
    place = {row: i for i, row in enumerate(sorted(r["row"] for r in rows))}
    n, frames = len(place), rows[0]["n"]
    if any(r["n"] != frames for r in rows):
        raise ValueError("traces of different lengths")
    rank = max(1, min(rank, n))
    strips = save(_strips(parts, n_pixels, place), "background-strips")
    chunks = save(_chunks(parts, frames, place), "background-chunks")
    size = max(1, CHUNK_VALUES // n)

    def started(lo: int, hi: int, f: np.ndarray) -> np.ndarray:
        """Frames ``lo`` to ``hi`` of the first traces: the mean of all, and columns of a seeded generator."""
        out = [f.mean(axis=0)]
        for k in range(rank - 1):
            rng = np.random.PCG64(seed)
            out.append(np.random.Generator(rng.advance(k * frames + lo)).random(hi - lo))
        return np.column_stack(out)

    def traces(mix: np.ndarray | None, finish: Callable):
        """Maps chunks: ``finish(chunk, f, g)`` gets the traces (frames, rank) of the chunk."""

        def task(batches):
            for batch in batches:
                for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    f = np.frombuffer(raw).reshape(n, -1)
                    yield finish(chunk, f, started(chunk * size, chunk * size + f.shape[1], f) if mix is None else f.T @ mix)

        return task

    def chunk_shares(_, f, g):
        products, square = f @ g, g.T @ g
        return _shares(dict(enumerate(products)) | {-1 - k: square[k] for k in range(rank)})

    def strip_task(g_f, g_g, finish):
        def task(batches):
            for batch in batches:
                for strip, *cells in zip(*(batch.column(c).to_pylist() for c in range(5))):
                    yield finish(strip, *_strip_images(g_f, g_g, *cells))

        return task

    def strip_shares(_, pixels, s, pieces):
        made: dict[int, np.ndarray] = {}
        for r, where, w in pieces:
            made[r] = made.get(r, 0) + s[:, where] @ w
        square = s @ s.T
        return _shares(made | {-1 - k: square[k] for k in range(rank)})

    shape, losses, mix = "at int, v array<double>", [], None
    for _ in range(rounds):
        f_g, g_g = _summed(chunks.mapInArrow(traces(mix, chunk_shares), shape), n, rank)
        norm = np.maximum(np.sqrt(np.diag(g_g)), 1e-12)
        g_f, g_g = (f_g / norm).T, g_g / np.outer(norm, norm)
        b_s, s_s = _summed(strips.mapInArrow(strip_task(g_f, g_g, strip_shares), shape), n, rank)
        mix = b_s @ np.linalg.inv(s_s + RIDGE * np.eye(rank))
        f_g, now = _summed(chunks.mapInArrow(traces(mix, chunk_shares), shape), n, rank)
        losses.append(float((now * s_s).sum() - 2 * (f_g * b_s).sum()))
    length = np.maximum(np.sqrt(np.diag(s_s)), 1e-12)

    def images(strip, pixels, s, _):
        out = np.zeros((rank, min(STRIP, n_pixels - strip * STRIP)))
        out[:, pixels - strip * STRIP] = s / length[:, None]
        return _pieces(strip, out)

    def _pieces(number, values):
        return pa.RecordBatch.from_arrays([pa.array(range(rank), pa.int32()), pa.array([number] * rank, pa.int32()), pa.array([v.tolist() for v in values], pa.list_(pa.float64()))], ["component", "piece", "v"])

    def joined(pieces: DataFrame, name: str) -> DataFrame:
        in_order = F.array_sort(F.collect_list(F.struct("piece", "v")))
        return pieces.groupBy("component").agg(F.flatten(F.transform(in_order, lambda x: x["v"])).alias(name))

    schema = "component int, piece int, v array<double>"
    zeros = F.array_repeat(F.lit(0.0), F.least(F.lit(STRIP), F.lit(n_pixels) - F.col("piece") * STRIP).cast("int"))
    every = spark.range(-(-n_pixels // STRIP)).select(F.explode(F.sequence(F.lit(0), F.lit(rank - 1))).alias("component"), F.col("id").cast("int").alias("piece"))
    b = every.join(strips.mapInArrow(strip_task(g_f, g_g, images), schema), ["component", "piece"], "left").withColumn("v", F.coalesce("v", zeros))
    f = chunks.mapInArrow(traces(mix, lambda chunk, _, g: _pieces(chunk, (g * length).T)), schema)
    return joined(b, "b").join(joined(f, "f"), "component"), losses

"""Motion correction: registration of frames to a template that follows the movie.

A frame's correction depends on the frame and the template alone, so a block of
frames is one map without a shuffle.  Blocks depend on each other through the
template, one after the other.  The movie is laid out by runs of blocks first,
so that each is read by itself.  Runs are a loop on the driver; every run is
written as a new version of the movie before the next one reads its template.
Blocks so small that a round of jobs takes longer than their correction share a
run, which one task corrects block by block; a larger one is a run of its own,
whose frames are spread over tasks.
"""

from __future__ import annotations

import functools
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaflow.folders import new_folder
from somaflow.functions import images, registration
from somaflow.operators import geometry, stats
from somaflow.operators.frames import BLOCK, block_of
from somaflow.operators.layout import in_range, strip_width

#: Values of the blocks that share a run at most, where runs may have more than one block.
RUN_VALUES = 1 << 22
#: Values of a block that its own run gives to a task.
TASK_VALUES = 1 << 16


@dataclass(frozen=True)
class MotionParams:
    """Parameters of motion correction; strides, overlaps and shifts are (rows, columns)."""

    strides: tuple[int, int] = (96, 94)
    overlaps: tuple[int, int] = (6, 6)
    upsample_factor_grid: int = 1
    max_deviation_rigid: int = 10
    max_shifts: tuple[int, int] = (3, 3)
    nb_round: int = 5
    upsample_factor: int = 2
    filter_size: int = 10
    filter_size_patch: int = 5
    block_size: int = 200
    template_frames: int = 500


def _mapped(frames: DataFrame, h: int, w: int, schema: str, kernel) -> DataFrame:
    """``kernel(block)`` gives the columns after t for a block of frames."""
    names = [c.split()[0] for c in schema.split(", ")]

    def task(batches):
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                part = batch.slice(a, BLOCK)
                yield pa.RecordBatch.from_arrays([part.column(0), *kernel(block_of(part.column(1), h, w))], names)

    return frames.select("t", "px").mapInArrow(task, schema)


def rigid_shifts(frames: DataFrame, template: np.ndarray, most: int) -> DataFrame:
    """(t, shift_y, shift_x, r): integer shift of largest normalised correlation; ties to the smallest offsets."""
    h, w = template.shape

    def kernel(block):
        maps = np.round(registration.ncc_maps(block, template, most), 6)
        best = maps.reshape(len(block), -1).argmax(axis=1)
        y, x = np.divmod(best, 2 * most + 1)
        return [pa.array((most - y).astype(np.int32)), pa.array((most - x).astype(np.int32)), pa.array(maps.reshape(len(block), -1).max(axis=1))]

    return _mapped(frames, h, w, "t long, shift_y int, shift_x int, r double", kernel)


def circular_shifts(frames: DataFrame, template: np.ndarray, most: tuple[int, int]) -> DataFrame:
    """(t, shift_y, shift_x, r): offset in [-m, m) of the largest circular cross-correlation."""
    h, w = template.shape

    def kernel(block):
        r = np.round(registration.cross_correlation(block, template, most), 6)
        best = r.reshape(len(block), -1).argmax(axis=1)
        y, x = np.divmod(best, w)
        y, x = np.where(y > h // 2, y - h, y), np.where(x > w // 2, x - w, x)
        return [pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(r.reshape(len(block), -1).max(axis=1))]

    return _mapped(frames, h, w, "t long, shift_y int, shift_x int, r double", kernel)


def corrected(frames: DataFrame, template: np.ndarray, params: MotionParams) -> DataFrame:
    """(t, px): each frame corrected as a whole, then by patches."""
    h, w = template.shape

    ready: list[registration.Target] = []  # made once in each task

    def kernel(block):
        if not ready:
            ready.append(registration.Target(template, params))
        return [_lists(registration.correct_block(block, ready[0]))]

    return _mapped(frames, h, w, "t long, px array<double>", kernel)


def _lists(block: np.ndarray) -> pa.ListArray:
    size = block[0].size
    return pa.ListArray.from_arrays(np.arange(len(block) + 1, dtype=np.int32) * size, block.ravel())


def corrected_run(frames: DataFrame, template: np.ndarray, params: MotionParams) -> DataFrame:
    """(t, px): small blocks corrected one after the other by one task, each against the template that the one before it leaves."""
    h, w = template.shape

    def blocks(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The batches' frames, which stand in order of t, cut where a block ends."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            t, px = np.asarray(batch.column(0)), block_of(batch.column(1), h, w)
            number = t // params.block_size
            for part, more in zip(np.split(t, at := np.flatnonzero(np.diff(number)) + 1), np.split(px, at)):
                if held and len(part) and held[-1][0][-1] // params.block_size != part[0] // params.block_size:
                    yield tuple(map(np.concatenate, zip(*held)))
                    held = []
                if len(part):
                    held.append((part, more))
        if held:
            yield tuple(map(np.concatenate, zip(*held)))

    def task(batches):
        now = template
        for t, px in blocks(batches):
            out = registration.correct_block(px, registration.Target(now, params))
            with warnings.catch_warnings():
                warnings.simplefilter("ignore", RuntimeWarning)  # pixels that are NaN throughout
                middle = np.nanmedian(out.reshape(len(out), -1), axis=0).reshape(h, w)
            now = np.where(np.isnan(middle), 0.0, middle)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), _lists(out)], ["t", "px"])

    return frames.select("t", "px").coalesce(1).sortWithinPartitions("t").mapInArrow(task, "t long, px array<double>")


def template_image(frames: DataFrame, h: int, w: int, most: int | None = None) -> np.ndarray:
    """The median image of frames, ``most`` of them if that is known; one value per pixel reaches the driver."""
    pixels = stats.template(frames, most and strip_width(most)).select("p", "template").limit((1 << 22) + 1).toArrow()
    if len(pixels) > 1 << 22:
        raise ValueError("more pixels than one image may have here")
    out = np.zeros(h * w)
    out[np.asarray(pixels["p"])] = np.asarray(pixels["template"])
    return out.reshape(h, w)


def _together(blocks: list[DataFrame]) -> DataFrame:
    """The blocks as one table: one scan where all of them are read from files."""
    files = [b.inputFiles() for b in blocks]
    if all(files):
        return blocks[0].sparkSession.read.schema(blocks[0].schema).parquet(*(f for x in files for f in x))
    return functools.reduce(DataFrame.unionByName, blocks)


def by_runs(frames: DataFrame, length: int, tasks: int, folder: str) -> DataFrame:
    """(t, px, run): the frames from 0 on in folders of ``length`` frames each, of ``tasks`` files at most."""
    run = F.floor(F.col("t") / length).cast("long")
    laid = frames.where("t >= 0").select("t", "px", run.alias("run"))
    spread = laid.repartition("run") if tasks == 1 else laid.repartition("run", F.col("t") % tasks)
    spread.write.mode("overwrite").partitionBy("run").parquet(folder)
    return frames.sparkSession.read.schema(laid.schema).parquet(folder)


def motion_correct(frames: DataFrame, h: int, w: int, params: MotionParams, save, run_values: int = 0, folder: str | None = None) -> DataFrame:
    """The corrected movie (t, px).

    ``save(df, name)`` writes a table that outlives its executors and returns
    it read back; each run of each round is written once, and is all that the
    same run of the next round reads.  Each block is a run, unless several have
    no more than ``run_values`` values together; results are the same.  The
    movie laid out by runs goes to ``folder``, a new one if it is left out.
    Blocks without any frame leave the template as it is.
    """
    if frames.agg(F.max("t")).first()[0] is None or not params.nb_round:
        return frames.select("t", F.col("px").cast("array<double>").alias("px"))
    spark, size = frames.sparkSession, params.block_size * h * w
    length = params.block_size * max(1, run_values // size)
    alone = length == params.block_size
    tasks = max(1, min(size // TASK_VALUES, spark.sparkContext.defaultParallelism)) if alone else 1
    laid = by_runs(frames, length, tasks, folder or new_folder(spark, "motion"))
    # the last frame of each run tells its last block
    last = {r["run"]: r["t"] for r in laid.groupBy("run").agg(F.max("t").alias("t")).collect()}
    opening = laid.where(F.col("run") * length < params.template_frames)
    template = template_image(in_range(opening, 0, params.template_frames), h, w, params.template_frames)
    runs = {n: laid.where(F.col("run") == n).select("t", "px") for n in sorted(last)}
    for turn in range(params.nb_round):
        for n in runs:
            made = corrected(runs[n], template, params) if alone else corrected_run(runs[n], template, params)
            runs[n] = save(made, f"motion-{turn}-{n * length}")
            end = last[n] // params.block_size * params.block_size
            template = template_image(in_range(runs[n], end, end + params.block_size), h, w, params.block_size)
    return _together(list(runs.values()))


def shift_demo(image: np.ndarray, box: int, shift: tuple[int, int], params: MotionParams) -> tuple[np.ndarray, np.ndarray]:
    """An image whose box around the brightest filtered pixel is moved, and the shifts that registration finds by patch."""
    bright = images.band_pass(image[None], params.filter_size_patch)[0]
    cy, cx = np.unravel_index(bright.argmax(), image.shape)
    y0, x0 = max(0, cy - box // 2), max(0, cx - box // 2)
    part = image[y0 : y0 + box, x0 : x0 + box]
    moved = image.copy()
    moved[y0 : y0 + box, x0 : x0 + box] = np.roll(part, shift, axis=(0, 1))
    return moved, registration.Target(image, params).shifts(moved)


def session_save(spark: SparkSession, folder: str):
    """``save`` for :func:`motion_correct` below a folder that all executors share."""

    def save(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save

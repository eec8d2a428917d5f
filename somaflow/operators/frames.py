"""Operators that map frames to frames: no shuffle, whole Arrow batches through numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from somaflow.functions import images

BLOCK = 64


def block_of(column: pa.Array, h: int, w: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(float).reshape(len(column), h, w)


def map_frames(frames: DataFrame, h: int, w: int, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(t, px): ``kernel`` applied to blocks of frames."""

    def task(batches):
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                part = batch.slice(a, BLOCK)
                out = kernel(block_of(part.column(1), h, w)).reshape(len(part), -1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], out.ravel())], ["t", "px"])

    return frames.select("t", "px").mapInArrow(task, "t long, px array<double>")


def band_pass(frames: DataFrame, h: int, w: int, scale: int) -> DataFrame:
    """The zero-mean Gaussian disc filter."""
    return map_frames(frames, h, w, lambda b: images.band_pass(b, scale))


def centred_gaussian(frames: DataFrame, h: int, w: int, sigma: int, center: bool = True) -> DataFrame:
    """The Gaussian, less the box average, by which neurons stand out."""
    return map_frames(frames, h, w, lambda b: images.centred_gaussian(b, sigma, center))

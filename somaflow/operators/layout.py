"""Movies as frames and as pixels, footprints and traces: the two layouts and the ways between them.

frames      (t BIGINT, px ARRAY<FLOAT or DOUBLE>)   one row per frame, row-major
pixels      (t BIGINT, p INT, v DOUBLE)              one row per value
footprints  (k BIGINT, p INT, a DOUBLE)              non-zero weights
traces      (k BIGINT, t BIGINT, v DOUBLE)
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pixels(frames: DataFrame) -> DataFrame:
    """Frames exploded into (t, p, v)."""
    return frames.select("t", F.posexplode("px").alias("p", "v")).withColumn("v", F.col("v").cast("double"))


def place(p: Column, w: int) -> tuple[Column, Column]:
    """(y, x) of a flat index."""
    return (p / F.lit(w)).cast("int"), (p % w).cast("int")


def with_place(df: DataFrame, w: int) -> DataFrame:
    y, x = place(F.col("p"), w)
    return df.withColumn("y", y).withColumn("x", x)


def in_range(frames: DataFrame, start: int, stop: int) -> DataFrame:
    """Frames start .. stop - 1; reaches the scan as a filter."""
    return frames.where((F.col("t") >= start) & (F.col("t") < stop))


def series(long: DataFrame, key: str) -> DataFrame:
    """The corner turn: one row per key with its values in order of t.

    One shuffle on the key; a series is as long as the movie has frames.
    """
    return long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s")).select(key, F.transform("s", lambda e: e["v"]).alias("y"))


#: Pixels of a strip at most, and values that a task holds: the longer a movie, the narrower its strips.
STRIP = 1024
STRIP_VALUES = 1 << 24


def strip_width(n: int) -> int:
    """Pixels of a strip for a movie of ``n`` frames; one, where even its frames exceed STRIP_VALUES."""
    return max(1, min(STRIP, STRIP_VALUES // max(1, n)))


def by_strips(frames: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], schema: str, strip: int | None = None) -> DataFrame:
    """The corner turn in blocks: ``kernel`` of the movie (frames, pixels) of each strip of pixels.

    Each Arrow batch of frames is cut into one block per strip, so that what is
    shuffled is blocks and not values; a task then holds frames x ``strip``
    values, which are STRIP_VALUES at most if it is left out (one count asks
    for the frames).  ``kernel`` returns one row of columns after p for each pixel.
    """
    strip = strip or strip_width(frames.count())
    kind = "<f8" if "double" in frames.schema["px"].dataType.simpleString() else "<f4"

    def cut(batches):
        for batch in batches:
            if not len(batch):
                continue
            t = np.asarray(batch.column(0)).astype("<i8")
            block = np.asarray(batch.column(1).flatten()).astype(kind).reshape(len(batch), -1)
            starts = list(range(0, block.shape[1], strip))
            parts = [np.ascontiguousarray(block[:, a : a + strip]).tobytes() for a in starts]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(starts), dtype=np.int32)), pa.array([t.tobytes()] * len(starts), pa.binary()), pa.array(parts, pa.binary())], ["strip", "t", "block"])

    def turn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        times = [np.frombuffer(b, "<i8") for b in pdf["t"]]
        blocks = [np.frombuffer(b, kind).reshape(len(t), -1) for t, b in zip(times, pdf["block"])]
        movie = np.concatenate(blocks)[np.argsort(np.concatenate(times), kind="stable")].astype(float)
        out = np.asarray(kernel(movie)).reshape(movie.shape[1], -1)
        columns = [c.split()[0] for c in schema.split(", ")]
        return pd.DataFrame({"p": (int(key[0]) * strip + np.arange(len(out))).astype(np.int32), **{c: out[:, i] for i, c in enumerate(columns[1:])}})

    return frames.select("t", "px").mapInArrow(cut, "strip int, t binary, block binary").groupBy("strip").applyInPandas(turn, schema)


def ordered_traces(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Traces from time-stamped values: t counts each key's rows in order."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.select(F.col(key).alias("k"), (F.row_number().over(w) - 1).cast("bigint").alias("t"), F.col(value).cast("double").alias("v"))


def downsampled(frames: DataFrame, w: int, ssub: int, tsub: int) -> DataFrame:
    """Area average over ssub x ssub pixels and tsub frames that divide the movie: (t, y, x, v)."""
    long = with_place(pixels(frames), w)
    cell = [F.floor(F.col("t") / tsub).cast("bigint").alias("t"), F.floor(F.col("y") / ssub).cast("int").alias("y"), F.floor(F.col("x") / ssub).cast("int").alias("x")]
    return long.groupBy(*cell).agg(F.avg("v").alias("v"))


def upsampled_nearest(small: DataFrame, ssub: int, tsub: int) -> DataFrame:
    """Each value repeated over the cell that it came from: (t, y, x, v)."""
    steps = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    grid = small.withColumn("dt", F.explode(steps(tsub))).withColumn("dy", F.explode(steps(ssub))).withColumn("dx", F.explode(steps(ssub)))
    return grid.select((F.col("t") * tsub + F.col("dt")).alias("t"), (F.col("y") * ssub + F.col("dy")).alias("y"), (F.col("x") * ssub + F.col("dx")).alias("x"), "v")


def frame_sample(duration: int, most: int = 3072) -> list[tuple[int, int]]:
    """Ranges of the frames that the noise estimate uses: all, or a third each of start, middle and end."""
    if duration <= most:
        return [(0, duration)]
    third, sixth = most // 3, most // 6
    return [(0, third), (duration // 2 - sixth, duration // 2 + sixth), (duration - third, duration)]


def sampled(frames: DataFrame, most: int = 3072) -> DataFrame:
    """The frames of :func:`frame_sample`; one aggregate asks for the duration."""
    n = frames.agg(F.max("t")).first()[0]
    if n is None or n + 1 <= most:
        return frames
    chosen = None
    for a, b in frame_sample(n + 1, most):
        inside = (F.col("t") >= a) & (F.col("t") < b)
        chosen = inside if chosen is None else chosen | inside
    return frames.where(chosen)

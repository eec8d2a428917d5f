"""The short way in: a movie, its correction, its neurons."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaflow.operators import extraction, motion, stats, traces
from somaflow.params import ExtractionParams, Parameters


@dataclass(frozen=True)
class Movie:
    """Frames (t, px) of h x w pixels, with free attributes such as an animal's name."""

    frames: DataFrame
    h: int
    w: int
    frame_rate: float = 30.0
    attrs: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, spark: SparkSession, movie: np.ndarray, **options) -> Movie:
        """From an array (frames, rows, columns) that fits the driver."""
        rows = [(t, f.ravel().tolist()) for t, f in enumerate(np.asarray(movie, float))]
        return cls(spark.createDataFrame(rows, "t long, px array<double>"), *np.asarray(movie).shape[1:], **options)

    @property
    def duration(self) -> int:
        return self.frames.count()

    def meta(self) -> DataFrame:
        """One row: h, w, duration, frame_rate, attrs."""
        row = [(self.h, self.w, self.duration, float(self.frame_rate), dict(self.attrs))]
        return self.frames.sparkSession.createDataFrame(row, "h int, w int, duration long, frame_rate double, attrs map<string,string>")

    def save(self, folder: str) -> None:
        """Frames and metadata below ``folder``."""
        from somaflow.sources.movies import write_frames

        write_frames(self.frames, f"{folder}/frames")
        self.meta().coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Movie:
        from somaflow.sources.movies import read_frames

        m = spark.read.parquet(f"{folder}/meta").first()
        return cls(read_frames(spark, f"{folder}/frames"), m["h"], m["w"], m["frame_rate"], dict(m["attrs"]))


def motion_correct(movie: Movie, parameters: Parameters, folder: str) -> Movie:
    """The corrected movie; its versions are written below ``folder``, which all executors share."""
    save = motion.session_save(movie.frames.sparkSession, folder)
    return replace(movie, frames=motion.motion_correct(movie.frames, movie.h, movie.w, parameters.motion_correction, save, motion.RUN_VALUES, f"{folder}/motion-runs"))


def correlation_info(movie: Movie, filter_sigma: int | None = None) -> DataFrame:
    """(y, x, cn, pnr), of the band-filtered movie if a sigma is given."""
    from somaflow.operators.frames import centred_gaussian

    frames = movie.frames if filter_sigma is None else centred_gaussian(movie.frames, movie.h, movie.w, filter_sigma)
    return stats.correlation_info(frames, movie.h, movie.w)


class CNMFE:
    """Source extraction of a movie."""

    def __init__(self, movie: Movie, params: ExtractionParams, folder: str):
        self.movie, self.params, self.folder = movie, params, folder

    def fit(self) -> extraction.Result:
        m = self.movie
        return extraction.extract(m.frames, m.h, m.w, self.params, motion.session_save(m.frames.sparkSession, self.folder))


def dff(movie_traces: DataFrame, frame_rate: float, window_sec: float = 5, quantile: float = 0.2) -> DataFrame:
    """(k, t, dff) with the window in seconds."""
    return traces.dff(movie_traces, int(window_sec * frame_rate), quantile)


def load_traces(spark: SparkSession, path: str) -> DataFrame:
    """(k, t, v) of the first array (frames, neurons) of an ``.npz`` file."""
    with np.load(path) as z:
        values = z[z.files[0]]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.asarray(values, float).T)], "k long, y array<double>")
    return rows.select("k", F.posexplode("y").alias("t", "v")).withColumn("t", F.col("t").cast("bigint"))

"""The catalogue of the video files that make up a movie."""

from __future__ import annotations

import glob

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from somaflow.sources.movies import avi_index


def listed(spark: SparkSession, folder: str, pattern: str = "*.avi") -> DataFrame:
    """(path, length) of the files of a folder; their content isn't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")


def ordinal(path: Column) -> Column:
    """Place of a video in its movie: the last group of digits in its path, less one; null without digits."""
    return F.try_element_at(F.regexp_extract_all(path, F.lit(r"\d+"), F.lit(0)), F.lit(-1)).cast("bigint") - 1


def offsets(videos: DataFrame) -> DataFrame:
    """``videos`` (movie, num, duration, ...) with start and stop: frames counted through each movie's videos in order."""
    w = Window.partitionBy("movie").orderBy("num").rowsBetween(Window.unboundedPreceding, 0)
    return videos.withColumn("stop", F.sum("duration").over(w)).withColumn("start", F.col("stop") - F.col("duration"))


def catalogue(spark: SparkSession, pattern: str, movie: str = "") -> DataFrame:
    """(movie, path, num, duration, h, w, start, stop) of the raw AVI files that a pattern names, on a path that all executors see.

    Tasks read the headers and chunk indexes, not the frames.  A file that can't
    be decoded here is an error that names it; no file gives no rows.
    """

    def task(batches):
        for batch in batches:
            found = [(p, *avi_index(p)) for p in batch.column(0).to_pylist()]
            columns = [[p for p, *_ in found], [len(frames) for *_, frames in found], [h for _, h, *_ in found], [w for _, _, w, *_ in found]]
            types = pa.string(), pa.int64(), pa.int32(), pa.int32()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["path", "duration", "h", "w"])

    paths = spark.createDataFrame([(p,) for p in sorted(glob.glob(pattern))], "path string")
    files = paths.mapInArrow(task, "path string, duration long, h int, w int")
    return offsets(files.withColumns({"movie": F.lit(movie), "num": ordinal(F.col("path"))}))

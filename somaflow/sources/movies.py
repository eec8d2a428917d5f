"""Movie sources: frame tables in Parquet, numpy arrays, and uncompressed AVI through a Python data source."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FRAMES = "t long, px array<float>"
CHUNK = 256


def write_frames(frames: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Frames (t, px) as Parquet, parted by runs of ``chunk`` frames, so that a range of frames prunes folders."""
    from pyspark.sql import functions as F

    frames.withColumn("chunk", F.floor(F.col("t") / chunk)).repartitionByRange("chunk").sortWithinPartitions("t").write.mode("overwrite").partitionBy("chunk").parquet(path)


def read_frames(spark: SparkSession, path: str, start: int | None = None, stop: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Frames of a table that :func:`write_frames` made, of a range alone if given."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where((df.chunk >= start // chunk) & (df.t >= start))
    if stop is not None:
        df = df.where((df.chunk <= (stop - 1) // chunk) & (df.t < stop))
    return df.select("t", "px")


def _batches(first: int, frames: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, f in enumerate(frames):
        px = np.ascontiguousarray(f, np.float32).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([first + k]), pa.ListArray.from_arrays([0, len(px)], px)], ["t", "px"])


class _Range(InputPartition):
    def __init__(self, path: str, first: int, stop: int, start: int):
        super().__init__((path, first, stop))
        self.path, self.first, self.stop, self.start = path, first, stop, start


class NumpyMovie(DataSource):
    """``.npy`` files (frames, rows, columns) on a path that all executors see; read by runs of frames."""

    @classmethod
    def name(cls) -> str:
        return "npymovie"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _NumpyReader(self.options["path"])


class _NumpyReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        n = len(np.load(self.path, mmap_mode="r"))
        return [_Range(self.path, a, min(a + CHUNK, n), 0) for a in range(0, n, CHUNK)] or [_Range(self.path, 0, 0, 0)]

    def read(self, part: _Range):
        movie = np.load(part.path, mmap_mode="r")
        yield from _batches(part.first, iter(movie[part.first : part.stop]))


def avi_index(path: str, growing: bool = False) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(rows, columns, bits per pixel, (offset, size) of each frame) of an uncompressed AVI.

    Of a file that is still ``growing``, the frames that are there as a whole.
    Raises ValueError for anything that isn't a RIFF file of raw 8- or 24-bit frames.
    """
    frames: list[tuple[int, int]] = []
    h = w = bits = 0
    with open(path, "rb") as f:
        there = f.seek(0, 2)
        f.seek(0)
        if growing and there < 12:
            return 0, 0, 0, []
        if f.read(4) != b"RIFF":
            raise ValueError(f"{path} is no AVI")
        end = struct.unpack("<I", f.read(4))[0] + 8
        end = there if growing else end
        f.seek(12)
        stack = [end]
        while f.tell() + 8 <= end:
            tag, size = struct.unpack("<4sI", f.read(8))
            at = f.tell()
            if growing and at + size > there and tag != b"LIST":
                break
            if tag == b"LIST":
                f.read(4)
                stack.append(at + size)
                continue
            if tag == b"strf" and not h:
                head = struct.unpack("<IiiHHI", f.read(20))
                w, h, bits, kind = head[1], abs(head[2]), head[4], head[5]
                if kind not in (0, 0x20424944) or bits not in (8, 24):
                    raise ValueError(f"{path}: only raw frames of 8 or 24 bits can be decoded here")
            elif tag[2:] in (b"db", b"dc") and size:
                frames.append((at, size))
            f.seek(at + size + size % 2)
    return h, w, bits, frames


def write_avi(path: str, movie: np.ndarray, rate: int = 30) -> None:
    """8-bit frames (frames, rows, columns) as a raw 24-bit AVI, rows from the bottom."""
    n, h, w = movie.shape
    row = (3 * w + 3) // 4 * 4
    data = np.zeros((n, h, row), np.uint8)
    data[:, :, : 3 * w] = np.repeat(movie[:, ::-1, :, None].astype(np.uint8), 3, axis=3).reshape(n, h, 3 * w)
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    strf = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, row * h, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"DIB ", 0, 0, 0, 0, 1, rate, 0, n, row * h, 0, 0, 0, 0, w, h)
    avih = struct.pack("<14I", 1_000_000 // rate, 0, 0, 0x10, n, 0, 1, row * h, w, h, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    body = b"".join(chunk(b"00db", f.tobytes()) for f in data)
    Path(path).write_bytes(chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", b"movi" + body)))


class RawAvi(DataSource):
    """Uncompressed AVI files of one movie, in order of the last digits in their names; the blue channel as floats."""

    @classmethod
    def name(cls) -> str:
        return "rawavi"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _AviReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _AviStream(self.options["path"])


def _in_order(pattern: str) -> list[str]:
    import glob
    import re

    return sorted(glob.glob(pattern), key=lambda p: (int((re.findall(r"\d+", p) or ["0"])[-1]), p))


def _decoded(part: _Range, growing: bool) -> Iterator[pa.RecordBatch]:
    h, w, bits, frames = avi_index(part.path, growing)
    depth = bits // 8
    row = (depth * w + 3) // 4 * 4

    def images():
        with open(part.path, "rb") as f:
            for at, size in frames[part.first : part.stop]:
                f.seek(at)
                yield np.frombuffer(f.read(size), np.uint8)[: h * row].reshape(h, row)[::-1, : depth * w : depth]

    yield from _batches(part.start + part.first, images())


class _AviStream(DataSourceStreamReader):
    """A folder that grows: offsets are (file, frame), with the frames of all files before.

    Files are taken in order, and a file only when the one before is whole; of
    the last one, frames are taken as they come.
    """

    def __init__(self, path: str):
        self.path = path
        self.whole: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"file": "", "frame": 0, "start": 0}

    def _frames(self, path: str) -> tuple[int, bool]:
        """(frames there, whether the file is whole)."""
        if path not in self.whole:
            with open(path, "rb") as f:
                head, there = f.read(8), f.seek(0, 2)
            n = len(avi_index(path, growing=True)[3])
            if len(head) < 8 or there < struct.unpack("<I", head[4:])[0] + 8:
                return n, False
            self.whole[path] = n
        return self.whole[path], True

    def latestOffset(self) -> dict:
        out, start = self.initialOffset(), 0
        for p in _in_order(self.path):
            n, whole = self._frames(p)
            out = {"file": p, "frame": n, "start": start}
            start += n
            if not whole:
                break
        return out

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        files, at, out = _in_order(self.path), end["start"], []
        if not end["file"]:
            return out
        for p in reversed(files[: files.index(end["file"]) + 1]):
            n = end["frame"] if p == end["file"] else self._frames(p)[0]
            at = end["start"] if p == end["file"] else at - n
            first = start["frame"] if p == start["file"] else 0
            out += [_Range(p, a, min(a + CHUNK, n), at) for a in range(first, n, CHUNK)]
            if p == start["file"]:
                break
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        return _decoded(part, True)


class _AviReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        out, start = [], 0
        for p in _in_order(self.path):
            n = len(avi_index(p)[3])
            out += [_Range(p, a, min(a + CHUNK, n), start) for a in range(0, n, CHUNK)]
            start += n
        if not out:
            raise ValueError(f"no file matches {self.path}")
        return out

    def read(self, part: _Range):
        return _decoded(part, False)


def stream_movie(spark: SparkSession, pattern: str) -> DataFrame:
    """The frames (t, px) of the raw AVI files that a pattern names, as a stream that goes on with every new frame and file."""
    spark.dataSource.register(RawAvi)
    return spark.readStream.format("rawavi").option("path", pattern).load()


def load_movie(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a path by its extension: .avi (a pattern is allowed), .npy, .hdf5 (where h5py is installed), else Parquet."""
    suffix = Path(path).suffix.lower()
    if suffix == ".avi":
        spark.dataSource.register(RawAvi)
        return spark.read.format("rawavi").option("path", path).load()
    if suffix == ".npy":
        spark.dataSource.register(NumpyMovie)
        return spark.read.format("npymovie").option("path", path).load()
    if suffix in (".hdf5", ".h5"):
        try:
            import h5py
        except ImportError as e:
            raise ValueError("HDF5 needs h5py, which isn't installed") from e
        with h5py.File(path) as f:
            key = "original" if "original" in f else "movie"
            n = f[key].shape[0]
        rows = spark.range(0, n, CHUNK)

        def read(batches):
            with h5py.File(path) as f:
                for b in batches:
                    for a in b.column(0).to_pylist():
                        yield from _batches(a, iter(f[key][a : a + CHUNK]))

        return rows.mapInArrow(read, FRAMES)
    if suffix in ("", ".parquet"):
        return read_frames(spark, path)
    raise ValueError(f"no reader for {suffix}")

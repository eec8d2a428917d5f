"""A store of movie versions: a version is there as a whole or not at all.

Tasks write Parquet files into the write's own folder and report them.  When all
have, the driver writes the version's manifest, the list of those files, under a
passing name and moves it to its own: that is the commit.  A write that fails
leaves no manifest, and its folder is deleted; what a task that was still running
leaves after that, no reader sees, and ``sweep`` removes.  Readers name a version and read
the files of its manifest, with Spark's own scan.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a Parquet row group.
GROUP = 4096


def _system(uri: str):
    """(pyarrow file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, store: str, version: str, schema: StructType):
        self.store, self.version, self.kind = store, version, schema.json()
        self.folder = f"data/{version}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import pyarrow.parquet as pq

        system, path = _system(self.store)
        name, rows, sink = f"{self.folder}/{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if sink is None:
                    system.create_dir(f"{path}/{self.folder}", recursive=True)
                    sink = pq.ParquetWriter(f"{path}/{name}.part", batch.schema, filesystem=system, compression="zstd")
                sink.write_batch(batch, row_group_size=GROUP)
                rows += len(batch)
            if sink is None:
                return Written("", 0)
            sink.close()
            system.move(f"{path}/{name}.part", f"{path}/{name}")
        except BaseException:  # whatever ends the attempt, its file goes
            if sink is not None:
                sink.close()
                _delete(self.store, [f"{name}.part"])
            raise
        return Written(name, rows)

    def commit(self, messages: list) -> None:
        system, path = _system(self.store)
        old = _manifest(self.store, self.version)
        files = sorted(m.file for m in messages if m is not None and m.file)
        made = {"version": self.version, "files": files, "rows": sum(m.rows for m in messages if m is not None), "schema": self.kind}
        system.create_dir(f"{path}/versions", recursive=True)
        draft = f"{path}/versions/.{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as sink:
            sink.write(json.dumps(made).encode())
        system.move(draft, f"{path}/versions/{self.version}.json")
        _delete(self.store, _files(self.store, self.folder) - set(files))  # of attempts that weren't taken
        _drop(self.store, old)

    def abort(self, messages: list) -> None:
        """Deletes the folder, also what tasks wrote whose message never came."""
        _delete(self.store, _files(self.store, self.folder))
        system, path = _system(self.store)
        if _is(self.store, self.folder, "Directory"):
            system.delete_dir(f"{path}/{self.folder}")


class MovieStore(DataSource):
    """``df.write.format("movie_store").option("version", ...).mode("append").save(path)``"""

    @classmethod
    def name(cls) -> str:
        return "movie_store"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"].rstrip("/"), self.options["version"], schema)


def _is(store: str, name: str, kind: str) -> bool:
    system, path = _system(store)
    return system.get_file_info(f"{path}/{name}").type.name == kind


def _manifest(store: str, version: str) -> dict | None:
    if not _is(store, f"versions/{version}.json", "File"):
        return None
    system, path = _system(store)
    with system.open_input_stream(f"{path}/versions/{version}.json") as source:
        return json.loads(source.read())


def _files(store: str, folder: str) -> set[str]:
    from pyarrow import fs

    system, path = _system(store)
    return {f"{folder}/{f.base_name}" for f in system.get_file_info(fs.FileSelector(f"{path}/{folder}", allow_not_found=True))}


def _delete(store: str, files) -> None:
    system, path = _system(store)
    for f in files:
        if _is(store, f, "File"):
            system.delete_file(f"{path}/{f}")


def _drop(store: str, made: dict | None) -> None:
    """Deletes the files of a manifest, and the folders that held them."""
    system, path = _system(store)
    files = made["files"] if made else []
    _delete(store, files)
    for folder in {f.rpartition("/")[0] for f in files}:
        if _is(store, folder, "Directory") and not _files(store, folder):
            system.delete_dir(f"{path}/{folder}")


def write_version(df: DataFrame, store: str, version: str) -> None:
    """Writes ``df`` as a version; one of that name is replaced when all of it has been written."""
    if not version or "/" in version or version.startswith("."):
        raise ValueError(f"not a version's name: {version!r}")
    df.sparkSession.dataSource.register(MovieStore)
    df.write.format("movie_store").option("version", version).mode("append").save(store)


def read_version(spark: SparkSession, store: str, version: str) -> DataFrame:
    """A version's rows; an error if it isn't there."""
    made = _manifest(store.rstrip("/"), version)
    if made is None:
        raise FileNotFoundError(f"no version {version!r} in {store}")
    schema = StructType.fromJson(json.loads(made["schema"]))
    if not made["files"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{store.rstrip('/')}/{f}" for f in made["files"]))


def versions(store: str) -> dict[str, int]:
    """Name and rows of every version."""
    from pyarrow import fs

    system, path = _system(store.rstrip("/"))
    found = system.get_file_info(fs.FileSelector(f"{path}/versions", allow_not_found=True))
    names = sorted(f.base_name.removesuffix(".json") for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))
    return {n: _manifest(store.rstrip("/"), n)["rows"] for n in names}


def drop_version(store: str, version: str) -> None:
    """Deletes the manifest first, so that no reader finds a version that has lost files."""
    store = store.rstrip("/")
    made = _manifest(store, version)
    if made is not None:
        _delete(store, [f"versions/{version}.json"])
        _drop(store, made)


def sweep(store: str, older: float = 86_400.0) -> None:
    """Deletes folders that no manifest names and nothing was written to for ``older`` seconds, which no write should take between two files."""
    from pyarrow import fs

    store = store.rstrip("/")
    system, path = _system(store)
    named = {f.split("/")[1] for v in versions(store) for f in _manifest(store, v)["files"]}
    for folder in system.get_file_info(fs.FileSelector(f"{path}/data", allow_not_found=True)):
        inside = system.get_file_info(fs.FileSelector(folder.path, allow_not_found=True))
        if folder.base_name not in named and max(f.mtime.timestamp() for f in [folder, *inside]) <= time.time() - older:
            system.delete_dir(folder.path)


def version_save(spark: SparkSession, store: str):
    """``save`` for the engine's iterations: each table is a version, and what is returned reads it back."""

    def save(df: DataFrame, name: str) -> DataFrame:
        write_version(df, store, name)
        return read_version(spark, store, name)

    return save

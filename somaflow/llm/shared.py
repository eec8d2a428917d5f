"""Files that the driver and all executors can see.

Everything that has to outlive a task or a stage goes below the folder named by
``spark.checkpoint.dir`` (see ``somaflow.folders``); ``scratch`` deletes what was
written inside it.
"""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame

from somaflow.folders import new_folder, remove, scratch, shared_root  # noqa: F401


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    This cuts the lineage: what follows survives the loss of any executor
    without computing ``df`` again.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; usable in a Python worker."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def commit_file(folder: str, stem: str, suffix: str):
    """(file system, temporary path, final path) for one task attempt's file.

    The stem gets a random part, so that a second attempt of a task never
    touches what the first one wrote; readers go by the manifest rows of the
    attempts that succeeded.
    """
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    return system, f"{path}/.{name}.part", f"{path}/{name}"

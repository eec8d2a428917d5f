"""Folders that the driver and all executors can see, and their removal."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import SparkSession

_OWN = "somaflow.shared.dir"
#: Open scopes, each a list of the folders that were named inside it.
_scopes: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """URI of the folder named by ``spark.checkpoint.dir``.

    Where that isn't set, a local master gets a temporary folder that goes with
    the process; on a cluster executors couldn't see one, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="somaflow-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        root = "file://" + local
        spark.conf.set(_OWN, root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder that nothing else uses."""
    uri = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes[-1:]:
        scope.append(uri)
    return uri


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; usable in a Python worker."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def remove(spark: SparkSession, uris: list[str]) -> None:
    """Deletes folders, through Hadoop's file systems; those that don't exist are left out."""
    jvm = spark.sparkContext._jvm
    for uri in uris:
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """Folders named inside are deleted at the end, when what was computed from them has been written elsewhere."""
    _scopes.append([])
    try:
        yield
    finally:
        remove(spark, _scopes.pop())

"""Files that tasks write to and read from the shared working folder."""

from __future__ import annotations

import uuid

import pyarrow.fs
from pyspark.sql import SparkSession

from shelfgraph.session import work_dir


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared one, as a URI that tasks can open."""
    path = work_dir(spark, purpose)
    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return path


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(uri)


def unique_name(stem: str, suffix: str) -> str:
    """A name no other attempt of the same task uses: a repeated task writes a new file and only the reported one is read."""
    return f"{stem}-{uuid.uuid4().hex}{suffix}"

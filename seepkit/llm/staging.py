"""Shared-folder staging: cuts lineage so that a lost executor costs one stage, not the job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from seepkit.sources.shared import delete, discard, new_path, saved, shared_dir

__all__ = ["delete", "discard", "file_system", "materialize", "new_path", "shared_dir"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the reread table. The job's shuffle files go when it
    ends (``saved``), so that disk holds one step's shuffles."""
    return saved(df, name)


def file_system(uri: str):
    """pyarrow file system and the path within it, for files that executors write themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if not uri.startswith("file:") else "file://" + uri[5:])

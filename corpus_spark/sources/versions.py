"""Versions of a saved dataset: written aside, then made current by one new file.

``path/_versions/<name>`` holds a version's data, ``path/_current`` an empty file for each
version that was completed, named by its number and version. The file is created after the
data are complete, and the highest number counts, so nothing is ever renamed or replaced. Stores
without an atomic rename will do.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

__all__ = ["KEPT", "add_version", "current_version", "version_path"]

KEPT = 2  # completed versions that stay: the current one and what its readers may still read


def version_path(path: str, version: str) -> str:
    return f"{path.rstrip('/')}/_versions/{version}"


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _completed(spark: SparkSession, path: str) -> list[str]:
    """Names <number>-<version> of the completed versions, the oldest first."""
    files, folder = _folder(spark, f"{path.rstrip('/')}/_current")
    if not files.exists(folder):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(folder))


def current_version(spark: SparkSession, path: str) -> str | None:
    """Where the data of the current version lie; None if the dataset has no versions."""
    names = _completed(spark, path)
    return version_path(path, names[-1].split("-", 1)[1]) if names else None


def add_version(spark: SparkSession, path: str, version: str) -> None:
    """Make a completely written version the current one and delete those no longer kept."""
    names = _completed(spark, path)
    number = int(names[-1].split("-", 1)[0]) + 1 if names else 0
    files, entry = _folder(spark, f"{path.rstrip('/')}/_current/{number:012d}-{version}")
    files.create(entry, False).close()
    for name in names[: max(len(names) + 1 - KEPT, 0)]:
        files.delete(_folder(spark, version_path(path, name.split("-", 1)[1]))[1], True)
        files.delete(_folder(spark, f"{path.rstrip('/')}/_current/{name}")[1], False)

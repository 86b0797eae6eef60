"""Small documents on the shared file system (headers, statistics, sidecars)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def write_document(spark: SparkSession, path: str, text: str) -> None:
    """Write one metadata document under its exact name through the Hadoop file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def local_uri(spark: SparkSession, path: str) -> str | None:
    """``path`` as a ``file`` URI where it lies on a mounted folder; None on any other file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    return Path(uri.getPath()).as_uri() if uri.getScheme() == "file" else None


def new_folder(spark: SparkSession, path: str) -> None:
    if exists(spark, path):
        raise FileExistsError(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def commit_names(spark: SparkSession, root: str, shard: str = "file", digits: int = 3) -> int:
    """Move finished task files below ``data/chunk=C/<shard>=F`` to ``data/chunk-CCC/<shard><sep>FFF.parquet``; how many.

    Runs after the write has been committed and can be repeated after a failure: a shard whose files have moved is skipped.
    The driver makes one rename a file and touches no data. A shard of a very long episode has several task files; the
    further ones get the ending ``-1``, ``-2`` in frame order.
    """
    path_of, separator = spark._jvm.org.apache.hadoop.fs.Path, "-" if shard == "file" else "_"
    data = path_of(f"{root}/data")
    system = data.getFileSystem(spark._jsc.hadoopConfiguration())
    moved = 0
    for chunk in system.listStatus(data):
        name = chunk.getPath().getName()
        if not name.startswith("chunk="):
            continue
        target = f"{root}/data/chunk-{int(name[6:]):03d}"
        system.mkdirs(path_of(target))
        for folder in system.listStatus(chunk.getPath()):
            number = folder.getPath().getName().partition("=")[2]
            files = sorted(f.getPath().getName() for f in system.listStatus(folder.getPath()) if f.getPath().getName().endswith(".parquet"))
            for file in files:
                stem = f"{target}/{shard}{separator}{int(number):0{digits}d}"
                free = next(i for i in range(len(files) + 1_000_000) if not system.exists(path_of(stem + (f"-{i}" if i else "") + ".parquet")))
                system.rename(path_of(folder.getPath(), file), path_of(stem + (f"-{free}" if free else "") + ".parquet"))
                moved += 1
            system.delete(folder.getPath(), True)
        system.delete(chunk.getPath(), True)
    return moved

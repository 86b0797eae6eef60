"""Session helpers: settings for skewed data and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "episodica", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if not _is_local(spark):
        ship_package(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, which their vectorised functions import, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    base = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="episodica-package-")) / "episodica.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(base.rglob("*.py")):
            out.write(file, Path("episodica") / file.relative_to(base))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only for a local master, where every task sees it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="episodica-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_WRITTEN: dict[str, list[str]] = {}
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: columnar, prunable, and safe when executors are lost."""
    path = new_path(df.sparkSession, name)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    if (inside := _SCRATCH.get()) is not None:
        inside.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, keep: str) -> Iterator[None]:
    """Delete the tables that are written inside, except those named ``keep``, when it ends; what is used later must not
    read the deleted ones. Tables of other threads are left alone."""
    outer, inside = _SCRATCH.get(), []
    token = _SCRATCH.set(inside)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        gone = [p for p in inside if p.rsplit("/", 1)[1].rsplit("-", 1)[0] != keep]
        if outer is not None:
            outer += [p for p in inside if p not in gone]
        written = _WRITTEN.get(spark.sparkContext.applicationId, [])
        written[:] = [p for p in written if p not in gone]
        _delete(spark, gone)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables this application has written; frames built on them become unreadable."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

"""Materialised cuts of a plan, kept in the folder that all executors share."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SWEPT: set[str] = set()
#: Paths of the cuts made in each open scope of ``passing``.
_PASSING: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def qualified(spark: SparkSession, path: str):
    """The URI of a path with the scheme of its file system."""
    fs, target = _file_system(spark, path)
    return fs.makeQualified(target).toUri()


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return bool(fs.exists(target))


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder of any file system, or the name of the file itself."""
    fs, target = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any file system; one that exists is never overwritten."""
    fs, target = _file_system(spark, path)
    out = fs.create(target, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of any file system."""
    return spark.read.text(path, wholetext=True).first()[0]


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder in ``spark.checkpoint.dir``, deleted when the application ends.

    Where the setting is missing, a session on this machine alone gets a temporary folder; a session
    with executors elsewhere is refused, as those couldn't see it.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        found = _LOCAL[app]
    root = f"{found.rstrip('/')}/pathloom-{app}"
    if root not in _SWEPT:
        fs, target = _file_system(spark, root)
        fs.mkdirs(target)
        fs.deleteOnExit(target)
        _SWEPT.add(root)
    return root


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and return a scan of it.

    Unlike a checkpoint of rows the cut is columnar and compressed, and its size is known to
    the optimiser, so that later joins choose their strategy from real statistics.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _PASSING[-1:]:
        paths.append(path)
    df.write.parquet(path)
    scan = spark.read.schema(df.schema).parquet(path)
    scan._cut_path = path
    return scan


def discard(*frames: DataFrame | None) -> None:
    """Delete cuts that no later plan reads."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path:
            fs, target = _file_system(df.sparkSession, path)
            fs.delete(target, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the cuts made in the scope at its end, and the shuffle files of plans that nothing refers to.

    A cut that is read later is made outside, or its path taken off the list that the scope gives.
    """
    _PASSING.append([])
    try:
        yield _PASSING[-1]
    finally:
        for path in _PASSING.pop():
            fs, target = _file_system(spark, path)
            fs.delete(target, True)
        sweep(spark)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans now; it does so when their objects are collected."""
    gc.collect()
    spark._jvm.System.gc()


def stored_bytes(df: DataFrame) -> int:
    """Bytes of a cut on disk; a broadcast is only hinted below a bound on this."""
    path = getattr(df, "_cut_path", None)
    if not path:
        raise ValueError("only a cut has a known size")
    fs, target = _file_system(df.sparkSession, path)
    return int(fs.getContentSummary(target).getLength())


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Session helpers: shared folder for cut lineage, table reading, settings."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    conf = spark.sparkContext.getConf()
    given = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="skewline-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that their Python workers can import it from anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="skewline-package-")  # on the driver; Spark hands the file out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "skewline-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(root, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is free; what is written there goes when the application ends."""
    app = spark.sparkContext.applicationId
    home = os.path.join(shared_dir(spark), f"skewline-{app}")
    if home not in _HOMES:
        # a folder is only marked if it is there
        fs, p = _files(spark, home)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _HOMES.add(home)
    return os.path.join(home, f"{name}-{uuid.uuid4().hex}")


_HOMES: set[str] = set()


def _files(spark: SparkSession, path: str):
    """(file system, path) on the JVM's side."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reads."""
    fs, p = _files(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def folders(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of the folders in a folder."""
    fs, p = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def cut(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Lineage ends there, so a lost executor costs no more than the stage at hand. The table goes when the application
    ends, or before that by ``release`` or ``cleanup``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    _CUT.setdefault(spark.sparkContext.applicationId, set()).add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_cut_path"] = path
    return out


_CUT: dict[str, set[str]] = {}


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote; nothing may read them afterwards."""
    for t in tables:
        path = t.__dict__.get("_cut_path")
        if path:
            fs, p = _files(t.sparkSession, path)
            fs.delete(p, True)
            _CUT.get(t.sparkSession.sparkContext.applicationId, set()).discard(path)


def cleanup(spark: SparkSession) -> int:
    """Deletes all tables of this application that ``cut`` wrote, once their results are consumed; gives their number."""
    paths = _CUT.pop(spark.sparkContext.applicationId, set())
    for path in paths:
        fs, p = _files(spark, path)
        fs.delete(p, True)
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

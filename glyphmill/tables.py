"""Reading the named tables, and tables kept in the folder that all executors share.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` (read from the session; a local
folder stands in only where it is unset, as in tests). Such a table outlives the loss of executors.
"""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the executors of the session's cluster, once for each
    application: a zip in the shared folder, of whatever file system, is added to the Python path of all tasks."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for at, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(at, f), os.path.relpath(os.path.join(at, f), os.path.dirname(package)))
    zipped = f"{shared_dir(spark)}/{os.path.basename(package)}-{uuid.uuid4().hex}.zip"
    to = spark._jvm.org.apache.hadoop.fs.Path(zipped)
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to)
    try:
        out.write(held.getvalue())
    finally:
        out.close()
    spark.sparkContext.addPyFile(local_path(zipped) if "://" not in zipped or zipped.startswith("file:") else zipped)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = tempfile.mkdtemp(prefix="glyphmill-shared-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: folders of the tables that weren't dropped yet
_kept: set[str] = set()


class SharedTable:
    """A frame written once to the shared folder and read from there; ``drop`` removes it, ``drop_tables`` all
    that are left."""

    def __init__(self, df: DataFrame, codec: str = "zstd"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/glyphmill-{uuid.uuid4().hex}"
        df.write.option("compression", codec).parquet(self.path)
        _kept.add(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _remove(self.spark, self.path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _kept.discard(path)


def drop_tables(spark: SparkSession) -> None:
    """Removes every shared table written so far; frames that read them, results too, can't be read any more."""
    for path in list(_kept):
        _remove(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_path(path: str) -> str:
    """The mounted path of a folder; other file systems are an error, as tasks would write to their own disks."""
    if path.startswith("file:"):
        return os.path.abspath("/" + path.removeprefix("file:").lstrip("/"))
    if "://" in path:
        raise ValueError(f"{path} isn't on a mounted file system")
    return os.path.abspath(path)

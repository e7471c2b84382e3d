"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions, by application.
_local: dict[str, str] = {}
_swept: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only a local session, where there is one machine, may go without that setting: it gets a
    temporary folder, which goes when Python ends. A cluster without it is refused.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc._jsc.sc().getCheckpointDir().get()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = tempfile.mkdtemp(prefix="cragline-")
        atexit.register(shutil.rmtree, _local[sc.applicationId], ignore_errors=True)
    return _local[sc.applicationId]


def scratch_folder(spark: SparkSession) -> str:
    """A folder of the application's own in the shared one. What is left in it goes when Python ends."""
    folder = f"{shared_folder(spark)}/cragline-{spark.sparkContext.applicationId}"
    if folder not in _swept:
        _swept.add(folder)
        atexit.register(_sweep, spark.sparkContext._gateway, spark.sparkContext._jsc.sc().hadoopConfiguration(), folder)
    return folder


def _sweep(gateway: Any, settings: Any, folder: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone first
        where = gateway.jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(settings).delete(where, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet in the scratch folder and read again: the lineage ends there.

    ``discard`` removes the files once nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cragline_path = path
    return back


def discard(df: DataFrame | None) -> None:
    """Deletes the files behind a frame made by ``materialise``."""
    path = getattr(df, "_cragline_path", None)
    if df is not None and path:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(where, True)

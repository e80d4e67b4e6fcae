"""The folder that driver and executors share, and tables written to it: they cut the lineage and outlive the executor that made them."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Folders of this application, by session's application id; they are deleted when the driver ends.
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset (a local session), one of our own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="hushframe-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def own_dir(spark: SparkSession) -> str:
    """This application's folder under the shared one. It goes when the driver ends, if the cluster can still be asked."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_dir(spark)}/hushframe-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_delete_quietly, spark, _folders[app])
    return _folders[app]


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the driver is ending, and its JVM may be gone already
        return


@contextlib.contextmanager
def fixed_plans(spark: SparkSession) -> Iterator[None]:
    """Without adaptive execution, whose stages and joins depend on the sizes of what was counted before."""
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read back: what is random or depends on a partitioning is fixed from here on."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "lz4_raw").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""The folder that all executors share, and tables kept there."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; on a local master without one, a temporary folder."""
    context = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; what is written there goes when the program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The paths of what stands in `folder`, in order; none if it does not exist."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(x.getPath()) for x in files.listStatus(place)) if files.exists(place) else []


def renamed(spark: SparkSession, old: str, new: str) -> None:
    """Moves `old` to `new` in one step; a file system that refuses raises."""
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (old, new)]
    if not paths[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(*paths):
        raise OSError(f"could not move {old} to {new}")


def durable(df: DataFrame) -> DataFrame:
    """`df` checkpointed in the shared folder, so that a lost executor doesn't cost a recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

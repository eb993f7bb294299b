"""Tables and folders that live as long as the driver's Python, in the folder that a cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset on a local master (tests), one of our own.

    A cluster without the setting is an error, as its executors don't see the driver's folders.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="seqscope-")
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder in the shared one, if it is there."""
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_folder(spark: SparkSession, prefix: str = "seqscope") -> str:
    """The path of a new folder in the shared one, which is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{prefix}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile leaves no exchanges on disk: Spark removes them when a run ends, and not when the driver's garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def save(df: DataFrame, *partition_by: str, path: str | None = None, release: bool = False) -> DataFrame:
    """The same rows, written as Parquet into the shared folder (or the folder path) and read back.

    Lineage ends there, so a lost executor costs no recomputation of what came before. Written tables
    hold less than a checkpoint does and let later scans prune columns. With release, the exchanges that the rows
    came through are removed as soon as they are written.
    """
    path = path or new_folder(df.sparkSession)
    with released(df.sparkSession) if release else contextlib.nullcontext():
        df.write.parquet(path, partitionBy=list(partition_by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Session helpers: table access, checkpoints, bounded broadcast."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lexloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by a table written once to the folder the session names.

    ``spark.checkpoint.dir`` is a folder that all executors share, so the rows
    outlive any of them. Only where it is unset (tests, local runs) a folder of
    this machine is used.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local_folder()
    path = f"{folder.rstrip('/')}/lexloom-{uuid.uuid4().hex}"
    _remember(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list = []


def _remember(spark: SparkSession, path: str) -> None:
    """Note a table that :func:`release` removes, at the end of the program at last."""
    if not _written:
        atexit.register(release)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    _written.append((place, place.getFileSystem(spark._jsc.hadoopConfiguration())))


def release() -> None:
    """Remove the tables that :func:`materialize` wrote; frames made of them are lost."""
    while _written:
        place, files = _written.pop()
        with contextlib.suppress(Exception):
            files.delete(place, True)


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="lexloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"

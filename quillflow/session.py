"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# UTC is part of the data model: buckets, cut-offs and exports are all in UTC.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Call-site capture doubles the time it takes to build long column expressions.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "quillflow", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with the library defaults; pass Spark settings with `__` for `.`."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


# Codec of files that are mostly text: they are two thirds as large as with the default one.
TEXTS = {"compression": "zstd"}

_OPEN: ContextVar[list[str] | None] = ContextVar("quillflow_scratch", default=None)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of each write inside the block as soon as it ends, and not when the driver happens to collect
    its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bytes_read(rows: DataFrame) -> int | None:
    """Size of what the rows are made from, by Spark's estimate; None if it has none."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(n >= 2**62 for n in sizes) else sum(sizes)


@contextmanager
def passing_scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch folders made inside the block when it ends; nothing that reads them may leave it."""
    made: list[str] = []
    token = _OPEN.set(made)
    try:
        yield
    finally:
        _OPEN.reset(token)
        for folder in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's `spark.checkpoint.dir`.

    Only a local-mode session may fall back to a machine-local folder: on a cluster that folder
    would not be visible to the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="quillflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    made = _OPEN.get()
    if made is not None:
        made.append(folder)
    return folder


def written(rows: DataFrame, label: str, **options: str) -> DataFrame:
    """Write to the shared scratch folder and read back.

    Every later step starts from files: a lost executor costs its own tasks only, several readers
    do not compute the rows again, and filters on them do not repeat costly expressions.
    """
    path = scratch_dir(rows.sparkSession, label)
    rows.write.mode("overwrite").options(**options).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)

"""Session settings the library relies on, and where it may write working tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# SQL settings that must hold when an action runs, not only when a frame is defined.
SQL_SETTINGS = {
    # Timestamps without zone and text renderings must not depend on the host.
    "spark.sql.session.timeZone": "UTC",
    # GBK, ISO-8859-15, windows-1252 and Shift_JIS are outside Spark 4's default charset list.
    "spark.sql.legacy.javaCharsets": "true",
    # Undecodable bytes become U+FFFD instead of failing the job.
    "spark.sql.legacy.codingErrorAction": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to an existing session; safe to call repeatedly."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "ferrywright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above. Cluster sizing stays with spark-submit or `conf`."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`; a temporary one only in local runs."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="ferrywright-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


# The paths of the run that is open in this thread, if one is.
_OPEN: ContextVar[list[str] | None] = ContextVar("paths of the open run", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch root; never reused, so nothing has to be cleared first."""
    path = f"{scratch_root(spark)}/ferrywright/{label}-{uuid.uuid4().hex}"
    paths = _OPEN.get()
    if paths is not None:
        paths.append(path)
    return path


@contextmanager
def run_scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the scratch paths handed out while it was open, and only those.

    What is staged inside must be written elsewhere or collected before it closes. A run
    inside a run deletes its own paths when it closes.
    """
    paths: list[str] = []
    token = _OPEN.set(paths)
    try:
        yield paths
    finally:
        _OPEN.reset(token)
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a frame to Parquet in the shared folder and read it back.

    Used where several actions read one expensive result. It cuts the lineage like
    `checkpoint()`, survives lost executors, and later readers still get column
    pruning and filter pushdown.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the staged copies behind these frames, which nothing may read any more.

    Only what `stage` wrote for exactly these frames goes, through the file system that
    holds it; frames that were not staged are left alone.
    """
    for frame in frames:
        path = frame.__dict__.pop("staged_at", None)
        if path:
            _delete(frame.sparkSession, path)

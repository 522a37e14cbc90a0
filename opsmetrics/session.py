"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed join partitions even where that costs one more shuffle later.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Longer top-n lists are sorted on the cluster, not gathered on the driver.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
}


def build_session(app: str = "opsmetrics", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without one; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="opsmetrics-checkpoint-")
        context.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: With this setting Spark removes a query's shuffle files when the query ends.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_recording = threading.local()
_writing_lock = threading.Lock()
_writing: dict[str, tuple[int, str | None]] = {}


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside leave no shuffle files. The setting is given back when the session's last thread leaves."""
    key = spark._jsparkSession.sessionUUID()
    with _writing_lock:
        count, before = _writing.get(key, (0, None))
        if not count:
            before = spark.conf.get(SHUFFLES_END, None)
            spark.conf.set(SHUFFLES_END, "true")
        _writing[key] = count + 1, before
    try:
        yield
    finally:
        with _writing_lock:
            count, before = _writing.pop(key)
            if count > 1:
                _writing[key] = count - 1, before
            elif before is None:
                spark.conf.unset(SHUFFLES_END)
            else:
                spark.conf.set(SHUFFLES_END, before)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that ``materialise`` writes inside, for ``drop_tables`` once nothing reads them any more."""
    lists = _recording.__dict__.setdefault("lists", [])
    made: list[str] = []
    lists.append(made)
    try:
        yield made
    finally:
        lists[:] = [x for x in lists if x is not made]


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that ``materialise`` wrote. Paths that are gone already are passed over."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    paths.clear()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the checkpoint folder and go on from there.

    Later steps all see the same rows, survive lost executors without the work before, and
    are planned with the true size of the table. The shuffle files of the write go when it ends: only the table is read from then on.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    for made in getattr(_recording, "lists", ()):
        made.append(path)
    with _shuffles_end(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

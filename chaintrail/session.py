"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Shuffle files go when the query they were written for has ended.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL_ROOTS: dict[str, str] = {}
_FREEING = threading.Lock()
#: Per session: writes under way, and the setting from before the first of them.
_WRITES: dict[int, tuple[int, str | None]] = {}


def build_session(app: str = "chaintrail", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's spark.checkpoint.dir.

    Only a local master may fall back to a machine-local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        app = spark.sparkContext.applicationId
        root = _LOCAL_ROOTS.setdefault(app, "") or tempfile.mkdtemp(prefix="chaintrail-")
        _LOCAL_ROOTS[app] = root
    return root


def new_scratch(spark: SparkSession, name: str) -> str:
    """A path under the scratch folder that no other run uses."""
    app = spark.sparkContext.applicationId
    return os.path.join(scratch_root(spark), "chaintrail", app, f"{name}-{uuid.uuid4().hex}")


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind, which would else stay until the driver collects its garbage."""
    with _FREEING:
        writes, before = _WRITES.get(id(spark), (0, None))
        if not writes:
            before = spark.conf.get(FREED, None)
            spark.conf.set(FREED, "true")
        _WRITES[id(spark)] = writes + 1, before
    try:
        yield
    finally:
        with _FREEING:
            writes, before = _WRITES.pop(id(spark))
            if writes > 1:
                _WRITES[id(spark)] = writes - 1, before
            elif before is None:
                spark.conf.unset(FREED)
            else:
                spark.conf.set(FREED, before)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and read it back.

    The result survives lost executors, and its file sizes give the planner
    exact statistics for its next joins. The shuffles behind it are freed.
    """
    path = new_scratch(df.sparkSession, name)
    with _shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def bucketed(df: DataFrame, keys: list[str], name: str = "step") -> DataFrame:
    """`materialise` as a table bucketed and sorted by `keys`, in as many buckets as the session has shuffle partitions.

    Such tables meet on `keys` without a shuffle of their rows, and a frame that was grouped by `keys` is
    written from where it stands. The table lives in the session's catalogue until it is discarded.
    """
    spark = df.sparkSession
    path, table = new_scratch(spark, name), f"step_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _shuffles_freed(spark):
        df.write.format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    out = spark.table(table)
    out._scratch_path, out._scratch_table = path, table
    return out


def discard(*steps: DataFrame) -> None:
    """Delete step tables that a later step has replaced; others than those are left alone.

    Long iterations would otherwise keep every round on the shared folder.
    """
    for df in steps:
        path = getattr(df, "_scratch_path", None)
        if path is None:
            continue
        spark = df.sparkSession
        if table := getattr(df, "_scratch_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def in_parallel(spark: SparkSession, tasks: Mapping[str, Callable[[], object]], at_once: int = 4) -> dict[str, object]:
    """Run independent driver-side tasks, each in a scheduler pool of its own; returns results or exceptions by name.

    Short tasks then fill the executors that the tail of a long one leaves idle. Local properties
    of the calling thread hold for all of them.
    """

    def run(name: str) -> object:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            return tasks[name]()
        except Exception as failure:  # noqa: BLE001  the caller decides what one failure means for the rest
            return failure

    with ThreadPoolExecutor(max(1, min(at_once, len(tasks)))) as pool:
        waiting = {name: pool.submit(inheritable_thread_target(spark)(run), name) for name in tasks}
        return {name: f.result() for name, f in waiting.items()}

"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_MADE: dict[str, None] = {}  # scratch folders of this process, oldest first

# Files are worked on in parts of at least so many bytes, and in at most so many parts.
PART_BYTES, MOST_PARTS = 32 << 20, 4
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings the operators' meaning depends on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    Every executor must see what one of them writes, so without that setting only
    a local session, whose executors are the driver, gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="eventide-")
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _MADE[path] = None
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders that nothing reads any more. Only folders made here are touched."""
    for path in paths:
        if path in _MADE:
            del _MADE[path]
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            try:
                files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
            except Py4JJavaError as exc:
                if "ClassNotFoundException" not in str(exc.java_exception):
                    raise
                continue  # this session has no such file system, so nothing was written there
            files.delete(folder, True)


def clear_scratch(spark: SparkSession) -> int:
    """Delete every scratch folder of this process, once its results are read; returns how many."""
    paths = list(_MADE)
    discard(spark, *paths)
    return len(paths)


def materialise(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Write ``df`` to the shared folder; return it read back, and its row count.

    This cuts the lineage: whatever reads the result restarts from the files.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), int(seen.get["rows"])


def materialise_parts(parts: list[DataFrame], label: str) -> tuple[DataFrame, int]:
    """Like :func:`materialise`, for a frame given in parts, which are written one after the other.

    The files of each part's shuffles go before the next part begins.
    """
    spark, layout = parts[0].sparkSession, parts[0].schema
    path, rows = scratch_dir(spark, label), 0
    with brief_shuffles(spark):
        for part in parts:
            seen = Observation()
            part.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").option("compression", "zstd").parquet(path)
            rows += int(seen.get["rows"])
    return spark.read.schema(layout).parquet(path), rows


# --- work in parts ----------------------------------------------------------
@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends.

    Otherwise they stay until the driver happens to collect its garbage, so that a job of many
    steps holds all their shuffles at once. A frame must not be executed twice inside: its
    stages would run again.
    """
    old = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if old is None else spark.conf.set(SHUFFLE_CLEANUP, old)


def part_count(df: DataFrame) -> int:
    """In how many parts to work on ``df``: every part reads its files again, but only one
    part's shuffle is on disk at a time.

    Whatever is not read straight from the files of one table stays whole, since every part
    would repeat its joins, and so does what may change from one reading to the next.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    steady = plan.deterministic()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    if not steady or plan.nodeName() != "LogicalRelation" or "HadoopFsRelation" not in plan.relation().getClass().getName():
        return 1
    size = int(str(plan.stats().sizeInBytes()))
    return max(1, min(MOST_PARTS, -(-size // PART_BYTES)))


def in_part(key: str, i: int, n: int) -> Column:
    """Whether a row is in the ``i``-th of ``n`` parts; every row is in one, those without a key too."""
    return F.pmod(F.xxhash64(key), F.lit(n)) == i


def together(spark: SparkSession, *steps: Callable):
    """Results of independent steps whose jobs run at the same time, in order.

    Small writes leave most of a cluster idle one after the other. All steps end before
    the first error of any is raised.
    """
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    return [r.result() for r in running]

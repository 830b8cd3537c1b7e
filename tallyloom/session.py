"""Session factory and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed evaluation day; ages and "days since" never depend on the clock.
TODAY = date(2026, 9, 25)


def build_session(app: str = "tallyloom", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own session."""
    n = cpus or os.cpu_count() or 4
    b = SparkSession.builder.master(f"local[{n}]").appName(app)
    base = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per session: they needn't have it on their path. Spark's own file
    server carries the archive to every executor, also to those that join later."""
    sc = spark.sparkContext
    if getattr(sc, "_tallyloom", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    # served by the driver as long as the application lives
    d = tempfile.mkdtemp(prefix="tallyloom-code-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    path = os.path.join(d, "tallyloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._tallyloom = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one of this machine, which only a
    local session may use; a cluster that names none is refused."""
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_:
        return set_
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir is unset: on {master} the tables that cut lineage need a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tallyloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir() or made


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession, **more: str) -> Iterator[None]:
    """Within it, the shuffle files of an execution are deleted when it ends, not when the driver happens to collect its garbage.
    more: further settings for as long, by the last parts of their names under spark.sql, with _ for dots."""
    conf = {_CLEANUP: "true"} | {f"spark.sql.{k.replace('_', '.')}": v for k, v in more.items()}
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Tables that `keep` has written, by application.
_KEPT: dict[str, list[str]] = {}


def keep(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and lost executors cost nothing.

    The files are small beside the rows they hold, so that the planner would take them for small tables: a join with one of
    them is a merge join unless the other side is broadcast by name. The shuffle files behind it are deleted. `forget` deletes the
    tables, `release` one of them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    _KEPT.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(df: DataFrame) -> None:
    """Deletes the table of `keep` that df reads, once nothing reads it any more."""
    spark = df.sparkSession
    kept = _KEPT.get(spark.sparkContext.applicationId, [])
    for file in df.inputFiles():
        # a table's folder, as keep named it, is the parent of its files
        name = file.rsplit("/", 2)[1]
        for path in [p for p in kept if p.endswith(f"/tables/{name}")]:
            kept.remove(path)
            _delete(spark, path)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A kept table to be broadcast where it is counted to have no more than so many rows; a larger one is joined by a merge join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def forget(spark: SparkSession) -> int:
    """Deletes the tables that `keep` has written for this application and says how many: for when all results are written,
    as results that are still to be computed may read them."""
    paths = _KEPT.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        _delete(spark, p)
    return len(paths)

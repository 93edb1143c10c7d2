"""Session construction and the shared working folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Thread counts of numeric libraries inside Python workers; tasks are the unit of parallelism.
_ONE_THREAD = ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS")

#: Rows of one Arrow batch handed to Python workers.
ARROW_ROWS = 20_000


def get_session(app: str = "tidemark", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with UTC, AQE and Arrow; on a cluster use the session that the cluster gives."""
    for name in _ONE_THREAD:
        os.environ.setdefault(name, "1")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset (tests, a laptop) a temporary folder is set once for the session.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: a cluster must name a folder that its executors share")
    made = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    atexit.register(lambda: __import__("shutil").rmtree(made, ignore_errors=True))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a Parquet table into the shared folder and read it back.

    Cuts the lineage with copies that outlive an executor. The files go when the application ends, or by `discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def delete_at_end(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def materialize_all(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """materialize for several tables that don't depend on each other, at the same time."""
    with ThreadPoolExecutor(len(tables)) as pool:
        return list(pool.map(lambda t: materialize(t[1], t[0]), tables.items()))


def discard(*tables: DataFrame | None) -> None:
    """Remove the files of tables that `materialize` gave and that nothing will read again; others are left alone."""
    for t in tables:
        path = getattr(t, "__dict__", {}).get("written_at")
        if path:
            remove(t.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shared_path(spark: SparkSession, name: str) -> str | None:
    """A new path within the shared folder, or None where that isn't a folder of the file system."""
    folder = shared_dir(spark).rstrip("/")
    if "://" in folder or folder.startswith("file:"):
        if not folder.startswith("file:/"):
            return None
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def spread(scan: DataFrame) -> DataFrame:
    """A scan in at least as many partitions as there are cores, for work that costs far more than a shuffle."""
    wanted = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= wanted else scan.repartition(wanted)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table_path(folder: str, name: str) -> str:
    return str(Path(folder) / f"{name}.parquet") if "://" not in folder else f"{folder.rstrip('/')}/{name}.parquet"

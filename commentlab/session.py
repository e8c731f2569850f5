"""Session helpers: a local builder, and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and benches. A cluster job brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("commentlab")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or given to ``setCheckpointDir``.

    Only a local-mode session without either gets a folder of its own; on a cluster
    a machine-local folder would not survive the loss of its machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    sc = spark.sparkContext
    given = getattr(sc, "getCheckpointDir", lambda: None)()
    if given:
        return given.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="commentlab-")
    return _local_dirs[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, under a folder of this application."""
    app = spark.sparkContext.applicationId
    return f"{work_dir(spark)}/commentlab/{app}/{name}-{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> None:
    """Delete the intermediates of this application, once nothing that reads them is needed."""
    discard(spark, f"{work_dir(spark)}/commentlab/{spark.sparkContext.applicationId}")


def discard(spark: SparkSession, path: str) -> None:
    """Delete one folder of intermediates that nothing will read again."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def run_each(spark: SparkSession, work: Callable, items: list, parallelism: int = 4) -> list:
    """``work(item)`` for each item, a few Spark jobs under way at a time."""
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read instead of a re-computation, and
    lets several consumers share one expensive result. Partitioned tables are rebalanced
    first: files of even size instead of one per task and partition, however skewed they are.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if partition_by:
        even = df.hint("rebalance", *partition_by)
        even.write.mode("error").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("error").parquet(path)
    # Partition columns come back last and typed by the given schema, not by inference.
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)

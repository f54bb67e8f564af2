"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = "8m"  # of a batch that is sent to a Python worker

_SHIPPED: set[str] = set()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("acrely")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to a
    folder of this machine, because there executors and driver are the same process.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="acrely-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return os.path.join(work_dir(spark), "acrely", f"{label}-{uuid.uuid4().hex}")


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Let the file system delete `path` when the application ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that functions that run in
    tasks can be imported there whatever the workers' own path holds."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="acrely-code-"), "acrely-code.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on. Methods beyond the JIT limit of the JVM would run
    interpreted, so generated code above it is split per operator instead. What a Python worker holds at a
    time is bounded in bytes, as ten thousand rows may be long texts."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    ship(spark)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of an input that has fewer splits than the cluster has cores.

    A table of many files, which is what a large one is, comes back unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from there: its lineage ends, a lost executor costs
    nothing, and Spark knows its size. The folder goes when the application ends."""
    path = fresh_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    forget_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

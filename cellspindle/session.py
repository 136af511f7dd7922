"""Session and shared-folder helpers used by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cellspindle")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small input over all cores, where it has fewer files than there are cores.

    Work in Python is bound to the splits of the input otherwise. An input of more than a split a core stays as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    small = int(plan.stats().sizeInBytes()) < cores * split
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a temporary folder is set for a session on one machine, as in tests; on a cluster, whose
    executors would each write to their own disk, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cellspindle-")
        spark.sparkContext.setCheckpointDir(named)
        atexit.register(_delete_local, named[7:])
    return named


def _delete_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of files, not a recomputation, and readers can prune columns.
    """
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the application ends."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/cellspindle-{spark.sparkContext.applicationId}")
    if str(path) not in _run_dirs:
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        _run_dirs.add(str(path))
    return str(path)


_run_dirs: set[str] = set()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path of this application in the shared folder."""
    return f"{_run_dir(spark)}/{uuid.uuid4().hex}/{name}"


def folder_files(spark: SparkSession, folder: str) -> list[str]:
    """The data files of a folder, by name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().toString() for f in found if f.isFile() and not f.getPath().getName().startswith(("_", ".")))


def write_shared_bytes(spark: SparkSession, data: bytes, name: str) -> str:
    """Write bytes to the shared folder through Hadoop's file system; returns the full URI."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{_run_dir(spark)}/{uuid.uuid4().hex}-{name}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(path, True)
    try:
        out.write(data)
    finally:
        out.close()
    return files.makeQualified(path).toString()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application.

    The package goes through the shared folder as a zip, so workers need no installation.
    """
    import io
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(write_shared_bytes(spark, data.getvalue(), "cellspindle.zip"))
    _shipped.add(sc.applicationId)


_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

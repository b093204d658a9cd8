"""Session helpers: nothing here overrides what the cluster has already set."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app_name: str = "corpuslab", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where that is unset and the master is local does a temporary folder stand in for it:
    executors of a cluster could not see one another's machine-local files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="corpuslab-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``scratch_path`` that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows, and the partition each one is in, are fixed from here on."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def released(*frames: DataFrame) -> None:
    """Deletes the files of checkpointed frames. For frames that nothing reads any more, not even to recompute a lost part."""
    for df in frames:
        rdd = df._jdf.queryExecution().toRdd()
        context = df.sparkSession.sparkContext
        for source in [rdd, *_parents(rdd)]:
            file = source.getCheckpointFile()
            if file.isDefined():
                path = context._jvm.org.apache.hadoop.fs.Path(file.get())
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
                break


def _parents(rdd) -> list:
    found, dependencies = [], rdd.dependencies()
    while dependencies.size():
        rdd = dependencies.head().rdd()
        found.append(rdd)
        dependencies = rdd.dependencies()
    return found

"""Tables kept between jobs, in a folder that every executor can reach.

The cluster names that folder in ``spark.checkpoint.dir``. Only where the setting is missing (tests,
a laptop) a temporary folder of this machine is set. Nothing here relies on executor-local storage, so
a lost executor costs recomputed tasks, never results.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; set to a temporary one only where the cluster names none."""
    folder = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set(_KEY, folder)
        atexit.register(_remove, spark, folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already; then the cluster cleans its folder
        pass


def keep(df: DataFrame, name: str = "table", free: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts its lineage.

    free: let go of the shuffle files that led to it at once. Spark removes them when the driver collects its garbage,
    which may otherwise come long after a large step.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    schema = df.schema
    if free:
        del df
        gc.collect()
        for _ in range(2):  # the first collection only uncovers what the finished write still held
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.1)
    return spark.read.schema(schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove the files of a table made by keep(), once nothing reads it any more."""
    for path in df.inputFiles()[:1]:
        _remove(df.sparkSession, path.rsplit("/", 1)[0])
